"""Connected components of an edge table, without collecting edges or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for each node of `edges`; label is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014).  Each step takes a minimum
    per node, which is combined before the shuffle, and joins it back, which Spark can split where
    one node has very many edges.  Nulls and loops are ignored; an empty table gives no rows.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    e = checkpointed(_down(e), slim=True)
    while not _stars(e):
        e = checkpointed(_small_star(_large_star(e)), slim=True)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _stars(e: DataFrame) -> bool:
    """Whether each a has one b only and none is a b itself; then every b is the least of its component."""
    a = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    b = e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = a.unionByName(b).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").isEmpty()


def _down(e: DataFrame) -> DataFrame:
    """Each edge once, from the larger node a to the smaller node b."""
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(least.select("a", F.col("m").alias("b"))))
