"""Labels, extracts and summaries of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def with_labels(neighbors: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """NEIGHBORS with query_label and label, by row number; Spark broadcasts a small points table."""
    q = queries.select(F.col("idx").alias("qid"), F.col("label").alias("query_label"))
    c = corpus.select(F.col("idx").alias("cid"), "label")
    return neighbors.join(q, "qid").join(c, "cid").select("qid", "query_label", "rank", "cid", "label", "dist")


def extract(neighbors: DataFrame, queries: int = 10, ranks: int = 5) -> DataFrame:
    """The first neighbours of the first queries, for printing."""
    return neighbors.where((F.col("qid") < queries) & (F.col("rank") <= ranks)).orderBy("qid", "rank")


def render(points: DataFrame, width: int = 28) -> DataFrame:
    """(idx, picture): each vector as lines of whole numbers."""
    return points.select("idx", V.rendered(F.col("v"), width).alias("picture"))


def with_pictures(neighbors: DataFrame, queries: DataFrame, corpus: DataFrame, width: int = 28) -> DataFrame:
    """NEIGHBORS with query_picture and picture, the vectors of both sides as `render` shows them.

    Meant for an `extract` of a result: only the points that it names are drawn.
    """
    drawn = lambda points, idx, name: render(points, width).select(F.col("idx").alias(idx), F.col("picture").alias(name))
    return neighbors.join(drawn(queries, "qid", "query_picture"), "qid").join(drawn(corpus, "cid", "picture"), "cid").select(*neighbors.columns, "query_picture", "picture")


def summary(points: DataFrame) -> DataFrame:
    """(x_start, x_end, n, d, text) of a table of points."""
    s = points.agg(F.min("idx").alias("x_start"), (F.max("idx") + 1).alias("x_end"), F.count("*").alias("n"), F.max(F.size("v")).alias("d"))
    return s.withColumn("text", F.format_string("%d->%d | n: %d d: %d", "x_start", "x_end", "n", "d"))


def result_summary(neighbors: DataFrame, y_start: int, y_end: int) -> DataFrame:
    """(text): the covered query and corpus ranges of a result."""
    s = neighbors.agg(F.min("qid").alias("a"), (F.max("qid") + 1).alias("b"))
    return s.select(F.format_string("X:%d->%d | Y:%d->%d", "a", "b", F.lit(y_start), F.lit(y_end)).alias("text"))


def flat_matrix(points: DataFrame, d: int) -> DataFrame:
    """(flat_idx, value): the points as a row-major matrix."""
    cells = points.select("idx", F.posexplode("v").alias("j", "value"))
    return cells.select(V.flat_index(F.col("idx"), F.col("j"), d).alias("flat_idx"), "value")
