"""The k nearest of each query, under the total order (dist, cid)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """NEIGHBORS from (qid, cid, dist).

    Spark keeps k rows a query before the shuffle as well while k is at most
    spark.sql.optimizer.windowGroupLimitThreshold, 1000 by default.
    """
    order = Window.partitionBy("qid").orderBy("dist", "cid")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "cid", "dist")


def top_k_states(pairs: DataFrame, k: int) -> DataFrame:
    """TOPK_STATE from any (qid, cid, dist): the nested form, for merging."""
    return states(top_k(pairs, k), k)


def states(neighbors: DataFrame, k: int) -> DataFrame:
    """TOPK_STATE from a few rows (qid, cid, dist) a query, such as results over parts of a corpus, by one shuffle."""
    return neighbors.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "cid"))), 1, k).alias("topk"))


def merge_topk(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """States of the same queries over disjoint corpora, merged; a missing or empty state changes nothing."""
    both = a.unionByName(b).groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list("topk"))).alias("topk"))
    return both.withColumn("topk", F.slice("topk", 1, k))


def to_neighbors(states: DataFrame) -> DataFrame:
    """NEIGHBORS from TOPK_STATE."""
    return states.select("qid", F.posexplode("topk")).select("qid", (F.col("pos") + 1).alias("rank"), F.col("col.cid").alias("cid"), F.col("col.dist").alias("dist"))
