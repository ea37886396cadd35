"""Checks of results against one another and against what a grid must give."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """(qid, same): whether both results have the same neighbours at the same ranks and distances."""
    x = a.select("qid", "rank", "cid", F.round("dist", digits).alias("dist"), F.lit(1).alias("side"))
    y = b.select("qid", "rank", "cid", F.round("dist", digits).alias("dist"), F.lit(-1).alias("side"))
    rows = x.unionByName(y).groupBy("qid", "rank", "cid", "dist").agg(F.sum("side").alias("n"))
    return rows.groupBy("qid").agg(F.every(F.col("n") == 0).alias("same"))


def same_neighbors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, same): whether both results name the same corpus rows, in any order."""
    rows = a.select("qid", "cid", F.lit(1).alias("side")).unionByName(b.select("qid", "cid", F.lit(-1).alias("side")))
    return rows.groupBy("qid", "cid").agg(F.sum("side").alias("n")).groupBy("qid").agg(F.every(F.col("n") == 0).alias("same"))


def all_same(a: DataFrame, b: DataFrame) -> bool:
    return compare(a, b).where("not same").isEmpty()


def neighbor_counts(neighbors: DataFrame) -> DataFrame:
    """(qid, r, n): how many neighbours stand at each whole squared distance."""
    return neighbors.groupBy("qid", F.col("dist").cast("int").alias("r")).agg(F.count("*").alias("n"))


def expected_counts(spark: SparkSession, d: int) -> DataFrame:
    """(r, n): a grid's interior point has C(d, r) 2^r neighbours at squared distance r."""
    return spark.createDataFrame([(r, comb(d, r) * 2**r) for r in range(d + 1)], "r int, n long")
