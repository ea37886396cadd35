"""Timing runs: their parameters, their log, and speedups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RUNS

# Fixed value: how existing programs print their time.
TIME = r"Total time: (\d+\.?\d*)"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).csv(path, header=True)


def write_runs(runs: DataFrame, path: str, mode: str = "error") -> None:
    runs.write.mode(mode).csv(path, header=True)


def grid(spark: SparkSession, processors: list[int], ns: list[int], ds: list[int], ks: list[int]) -> DataFrame:
    """All combinations of the parameters that leave more points than neighbours."""
    lists = {"num_processors": processors, "n": ns, "d": ds, "k": ks}
    every = spark.range(1).select()
    for c, values in lists.items():
        every = every.select("*", F.explode(F.array(*map(F.lit, values))).alias(c))
    return every.where("n > k")


def parse_time(lines: DataFrame, column: str = "line") -> DataFrame:
    """captured: the time in a line of output as text, '' if there is none."""
    return lines.withColumn("captured", F.regexp_extract(column, TIME, 1))


def milliseconds(nanoseconds):
    return nanoseconds / F.lit(1_000_000.0)


def with_speedup(runs: DataFrame) -> DataFrame:
    """Runs with ref_time, the mean time of one processor for the same n and d, and speedup."""
    one = runs.where("num_processors = 1").groupBy("n", "d").agg(F.avg("time").alias("ref_time"))
    return runs.join(one, ["n", "d"]).withColumn("speedup", F.col("ref_time") / F.col("time"))


def averaged(runs: DataFrame) -> DataFrame:
    """Means of the numeric columns by n, d and num_processors."""
    return runs.groupBy("n", "d", "num_processors").agg(*[F.avg(c).alias(c) for c in ("k", "time", "ref_time", "speedup")])


def plotted(runs: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """The points of a line plot: the mean of y for each x and hue."""
    return runs.groupBy(x, hue).agg(F.avg(y).alias(y))
