"""Row ranges: how they divide a table, and how results over ranges are combined."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .topk import states, to_neighbors


@dataclass(frozen=True)
class Result:
    """The `k` nearest neighbours (NEIGHBORS) of the queries x[0] to x[1] among the corpus rows y[0] to
    y[1], ends exclusive.  y may wrap around: from y[0] to the end and on from 0 to y[1]."""

    neighbors: DataFrame
    x: tuple[int, int]
    y: tuple[int, int]
    k: int


def part_of(idx: Column, n: int, parts: int) -> Column:
    """Number of the even range [i n / parts, (i + 1) n / parts) that holds idx."""
    return F.floor(((idx + 1) * parts - 1) / F.lit(n)).cast("int")


def edges(n: int, parts: int) -> list[tuple[int, int]]:
    """The even ranges of n rows."""
    return [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


def bounds(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(part, x_start, x_end) of all even ranges of n rows."""
    i = F.col("id")
    return spark.range(parts).select(i.cast("int").alias("part"), F.floor(i * n / parts).alias("x_start"), F.floor((i + 1) * n / parts).alias("x_end"))


def gaps(ranges: DataFrame) -> DataFrame:
    """The ranges (x_start, x_end) that don't start where the one before them ended."""
    before = F.lag("x_end").over(Window.orderBy("x_start", "x_end"))
    return ranges.withColumn("before", before).where("before <> x_start")


def combinable_same_x(a: Result, b: Result) -> bool:
    """Whether two results answer the same queries."""
    return a.x == b.x


def combinable_same_y(a: Result, b: Result) -> bool:
    """Whether the queries of two results can stand in one: both have the same k and the same corpus rows,
    or one's corpus range has come round to where it began, which is the whole corpus."""
    whole = any(r.y[0] == r.y[1] for r in (a, b))
    return a.k == b.k and (whole or a.y == b.y)


def concat(results: list[Result]) -> Result:
    """Results of adjoining query ranges as one, in any order.

    Only the ranges are looked at, so no join runs for it.  An error if queries are missing between
    two results, if two share queries, or if their neighbours aren't comparable.
    """
    if not results:
        raise ValueError("nothing to combine")
    ordered = sorted(results, key=lambda r: r.x)
    for a, b in zip(ordered, ordered[1:]):
        if a.x[1] != b.x[0]:
            raise ValueError(f"queries {a.x} and {b.x} don't adjoin")
        if not combinable_same_y(a, b):
            raise ValueError(f"results with k = {a.k} over {a.y} and k = {b.k} over {b.y} can't stand together")
    return replace(ordered[0], neighbors=reduce(DataFrame.unionByName, [r.neighbors for r in ordered]), x=(ordered[0].x[0], ordered[-1].x[1]))


def merge(results: list[Result]) -> Result:
    """Results of the same queries over disjoint corpus ranges, each beginning where the one before it ended,
    as one over all of them."""
    if not results:
        raise ValueError("nothing to combine")
    first, last = results[0], results[-1]
    for a, b in zip(results, results[1:]):
        if not combinable_same_x(a, b):
            raise ValueError(f"results of the queries {a.x} and {b.x} can't be merged")
    every = reduce(DataFrame.unionByName, [r.neighbors for r in results])
    return replace(first, neighbors=to_neighbors(states(every, first.k)), y=(first.y[0], last.y[1]))
