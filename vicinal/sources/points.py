"""Points from text files, Parquet, columns and generators; points to text files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import ELEMENT_TYPES

# -- text --------------------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): the data lines of text files in order, from 0; each file's first line is a header.

    A line's number is the count of lines in the blocks before its own plus its place in the block.
    Only these counts, a row for each block of a file, are ordered; the lines stay where they are read.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    blocks = blocks.withColumn("n", F.col("n") - (F.col("block") == 0).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before)
    placed = lines.join(blocks, ["file", "block"]).withColumn("in_block", F.col("at") - F.col("first") - (F.col("block") == 0).cast("long"))
    # A header has no value even where Spark looks at it before the rows are filtered, so it can't raise errors.
    value = F.when(F.col("in_block") >= 0, F.col("value"))
    return placed.where("in_block >= 0").select((F.col("before") + F.col("in_block")).alias("idx"), value.alias("value"))


def parsed(line: Column, labelled: bool, d: int | None, element_type: str = "double", bad_value: str = "raise") -> tuple[Column, Column]:
    """(label, v) of a line of comma-separated fields.

    labelled: the first field is a label, and a line without a comma is label and only coordinate at
    once.  d: how many coordinates to keep.  bad_value: 'raise', or 'zero' for fields that are no number.
    """
    if element_type not in ELEMENT_TYPES:
        raise ValueError(f"element_type must be one of {sorted(ELEMENT_TYPES)}")
    if bad_value not in ("raise", "zero"):
        raise ValueError("bad_value must be 'raise' or 'zero'")
    fields = F.split(line, ",")
    values = F.when(F.size(fields) > 1, F.slice(fields, 2, F.size(fields))).otherwise(fields) if labelled else fields
    kind = ELEMENT_TYPES[element_type]
    as_number = lambda x: F.trim(x).try_cast(kind).cast("double")
    other = lambda x: F.lit(0.0) if bad_value == "zero" else F.raise_error(F.concat(F.lit("not a number: "), x)).cast("double")
    v = F.transform(V.dims(values, d), lambda x: F.coalesce(as_number(x), other(x)))
    return (F.get(fields, F.lit(0)) if labelled else F.lit(None).cast("string")), v


def read_points_csv(
    spark: SparkSession, path: str, *, labelled: bool = False, n: int | None = None, start: int = 0, d: int | None = None, element_type: str = "double",
    bad_value: str = "raise",
) -> DataFrame:
    """POINTS from text files with a header line: rows start to n (at most), the first d coordinates.

    Rows with another number of coordinates than d, or than the other rows, raise an error.
    """
    lines = rows_between(numbered_lines(spark, path), start, n)
    label, v = parsed(F.col("value"), labelled, d, element_type, bad_value)
    return same_length(lines.select("idx", label.alias("label"), v.alias("v")), d)


def same_length(points: DataFrame, d: int | None = None) -> DataFrame:
    """`points`, with an error where a vector hasn't d coordinates (d None: as many as the shortest)."""
    if d is None:
        d = points.agg(F.min(F.size("v"))).first()[0] or 0
    wrong = F.raise_error(F.format_string("a row has %d coordinates, not %d", F.size("v"), F.lit(d))).cast("array<double>")
    return points.withColumn("v", F.when(F.col("v").isNull() | (F.size("v") == d), F.col("v")).otherwise(wrong))


def rows_between(df: DataFrame, start: int = 0, end: int | None = None, column: str = "idx") -> DataFrame:
    """Rows numbered start to end, end exclusive; pushed down to Parquet."""
    df = df.where(F.col(column) >= start) if start else df
    return df if end is None else df.where(F.col(column) < end)


def csv_lines(points: DataFrame, labelled: bool = False) -> DataFrame:
    """(idx, value): one line a point, in full precision."""
    fields = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    return points.select("idx", F.concat_ws(",", F.coalesce("label", F.lit("0")), fields).alias("value") if labelled else fields.alias("value"))


def write_points_csv(points: DataFrame, path: str, d: int, *, labelled: bool = False, mode: str = "error") -> None:
    """Text files with a header each, in the order of idx, that `read_points_csv` reads again."""
    ordered = points.orderBy("idx")
    columns = [F.get("v", F.lit(j)).alias(f"x{j}") for j in range(d)]
    if labelled:
        columns = [F.coalesce("label", F.lit("0")).alias("label"), *columns]
    ordered.select(*columns).write.mode(mode).option("header", True).csv(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session without
    that setting gets a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/points-{uuid.uuid4().hex}"


# -- tables ------------------------------------------------------------------------------------


def points_from_parquet(spark: SparkSession, path: str, idx: str, v: str, label: str | None = None, *, d: int | None = None) -> DataFrame:
    return points_from(spark.read.parquet(path), idx, v, label, d=d)


def points_from(df: DataFrame, idx: str, v: str, label: str | None = None, *, d: int | None = None) -> DataFrame:
    """POINTS from an id column and an array column; coordinates are widened to double."""
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return df.select(F.col(idx).cast("long").alias("idx"), name.alias("label"), V.dims(F.col(v), d).cast("array<double>").alias("v"))


def points_from_columns(df: DataFrame, idx: str, columns: list[str], label: str | None = None) -> DataFrame:
    """POINTS whose coordinates are numeric columns."""
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return df.select(F.col(idx).cast("long").alias("idx"), name.alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


# -- generators --------------------------------------------------------------------------------


def _points(df: DataFrame, v: Column) -> DataFrame:
    return df.select(F.col("id").alias("idx"), F.lit(None).cast("string").alias("label"), v.alias("v"))


#: The prime 2^31 - 1; numbers below it can be multiplied without overflow.
_PRIME = 2_147_483_647


def _hashed(seed: int, side: int, d: int, m: int) -> Column:
    """d whole numbers below m for each (seed, side, id), by arithmetic that any SQL can repeat."""
    first = F.col("id") % _PRIME * 48_271 + (seed * 16_807 + side * 40_692 + 1)
    places = F.sequence(F.lit(0).cast("long"), F.lit(d - 1).cast("long"))
    mixed = F.transform(places, lambda c: (first + c * 69_621) % _PRIME)
    return F.transform(mixed, lambda x: (x * x % _PRIME * 39_373 + x) % _PRIME % m)


def regular_grid(spark: SparkSession, s: int, d: int, m: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(m random interior grid points as queries, all s^d grid points as corpus, 3^d).

    Coordinate c of a corpus point is digit c of its number in base s.  An interior point has 3^d
    corpus points within one step in each coordinate.
    """
    if m and s < 3:
        raise ValueError("a grid with fewer than 3 steps has no interior points")
    corpus = _points(spark.range(s**d), V.digits(F.col("id"), s, d))
    inner = F.transform(_hashed(seed, 0, d, max(1, s - 2)), lambda x: x + 1)
    return _points(spark.range(m), inner.cast("array<double>")), corpus, 3**d


def random_grid(spark: SparkSession, m: int, n: int, d: int, seed: int = 0, high: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(m queries, n corpus points) with whole-number coordinates from 0 to high - 1; the same for the
    same seed however they are partitioned."""
    side = lambda number, rows: _points(spark.range(rows), _hashed(seed, number, d, high).cast("array<double>"))
    return side(0, m), side(1, n)


def sequential_points(spark: SparkSession, start: int, end: int, d: int) -> DataFrame:
    """Points start to end whose coordinates count on from start * d."""
    first = F.col("id") * d
    return _points(spark.range(start, end), F.sequence(first, first + (d - 1)).cast("array<double>"))


def generate_points(spark: SparkSession, kind: str, d: int, *, n: int | None = None, s: int | None = None, seed: int = 0, labels: bool = False) -> DataFrame:
    """POINTS of a 'random' grid of n points or a 'regular' one of s^d; labels: each gets the label '0'."""
    if kind == "random" and n and d:
        points = random_grid(spark, 0, n, d, seed)[1]
    elif kind == "regular" and s and d:
        points = regular_grid(spark, s, d)[1]
    else:
        raise ValueError("kind must be 'random' with n and d, or 'regular' with s and d")
    return points.withColumn("label", F.lit("0")) if labels else points


def load(spark: SparkSession, query_path: str, q0: int, q1: int, corpus_path: str, c0: int, c1: int, d: int, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus) from row ranges of one or two text files."""
    read = lambda path, a, b: read_points_csv(spark, path, labelled=labelled, start=a, n=b, d=d)
    return read(query_path, q0, q1), read(corpus_path, c0, c1)
