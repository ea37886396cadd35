"""Table schemas and options of the nearest-neighbour engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: idx: 0-based row number; label: may be null; v: the coordinates.
POINTS = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("v", T.ArrayType(T.DoubleType())),
])

#: dist is the squared Euclidean distance; rank starts at 1.
NEIGHBORS = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("cid", T.LongType()),
    T.StructField("dist", T.DoubleType()),
])

#: Partial results of one query, ascending by (dist, cid).
TOPK_STATE = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("topk", T.ArrayType(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("cid", T.LongType())]))),
])

# The columns of a log of timing runs, which existing logs have; time is in milliseconds.
RUNS = T.StructType([
    T.StructField("base_command", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("num_processors", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("d", T.IntegerType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("time", T.DoubleType()),
])

#: Types of coordinates in text files; all are widened to double.
ELEMENT_TYPES = {"int": "int", "size_t": "bigint", "float": "float", "double": "double"}


@dataclass(frozen=True)
class Options:
    """part_bytes_limit: bytes of one block of distances; broadcast_bytes: bytes of coordinates up to
    which a corpus is sent whole to each executor; block_rows: rows of a packed block beyond that."""

    part_bytes_limit: int = 64_000_000
    broadcast_bytes: int = 64_000_000
    block_rows: int = 2_000
