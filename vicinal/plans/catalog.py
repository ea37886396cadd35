"""The registered queries and the SQL they are held against."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn, matrix, partition, report, verify
from ..schema import NEIGHBORS, RUNS, Options
from ..sources import points as P
from . import runs as R

K = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.points_from_parquet(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", "label")


def shown(neighbors: DataFrame) -> DataFrame:
    return neighbors.select("qid", "rank", "cid", F.round("dist", 6).alias("dist"))


# -- the join ----------------------------------------------------------------------------------
_DIST = "list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def knn_sql(k: int = K, v: str = "embedding::DOUBLE[]", where: str = "true", pair: str = "true", dist: str = _DIST, source: str = "embeddings", idx: str = "vec_id") -> str:
    return f"""WITH p AS (SELECT {idx} AS vec_id, {v} AS v FROM {source} WHERE {where}),
 dd AS (SELECT a.vec_id AS qid, b.vec_id AS cid, {dist} AS dist FROM p a, p b WHERE {pair})
SELECT qid, CAST(rank AS INT) AS rank, cid, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM dd) WHERE rank <= {k}"""


def _self_join(strategy: str, **more):
    return lambda spark, sf_dir: shown(knn.knn_join(embeddings(spark, sf_dir), k=K, strategy=strategy, **more))


for _name, _strategy in (("self_join", "auto"), ("expr", "expr"), ("hof", "hof"), ("gemm", "gemm"), ("heap", "heap")):
    query(f"knn_{_name}", knn_sql())(_self_join(_strategy))
query("knn_blocked", knn_sql())(_self_join("blocked", options=Options(block_rows=300)))
query("knn_gemm_in_parts", knn_sql())(_self_join("gemm", options=Options(part_bytes_limit=100_000)))
query("knn_exclude_self", knn_sql(pair="a.vec_id <> b.vec_id"))(_self_join("gemm", exclude_self=True))
query("knn_dim_prefix", knn_sql(v="(embedding::DOUBLE[])[1:8]"))(_self_join("expr", d_limit=8))
query("knn_row_limit", knn_sql(where="vec_id < 200"))(_self_join("gemm", n_limit=200))


@query("knn_query_corpus", knn_sql(pair="a.vec_id < (SELECT count(*) / 5 FROM embeddings)"))
def knn_query_corpus(spark, sf_dir):
    corpus = embeddings(spark, sf_dir)
    return shown(knn.knn_join(corpus.where(F.col("idx") < F.lit(corpus.count() / 5)), corpus, K))


@query("knn_row_range", knn_sql(where="vec_id >= 50 AND vec_id < 150"))
def knn_row_range(spark, sf_dir):
    return shown(knn.knn_join(P.rows_between(embeddings(spark, sf_dir), 50, 150), k=K))


@query("knn_self_last", knn_sql(k=1000, dist=f"CASE WHEN a.vec_id = b.vec_id THEN 1.7976931348623157e308 ELSE {_DIST} END").replace("round(dist, 6)", "CASE WHEN dist < 1e300 THEN round(dist, 6) END"))
def knn_self_last(spark, sf_dir):
    found = knn.knn_join(embeddings(spark, sf_dir), k=1000, self_last=True)
    return found.select("qid", "rank", "cid", F.when(F.col("dist") < 1e300, F.round("dist", 6)).alias("dist"))


@query("knn_k_clamped", knn_sql(k=1000))
def knn_k_clamped(spark, sf_dir):
    return shown(knn.knn_join(embeddings(spark, sf_dir), k=1000))


@query("knn_numeric_columns", knn_sql(v="[p_size::DOUBLE, p_retailprice::DOUBLE]", source="part", idx="p_partkey"))
def knn_numeric_columns(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return shown(knn.knn_join(P.points_from_columns(part, "p_partkey", ["p_size", "p_retailprice"]), k=K))


_LABELS = f"""WITH n AS ({knn_sql()})
SELECT n.qid, CAST(q.label AS VARCHAR) AS query_label, n.rank, n.cid, CAST(c.label AS VARCHAR) AS label, n.dist
FROM n JOIN embeddings q ON q.vec_id = n.qid JOIN embeddings c ON c.vec_id = n.cid"""


@query("knn_labels", _LABELS)
def knn_labels(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return report.with_labels(shown(knn.knn_join(points, k=K)), points, points)


@query("knn_report", f"SELECT * FROM ({_LABELS}) WHERE qid < 10 AND rank <= 5")
def knn_report(spark, sf_dir):
    return report.extract(knn_labels(spark, sf_dir))


# -- partitions --------------------------------------------------------------------------------
@query("knn_merge_partitions", knn_sql())
def knn_merge_partitions(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    n, size = points.count(), knn.bytes_of(points)
    results = [partition.Result(knn.knn_join(points, P.rows_between(points, *y), K, corpus_bytes=size), (0, n), y, K) for y in partition.edges(n, 4)]
    return shown(partition.merge(results).neighbors)


@query("knn_concat_queries", knn_sql())
def knn_concat_queries(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    n, size = points.count(), knn.bytes_of(points)
    results = [partition.Result(knn.knn_join(P.rows_between(points, *x), points, K, corpus_bytes=size), x, (0, n), K) for x in partition.edges(n, 3)]
    return shown(partition.concat(results).neighbors)


_BOUNDS = """SELECT CAST(i AS INT) AS part, CAST(i * n // 7 AS BIGINT) AS x_start, CAST((i + 1) * n // 7 AS BIGINT) AS x_end
FROM (SELECT count(*) AS n FROM orders), generate_series(0, 6) t(i)"""


@query("partition_bounds", _BOUNDS)
def partition_bounds(spark, sf_dir):
    return partition.bounds(spark, spark.read.parquet(f"{sf_dir}/orders.parquet").count(), 7)


@query("partition_sizes", """WITH o AS (SELECT c_custkey AS i, count(*) OVER () AS n FROM customer)
SELECT CAST(((i + 1) * 7 - 1) // n AS INT) AS part, count(*) AS n FROM o GROUP BY 1""")
def partition_sizes(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = customers.count()
    return customers.groupBy(partition.part_of(F.col("c_custkey"), n, 7).alias("part")).agg(F.count("*").alias("n"))


@query("partition_gap_check", f"""WITH b AS ({_BOUNDS}), r AS (SELECT x_start + CASE WHEN part = 3 THEN 2 ELSE 0 END AS x_start, x_end FROM b)
SELECT * FROM (SELECT x_start, x_end, lag(x_end) OVER (ORDER BY x_start, x_end) AS before FROM r) WHERE before <> x_start""")
def partition_gap_check(spark, sf_dir):
    ranges = partition_bounds(spark, sf_dir)
    return partition.gaps(ranges.select((F.col("x_start") + F.when(F.col("part") == 3, 2).otherwise(0)).alias("x_start"), "x_end"))


@query("ranges_overlap", f"""WITH b AS ({_BOUNDS}) SELECT a.part AS a, c.part AS b, a.x_start < c.x_end AND c.x_start < a.x_end AS overlap FROM b a, b c""")
def ranges_overlap(spark, sf_dir):
    a = partition_bounds(spark, sf_dir).select(F.col("part").alias("a"), F.col("x_start").alias("a0"), F.col("x_end").alias("a1"))
    b = partition_bounds(spark, sf_dir).select(F.col("part").alias("b"), F.col("x_start").alias("b0"), F.col("x_end").alias("b1"))
    return a.crossJoin(b).select("a", "b", V.ranges_overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("overlap"))


# -- vectors -----------------------------------------------------------------------------------
@query("sq_norms", "SELECT vec_id AS idx, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS sq_norm FROM embeddings")
def sq_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select("idx", F.round(V.sq_norm(F.col("v")), 6).alias("sq_norm"))


def _asked(spark, sf_dir):
    """The query set of results that have a row for each pair: the ids divisible by 20, against all rows."""
    return embeddings(spark, sf_dir).where("idx % 20 = 0")


def _pairs(spark, sf_dir):
    q, c = _asked(spark, sf_dir), embeddings(spark, sf_dir)
    return q.select(F.col("idx").alias("qid"), F.col("v").alias("x")).crossJoin(c.select(F.col("idx").alias("cid"), F.col("v").alias("y")))


_PAIRS_SQL = "WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS qid, b.vec_id AS cid, {} FROM p a, p b WHERE a.vec_id % 20 = 0"


@query("dot_products", _PAIRS_SQL.format("round(list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])), 6) AS dot"))
def dot_products(spark, sf_dir):
    return _pairs(spark, sf_dir).select("qid", "cid", F.round(V.dot(F.col("x"), F.col("y")), 6).alias("dot"))


@query("pairwise_sq_dist", _PAIRS_SQL.format(f"round({_DIST}, 6) AS dist"))
def pairwise_sq_dist(spark, sf_dir):
    return _pairs(spark, sf_dir).select("qid", "cid", F.round(V.sq_l2_expr(F.col("x"), F.col("y"), 64), 6).alias("dist"))


@query("pairwise_expanded", _PAIRS_SQL.format(f"round({_DIST}, 6) AS dist"))
def pairwise_expanded(spark, sf_dir):
    return matrix.sq_distances(_asked(spark, sf_dir), embeddings(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query("matrix_product", """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT a.vec_id AS qid, b.vec_id AS cid, round(sum(a.x * b.x), 6) AS dot FROM e a JOIN e b ON a.j = b.j WHERE a.vec_id % 20 = 0 GROUP BY 1, 2""")
def matrix_product(spark, sf_dir):
    return matrix.matrix_product(_asked(spark, sf_dir), embeddings(spark, sf_dir)).withColumn("dot", F.round("dot", 6))


@query("flat_matrix", "SELECT vec_id * 64 + generate_subscripts(embedding, 1) - 1 AS flat_idx, unnest(embedding::DOUBLE[]) AS value FROM embeddings")
def flat_matrix(spark, sf_dir):
    return report.flat_matrix(embeddings(spark, sf_dir), 64)


_PICTURES = """SELECT vec_id AS idx, array_to_string(list_transform(range(0, 8), lambda r: array_to_string(list_transform(embedding[r * 8 + 1 : r * 8 + 8],
 lambda x: printf('%3d', CAST(trunc(x::DOUBLE * 3000) AS INT))), ' ')), chr(10)) AS picture FROM embeddings"""


def _pictured(spark, sf_dir):
    """Points with coordinates of up to four digits, to be shown as 8 by 8 pictures."""
    return embeddings(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x * 3000))


@query("render_vector_grid", _PICTURES)
def render_vector_grid(spark, sf_dir):
    return report.render(_pictured(spark, sf_dir), 8)


@query("neighbor_pictures", f"""WITH n AS ({knn_sql()}), s AS ({_PICTURES})
SELECT n.*, q.picture AS query_picture, c.picture FROM n JOIN s q ON q.idx = qid JOIN s c ON c.idx = cid WHERE qid < 10 AND rank <= 5""")
def neighbor_pictures(spark, sf_dir):
    found = report.extract(shown(knn.knn_join(embeddings(spark, sf_dir), k=K)))
    return report.with_pictures(found, _pictured(spark, sf_dir), _pictured(spark, sf_dir), 8)


@query("packet_summary", """SELECT *, format('{}->{} | n: {} d: {}', x_start, x_end, n, d) AS text FROM
 (SELECT min(vec_id) AS x_start, max(vec_id) + 1 AS x_end, count(*) AS n, CAST(max(len(embedding)) AS INT) AS d FROM embeddings)""")
def packet_summary(spark, sf_dir):
    return report.summary(embeddings(spark, sf_dir))


@query("result_summary", "SELECT 'X:0->' || count(*) || ' | Y:0->' || count(*) AS text FROM embeddings")
def result_summary(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return report.result_summary(knn.knn_join(points, k=1), 0, points.count())


# -- generators and text -----------------------------------------------------------------------
@query("regular_grid", "SELECT i AS idx, CAST(i % 4 AS DOUBLE) AS x0, CAST(i // 4 % 4 AS DOUBLE) AS x1, CAST(i // 16 % 4 AS DOUBLE) AS x2 FROM range(64) t(i)")
def regular_grid(spark, sf_dir):
    return P.regular_grid(spark, 4, 3)[1].select("idx", *[V.element(F.col("v"), c).alias(f"x{c}") for c in range(3)])


@query("grid_neighbor_counts", """SELECT q AS qid, CAST(r AS INT) AS r, CAST([1, 6, 12, 8][r + 1] AS BIGINT) AS n FROM range(5) a(q), range(4) b(r)""")
def grid_neighbor_counts(spark, sf_dir):
    queries, corpus, k = P.regular_grid(spark, 5, 3, m=5)
    return verify.neighbor_counts(knn.knn_join(queries, corpus, k))


def _random_sql(side: int, rows: int, d: int, seed: int) -> str:
    x = [f"(i % 2147483647 * 48271 + {(c * 69621 + seed * 16807 + side * 40692 + 1) % 2147483647}) % 2147483647" for c in range(d)]
    return f"SELECT i AS idx, [" + ", ".join(f"CAST((({h}) * ({h}) % 2147483647 * 39373 + ({h})) % 2147483647 % 1000 AS DOUBLE)" for h in x) + f"] AS v FROM range({rows}) t(i)"


@query("random_grid", f"SELECT idx, v[1] AS x0, v[2] AS x1, v[3] AS x2, v[4] AS x3 FROM ({_random_sql(1, 500, 4, 42)})")
def random_grid(spark, sf_dir):
    return P.random_grid(spark, 0, 500, 4, 42)[1].select("idx", *[V.element(F.col("v"), c).alias(f"x{c}") for c in range(4)])


@query("random_grid_join", f"""WITH q AS ({_random_sql(0, 100, 4, 42)}), p AS ({_random_sql(1, 500, 4, 42)}),
 dd AS (SELECT a.idx AS qid, b.idx AS cid, {_DIST} AS dist FROM q a, p b)
SELECT qid, CAST(rank AS INT) AS rank, cid, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM dd) WHERE rank <= 9""")
def random_grid_join(spark, sf_dir):
    return shown(knn.knn_join(*P.random_grid(spark, 100, 500, 4, 42), 9))


@query("sequential_points", "SELECT i AS idx, i * 6.0::DOUBLE AS first, i * 6.0::DOUBLE + 5 AS last, 6 AS d FROM range(10, 200) t(i)")
def sequential_points(spark, sf_dir):
    points = P.sequential_points(spark, 10, 200, 6)
    return points.select("idx", V.element(F.col("v"), 0).alias("first"), V.element(F.col("v"), 5).alias("last"), F.size("v").alias("d"))


_WHOLE = "list_transform(embedding, lambda x: floor(x::DOUBLE * 1000))"


@query("vector_to_csv_lines", f"SELECT vec_id AS idx, label || ',' || array_to_string({_WHOLE}, ',') AS value FROM embeddings")
def vector_to_csv_lines(spark, sf_dir):
    """Whole numbers, as other fractions are written otherwise by other engines."""
    points = embeddings(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.floor(x * 1000).cast("double")))
    return P.csv_lines(points, labelled=True)


@query("csv_lines_to_vector", "SELECT vec_id AS idx, CAST(label AS VARCHAR) AS label, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings")
def csv_lines_to_vector(spark, sf_dir):
    """All coordinates, written in full precision and read back."""
    label, v = P.parsed(F.col("value"), labelled=True, d=None)
    lines = P.csv_lines(embeddings(spark, sf_dir), labelled=True)
    return lines.select("idx", label.alias("label"), F.posexplode(v).alias("j", "x"))


@query("csv_file_round_trip", """SELECT vec_id AS idx, CAST(label AS VARCHAR) AS label, generate_subscripts(embedding[1:48], 1) - 1 AS j, unnest((embedding::DOUBLE[])[1:48]) AS x
FROM embeddings WHERE vec_id >= 20 AND vec_id < (SELECT count(*) - 30 FROM embeddings)""")
def csv_file_round_trip(spark, sf_dir):
    """Points written as text files with a header each, and a row range and prefix of them scanned again."""
    points = embeddings(spark, sf_dir)
    folder = P.scratch_folder(spark) + "/points"
    P.write_points_csv(points, folder, 64, labelled=True, mode="overwrite")
    found = P.read_points_csv(spark, folder, labelled=True, start=20, n=points.count() - 30, d=48)
    return found.select("idx", "label", F.posexplode("v").alias("j", "x"))


@query("csv_file_join", knn_sql(v="(embedding::DOUBLE[])[1:16]", pair="a.vec_id < 100 AND b.vec_id >= 100"))
def csv_file_join(spark, sf_dir):
    """Queries and corpus loaded from row ranges of one set of text files, then joined."""
    points = embeddings(spark, sf_dir)
    folder = P.scratch_folder(spark) + "/points"
    P.write_points_csv(points, folder, 64, labelled=True, mode="overwrite")
    n = points.count()
    return shown(knn.knn_join(*P.load(spark, folder, 0, 100, folder, 100, n, 16, labelled=True), K))


@query("csv_element_types", """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS as_float, CAST(c_nationkey AS DOUBLE) AS as_int FROM customer""")
def csv_element_types(spark, sf_dir):
    """Columns written as text files, scanned as single-precision and as whole numbers."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    folder, read = P.scratch_folder(spark), []
    for name, column in (("float", "c_acctbal"), ("int", "c_nationkey")):
        lines = customers.select(F.col("c_custkey").cast("long").alias("idx"), F.lit(None).cast("string").alias("label"), F.array(F.col(column)).alias("v"))
        P.write_points_csv(lines, f"{folder}/{name}", 1)
        read.append(P.read_points_csv(spark, f"{folder}/{name}", d=1, element_type=name).select("idx", V.element(F.col("v"), 0).alias(f"as_{name}")))
    return read[0].join(read[1], "idx")


@query("neighbors_csv", knn_sql())
def neighbors_csv(spark, sf_dir):
    """The result of a join, written as text files and read back."""
    folder = P.scratch_folder(spark) + "/neighbors"
    shown(knn.knn_join(embeddings(spark, sf_dir), k=K)).write.csv(folder, header=True)
    return spark.read.schema(NEIGHBORS).csv(folder, header=True)


@query("command_line", f"""WITH p AS (SELECT i AS vec_id, [CAST(i % 4 AS DOUBLE), CAST(i // 4 % 4 AS DOUBLE), CAST(i // 16 AS DOUBLE)] AS v FROM range(64) t(i) WHERE i < 50),
 dd AS (SELECT a.vec_id AS qid, b.vec_id AS cid, {_DIST} AS dist FROM p a, p b)
SELECT qid, CAST(rank AS INT) AS rank, cid, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM dd) WHERE rank <= 6""")
def command_line(spark, sf_dir):
    """A grid generated and joined with itself by the command line."""
    from .. import __main__ as cli

    folder = P.scratch_folder(spark)
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["generate", "-f", f"{folder}/grid", "-g", "regular", "-s", "4", "-d", "3", "-l"])
        cli.main(["query", "-f", f"{folder}/grid", "-n", "50", "-d", "3", "-k", "6", "-l", "--out", f"{folder}/found"])
    return spark.read.parquet(f"{folder}/found")


@query("label_split", """SELECT c_custkey AS idx, split_part(line, ',', 1) AS label, CASE WHEN contains(line, ',') THEN substr(line, instr(line, ',') + 1) ELSE line END AS rest
FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',' || c_nationkey || ',' || c_custkey END AS line FROM customer)""")
def label_split(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(","), F.col("c_nationkey").cast("string"), F.lit(","), F.col("c_custkey").cast("string")))
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("idx"), F.concat("c_mktsegment", tail).alias("line"))
    comma = F.instr("line", ",")
    rest = F.when(comma > 0, F.expr("substring(line, instr(line, ',') + 1)")).otherwise(F.col("line"))
    return lines.select("idx", F.substring_index("line", ",", 1).alias("label"), rest.alias("rest"))


@query("parse_numbers", """SELECT o_orderkey AS idx, coalesce(try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE), 0.0::DOUBLE) AS x FROM orders""")
def parse_numbers(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("line"))
    return lines.select("idx", V.element(P.parsed(F.col("line"), False, None, bad_value="zero")[1], 0).alias("x"))


# -- checks ------------------------------------------------------------------------------------
@query("compare_results", "SELECT vec_id AS qid, true AS same FROM embeddings")
def compare_results(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    return verify.compare(knn.knn_join(points, k=K, strategy="expr"), knn.knn_join(points, k=K, strategy="gemm"))


@query("compare_neighbors", "SELECT vec_id AS qid, vec_id >= 7 AS same FROM embeddings")
def compare_neighbors(spark, sf_dir):
    points = embeddings(spark, sf_dir)
    found = knn.knn_join(points, k=K)
    return verify.same_neighbors(found, found.withColumn("cid", F.when(F.col("qid") < 7, F.col("cid") + 1).otherwise(F.col("cid"))))


# -- timing runs -------------------------------------------------------------------------------
def _runs(spark, sf_dir):
    """Runs made of the line items: 4 numbers of processors, 3 of points, 3 of coordinates."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.lit("run").alias("base_command"), F.lit("points").alias("dataset"), (F.col("l_orderkey") % 4 + 1).cast("int").alias("num_processors"),
        F.element_at(F.array(F.lit(300), F.lit(3000), F.lit(30000)), (F.col("l_partkey") % 3 + 1).cast("int")).alias("n"),
        F.element_at(F.array(F.lit(16), F.lit(64), F.lit(256)), F.col("l_linenumber") % 3 + 1).alias("d"), F.lit(12).alias("k"), F.col("l_quantity").alias("time"),
    ).to(RUNS)


_RUNS = """runs AS (SELECT CAST(l_orderkey % 4 + 1 AS INT) AS num_processors, [300, 3000, 30000][l_partkey % 3 + 1] AS n, [16, 64, 256][l_linenumber % 3 + 1] AS d,
 12 AS k, l_quantity AS time FROM lineitem), ref AS (SELECT n, d, avg(time) AS ref_time FROM runs WHERE num_processors = 1 GROUP BY n, d),
 s AS (SELECT runs.*, ref_time, ref_time / time AS speedup FROM runs JOIN ref USING (n, d))"""


@query("bench_speedup", f"WITH {_RUNS} SELECT n, d, num_processors, time, round(ref_time, 6) AS ref_time, round(speedup, 6) AS speedup FROM s")
def bench_speedup(spark, sf_dir):
    return R.with_speedup(_runs(spark, sf_dir)).select("n", "d", "num_processors", "time", F.round("ref_time", 6).alias("ref_time"), F.round("speedup", 6).alias("speedup"))


@query("bench_mean", f"WITH {_RUNS} SELECT n, d, num_processors, avg(k) AS k, round(avg(time), 6) AS time, round(avg(ref_time), 6) AS ref_time, round(avg(speedup), 6) AS speedup FROM s GROUP BY n, d, num_processors")
def bench_mean(spark, sf_dir):
    return R.averaged(R.with_speedup(_runs(spark, sf_dir))).select("n", "d", "num_processors", "k", *[F.round(c, 6).alias(c) for c in ("time", "ref_time", "speedup")])


@query("bench_speedup_plot", f"WITH {_RUNS} SELECT n, num_processors, round(avg(speedup), 6) AS speedup FROM s GROUP BY n, num_processors")
def bench_speedup_plot(spark, sf_dir):
    return R.plotted(R.with_speedup(_runs(spark, sf_dir)), "n", "speedup", "num_processors").withColumn("speedup", F.round("speedup", 6))


@query("bench_time_plot", f"WITH {_RUNS} SELECT n, d, round(avg(time), 6) AS time FROM runs WHERE num_processors = 4 GROUP BY n, d")
def bench_time_plot(spark, sf_dir):
    return R.plotted(_runs(spark, sf_dir).where("num_processors = 4"), "n", "time", "d").withColumn("time", F.round("time", 6))


@query("bench_param_grid", """SELECT p AS num_processors, n, d, k FROM (VALUES (2), (8)) a(p), (VALUES (12), (2000)) b(n), (VALUES (6), (24), (48), (64)) c(d), (VALUES (3), (12)) e(k) WHERE n > k""")
def bench_param_grid(spark, sf_dir):
    return R.grid(spark, [2, 8], [12, 2000], [6, 24, 48, 64], [3, 12])


@query("bench_parse_time", """SELECT event_id, regexp_extract(line, 'Total time: (\\d+\\.?\\d*)', 1) AS captured
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'Total time: ' || event_id || '.25 ms' END AS line FROM events)""")
def bench_parse_time(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 4 == 0, "failed").otherwise(F.concat(F.lit("Total time: "), F.col("event_id").cast("string"), F.lit(".25 ms")))
    return R.parse_time(events.select("event_id", line.alias("line"))).select("event_id", "captured")


@query("bench_log", f"WITH {_RUNS} SELECT n, d, num_processors, count(*) AS runs, round(avg(speedup), 6) AS speedup FROM s GROUP BY n, d, num_processors")
def bench_log(spark, sf_dir):
    """Runs written to a log and read from it."""
    path = P.scratch_folder(spark) + "/runs"
    R.write_runs(_runs(spark, sf_dir), path)
    found = R.with_speedup(R.read_runs(spark, path)).groupBy("n", "d", "num_processors")
    return found.agg(F.count("*").alias("runs"), F.round(F.avg("speedup"), 6).alias("speedup"))


@query("bench_milliseconds", "SELECT event_id, event_id * 250000 / 1000000 AS ms FROM events")
def bench_milliseconds(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", R.milliseconds(F.col("event_id") * 250_000).alias("ms"))
