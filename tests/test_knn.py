import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import Options, knn_join
from vicinal.operators import kernels, knn, matrix, partition, report, topk, verify
from vicinal.schema import POINTS
from vicinal.sources import points as P

STRATEGIES = ["expr", "hof", "gemm", "blocked", "heap"]


def points(spark, rows, first=0):
    return spark.createDataFrame([(first + i, None, [float(x) for x in r]) for i, r in enumerate(rows)], POINTS)


def brute(q, c, k, exclude=False, q0=0, c0=0):
    out = set()
    for i, x in enumerate(q):
        d = sorted((float(((np.array(x, float) - np.array(y, float)) ** 2).sum()), c0 + j) for j, y in enumerate(c) if not (exclude and c0 + j == q0 + i))
        out |= {(q0 + i, r + 1, j, round(v, 6)) for r, (v, j) in enumerate(d[:k])}
    return out


def rows(df):
    return {(r.qid, r.rank, r.cid, round(r.dist, 6)) for r in df.collect()}


TIED = np.random.default_rng(1).integers(0, 3, (60, 2))
SPREAD = np.random.default_rng(2).random((50, 5))


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("exclude", [False, True])
def test_ties_and_duplicates(spark, strategy, exclude):
    found = knn_join(points(spark, TIED), k=7, strategy=strategy, exclude_self=exclude, options=Options(block_rows=4, part_bytes_limit=500))
    assert rows(found) == brute(TIED, TIED, 7, exclude)


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("k", [1, 49, 50, 80])
def test_k_up_to_and_beyond_n(spark, strategy, k):
    found = knn_join(points(spark, SPREAD), k=k, strategy=strategy, options=Options(block_rows=9))
    assert rows(found) == brute(SPREAD, SPREAD, k)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_other_corpus(spark, strategy):
    found = knn_join(points(spark, SPREAD[:7], 20), points(spark, SPREAD[10:], 10), 3, strategy, exclude_self=True)
    assert rows(found) == brute(SPREAD[:7], SPREAD[10:], 3, True, 20, 10)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_empty_sides(spark, strategy):
    none, some = points(spark, []), points(spark, SPREAD[:3])
    assert rows(knn_join(none, some, 2, strategy)) == rows(knn_join(some, none, 2, strategy)) == set()


def test_limits_one_dimension_and_self_last(spark):
    p = points(spark, SPREAD)
    assert rows(knn_join(p, k=4, n_limit=20, d_limit=1)) == brute(SPREAD[:20, :1], SPREAD[:20, :1], 4)
    last = knn_join(p, k=50, self_last=True).where("rank = 50").collect()
    assert len(last) == 50 and all(r.qid == r.cid and r.dist > 1e300 for r in last)


def test_arguments(spark):
    p = points(spark, SPREAD)
    for bad in ({"k": 0}, {"strategy": "none"}, {"strategy": "gemm", "options": Options(broadcast_bytes=10)}):
        with pytest.raises(ValueError):
            knn_join(p, **{"k": 2} | bad)
    assert rows(knn_join(p, k=3, options=Options(broadcast_bytes=10, block_rows=7))) == brute(SPREAD, SPREAD, 3)


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 7])
def test_merging_parts_changes_nothing(spark, parts):
    p, merged = points(spark, SPREAD), None
    for i in range(parts):
        state = topk.top_k_states(knn_join(p, p.where(partition.part_of(p.idx, 50, parts) == i), 20), 20)
        merged = state if merged is None else topk.merge_topk(merged, state, 20)
    assert rows(topk.to_neighbors(merged)) == brute(SPREAD, SPREAD, 20)


def test_grid_counts(spark):
    for d in (1, 2, 3):
        q, c, k = P.regular_grid(spark, 5, d, m=4)
        found = verify.neighbor_counts(knn_join(q, c, k))
        want = {(r.r, r.n) for r in verify.expected_counts(spark, d).collect()}
        assert {(r.r, r.n) for r in found.collect()} == want


def test_concat_and_checks(spark):
    p = points(spark, SPREAD)
    part = lambda x, k=3, y=(0, 50): partition.Result(knn_join(P.rows_between(p, *x), p, k), x, y, k)
    a, b, c = part((0, 20)), part((20, 50)), part((25, 50))
    both = partition.concat([b, a])
    assert rows(both.neighbors) == brute(SPREAD, SPREAD, 3) and (both.x, both.y, both.k) == ((0, 50), (0, 50), 3)
    for bad in ([a, c], [b, c], [a, part((20, 50), k=2)], [a, part((20, 50), y=(0, 40))], []):
        with pytest.raises(ValueError):
            partition.concat(bad)
    assert partition.combinable_same_x(a, a) and not partition.combinable_same_x(a, b)
    assert partition.combinable_same_y(part((20, 50), y=(30, 30)), a) and not partition.combinable_same_y(part((20, 50), k=2), a)
    assert verify.all_same(a.neighbors, a.neighbors) and not verify.all_same(a.neighbors, b.neighbors)


def test_checks_run_no_join(spark):
    broken = points(spark, SPREAD).select("idx", F.raise_error(F.lit("ran")).cast("array<double>").alias("v"))
    found = [partition.Result(broken, x, (0, 50), 3) for x in partition.edges(50, 4)]
    assert partition.concat(found).x == (0, 50)


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_merging_results(spark, parts):
    p = points(spark, SPREAD)
    results = [partition.Result(knn_join(p, P.rows_between(p, *y), 20), (0, 50), y, 20) for y in partition.edges(50, parts)]
    merged = partition.merge(results)
    assert rows(merged.neighbors) == brute(SPREAD, SPREAD, 20) and merged.y == (0, 50)
    with pytest.raises(ValueError):
        partition.merge([results[0], partition.Result(results[0].neighbors, (0, 9), (50, 60), 20)])


def test_part_of_matches_edges(spark):
    for n, k in ((50, 7), (3, 5), (64, 8)):
        found = [r.p for r in spark.range(n).orderBy("id").select(partition.part_of(F.col("id"), n, k).alias("p")).collect()]
        assert found == [i for i, (a, b) in enumerate(partition.edges(n, k)) for _ in range(a, b)]


def test_reports(spark):
    p = points(spark, [[0.0, 300.7], [5.0, -2.5]])
    assert [r.picture for r in report.render(p, 1).orderBy("idx").collect()] == ["  0\n300", "  5\n -2"]
    wide = points(spark, [[1234.0, -100.9, 7.0]])
    assert report.render(wide, 2).first().picture == "1234 -100\n  7"
    shown = report.with_pictures(report.extract(knn_join(p, k=2)), p, p, 2).collect()
    assert {(r.qid, r.cid): (r.query_picture, r.picture) for r in shown}[0, 1] == ("  0 300", "  5  -2")
    assert report.summary(p).first().text == "0->2 | n: 2 d: 2"
    assert report.result_summary(knn_join(p, k=1), 0, 2).first().text == "X:0->2 | Y:0->2"


def test_matrix_product(spark):
    q, c = points(spark, SPREAD[:7], 20), points(spark, SPREAD)
    found = {(r.qid, r.cid): r.dot for r in matrix.matrix_product(q, c, Options(block_rows=9, part_bytes_limit=500)).collect()}
    want = {(20 + i, j): float(SPREAD[i] @ SPREAD[j]) for i in range(7) for j in range(50)}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in want)


def test_expanded_distances(spark):
    """By products of blocks, without norms for each pair."""
    q, c = points(spark, SPREAD[:7], 20), points(spark, SPREAD)
    found = matrix.sq_distances(q, c, Options(block_rows=9, part_bytes_limit=500))
    got = {(r.qid, r.cid): r.dist for r in found.collect()}
    want = {(20 + i, j): float(((SPREAD[i] - SPREAD[j]) ** 2).sum()) for i in range(7) for j in range(50)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 and got[p] >= 0 for p in want)


def test_vectors_of_several_lengths_raise(spark):
    ragged = spark.createDataFrame([(0, None, [1.0, 2.0]), (1, None, [1.0])], POINTS)
    for strategy in ("gemm", "blocked"):
        with pytest.raises(Exception, match="coordinates"):
            knn_join(ragged.coalesce(1), k=1, strategy=strategy).collect()


@pytest.mark.parametrize("strategy", ["gemm", "heap"])
@pytest.mark.parametrize("more", [{}, {"exclude_self": True}])
def test_a_corpus_in_parts(spark, strategy, more):
    """A corpus beyond broadcast_bytes is sent in parts, not refused."""
    for rows_, k in ((TIED, 7), (SPREAD, 50), (SPREAD, 20)):
        found = knn_join(points(spark, rows_), k=k, strategy=strategy, options=Options(broadcast_bytes=300, part_bytes_limit=2000), **more)
        assert rows(found) == brute(rows_, rows_, k, bool(more))


def test_many_neighbours_take_no_shuffle(spark, monkeypatch):
    monkeypatch.setattr(knn, "MANY", 40)
    found = knn_join(points(spark, SPREAD), k=40, options=Options(broadcast_bytes=300, block_rows=100))
    assert "Window" not in found._jdf.queryExecution().toString()
    assert rows(found) == brute(SPREAD, SPREAD, 40)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_self_last(spark, strategy):
    options = Options(broadcast_bytes=300 if strategy == "gemm" else 64_000_000, block_rows=9)
    for rows_, k in ((TIED, 7), (TIED, 60), (SPREAD, 50)):
        last = knn_join(points(spark, rows_), k=k, strategy=strategy, self_last=True, options=options)
        others = brute(rows_, rows_, k, True)
        assert rows(last.where("dist < 1e300")) == others
        own = last.where("dist > 1e300").collect()
        assert {(r.qid, r.cid, r.rank) for r in own} == ({(i, i, k) for i in range(len(rows_))} if k == len(rows_) else set())


def test_self_last_makes_no_cross_join_of_points(spark):
    assert "Join" not in knn_join(points(spark, SPREAD), k=5, self_last=True)._jdf.queryExecution().toString()


@pytest.mark.parametrize("d, k, self_dist", [(1, 3, None), (2, 5, None), (2, 5, np.inf), (3, 40, None), (2, 5000, np.inf), (2, 4, 1e300)])
def test_points_of_few_coordinates(d, k, self_dist):
    """Groups that are too far aren't looked at, and nothing is missed: ties, copies, far queries."""
    rng = np.random.default_rng(d + k)
    y = np.concatenate([rng.integers(0, 30, (2500, d)), rng.random((2500, d)) * [1000, 1, 7][:d]]).astype(float)
    yid = rng.permutation(5000)
    tree = kernels.Leaves.of(yid, y)
    looked, dense = [], kernels._dense
    at = rng.integers(0, 5000, 600)
    x, xid = np.concatenate([y[at], rng.random((4, d)) * 5000]), np.concatenate([yid[at], np.arange(5000, 5004)])
    whole = ((x[:, None] - y) ** 2).sum(axis=2)
    if self_dist is not None:
        whole[xid[:, None] == yid] = self_dist
    order = [np.lexsort((yid, v)) for v in whole]
    want = {i: yid[[c for c in o[:k] if whole[i, c] < np.inf]].tolist() for i, o in enumerate(order)}
    kernels._dense = lambda *a: looked.append(len(a[1]) * len(a[4])) or dense(*a)
    try:
        found = {i: [] for i in range(len(x))}
        for row, cid, _ in kernels.nearest(xid, x, yid, y, k, self_dist, 100_000, tree):
            for r, c in zip(row.tolist(), cid.tolist()):
                found[r].append(c)
    finally:
        kernels._dense = dense
    assert found == want
    assert k > 1000 or sum(looked) < len(x) * 5000 // 2


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("k", [1, 5, 300])
def test_proposed_pairs(k, own):
    """All that may be among the k nearest are proposed, ties included, and few others; copies and odd numbers too."""
    rng = np.random.default_rng(k)
    y = np.concatenate([rng.random((2000, 12)), rng.integers(0, 3, (400, 12)), np.tile(rng.random(12), (300, 1)), rng.random((100, 12)) * 1e6])
    yid = rng.permutation(len(y))
    at = rng.integers(0, len(y), 700)
    x, xid = y[at], yid[at]
    kept_id, kept = kernels.few_copies(yid, y, k + 1)
    assert len(kept) < len(y) or k >= 300
    reach, found = np.full(len(x), np.inf), set()
    for part in range(2):
        here = kept_id % 2 == part
        for i, j in kernels.proposed(xid, x, kept_id[here], kept[here], k, own, reach, 3_000_000):
            found |= set(zip(i.tolist(), kept_id[here][j].tolist()))
    whole = ((x[:, None] - y) ** 2).sum(axis=2)
    if not own:
        whole[xid[:, None] == yid] = np.inf
    want = {(i, c) for i, v in enumerate(whole) for c in yid[np.lexsort((yid, v))[:k]].tolist()}
    assert want <= found and len(found) < 6 * len(want) + 400 * len(x) // 10
    x[0], y[7] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        odd = [(i, j) for i, j in kernels.proposed(xid, x, yid, y, k, own, np.full(len(x), np.inf), 3_000_000)]
    i, j = map(np.concatenate, zip(*odd))
    assert (i == 0).sum() == len(y) and (j == 7).sum() == len(x)


def test_expressions_join_no_pairs(spark):
    """knn_expr: distances are computed for proposed pairs, not for all of a cross join, which would be sorted."""
    rng = np.random.default_rng(4)
    p = points(spark, np.concatenate([rng.random((1200, 8)), np.tile(rng.random(8), (200, 1))]))
    found = knn_join(p, k=5, strategy="expr")
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert knn._by_expression(p, [p], 5, "expr", False, False, Options()).count() < 7 * 1400
    assert rows(found) == rows(knn_join(p, k=5, strategy="gemm"))


def test_few_coordinates_by_expressions(spark):
    """knn_dim_prefix: the first coordinates, without a cross join; rows that agree in them tie."""
    rng = np.random.default_rng(5)
    m = np.column_stack([rng.integers(0, 4, (900, 3)), rng.random((900, 6))])
    found = knn_join(points(spark, m), k=5, strategy="expr", d_limit=3)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert rows(found) == brute(m[:, :3], m[:, :3], 5)


def test_functions_of_arrays_see_few_pairs(spark):
    """knn_hof: its interpreted functions run for proposed pairs, not for all."""
    m = np.random.default_rng(6).random((1500, 8))
    p = points(spark, m)
    found = knn_join(p, k=5, strategy="hof")
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "zip_with" in plan
    assert knn._by_expression(p, [p], 5, "hof", False, False, Options()).count() < 6 * 1500
    assert rows(found) == brute(m, m, 5)


@pytest.mark.parametrize("self_dist", [None, np.inf, knn.SELF_LAST])
def test_many_rows_are_multiplied_in_blocks(self_dist, monkeypatch):
    """compare_results: a corpus of many rows in blocks with many queries each; ties, copies and rows beyond a block."""
    rng = np.random.default_rng(7)
    y = np.concatenate([rng.integers(0, 4, (17000, 7)), np.tile(rng.random(7), (500, 1))]).astype(float)
    yid = rng.permutation(len(y))
    at = rng.integers(0, len(y), 150)
    x, xid, looked, distances = y[at], yid[at], [], kernels._distances
    monkeypatch.setattr(kernels, "_distances", lambda *a: looked.append((len(a[0]), len(a[2]))) or distances(*a))
    found = {i: [] for i in range(len(x))}
    for rows_, cid, _ in kernels.nearest(xid, x, yid, y, 6, self_dist, 64_000_000):
        for r, c in zip(rows_.tolist(), cid.tolist()):
            found[r].append(c)
    whole = ((x[:, None] - y) ** 2).sum(axis=2)
    if self_dist is not None:
        whole[xid[:, None] == yid] = self_dist
    assert found == {i: yid[np.lexsort((yid, v))[:6]].tolist() for i, v in enumerate(whole)}
    assert max(n for n, _ in looked) > 100 and max(n for _, n in looked) <= 4096


def test_near_copies_by_expressions(spark):
    """knn_dim_prefix: bounds by products can't hold rows apart that differ by rounding only; their pairs aren't all sent."""
    rng = np.random.default_rng(7)
    m = np.column_stack([rng.random((1500, 8)), rng.random((1500, 4))])
    m[rng.permutation(1500)[:600], :8] = m[0, :8] + rng.normal(size=(600, 8)) * 1e-7
    p = points(spark, m)
    cut = knn._limited(p, None, 8)
    assert knn._by_expression(cut, [cut], 5, "expr", False, False, Options()).count() < 7 * 1500
    assert rows(knn_join(p, k=5, strategy="expr", d_limit=8)) == rows(knn_join(p, k=5, strategy="gemm", d_limit=8))


def test_many_near_copies_are_looked_at_in_turns(monkeypatch):
    """knn_dim_prefix: pairs that products leave are looked at before they become many, and none is lost by it."""
    rng = np.random.default_rng(8)
    x = rng.random(8) + rng.normal(size=(5000, 8)) * 1e-7
    seen, real = [], kernels._nearer
    monkeypatch.setattr(kernels, "_PAIRS", 100_000)
    monkeypatch.setattr(kernels, "_nearer", lambda *a: (seen.append(len(a[-1])), real(*a))[1])
    ids = np.arange(5000)
    (i, j), = kernels.proposed(ids[:200], x[:200], ids, x, 5, False, np.full(200, np.inf), 64_000_000)
    assert max(seen) < 100_000 + 200 * kernels._BLOCK_ROWS and len(i) < 7 * 200
    found = set(zip(i.tolist(), j.tolist()))
    whole = ((x[:200, None] - x) ** 2).sum(axis=2)
    whole[ids[:200], ids[:200]] = np.inf
    assert {(a, c) for a, v in enumerate(whole) for c in np.lexsort((ids, v))[:5].tolist()} <= found


@pytest.mark.parametrize("exclude, last", [(False, False), (True, False), (False, True)])
def test_odd_numbers_by_functions_of_arrays(spark, exclude, last):
    """knn_hof: rows with NaN or infinite values aren't paired with all others; NaN ranks last, as in SQL."""
    rng = np.random.default_rng(9)
    m = rng.random((900, 4))
    m[100:160, 1] = np.nan
    m[200:260, 2] = np.inf
    m[260:300, 2] = -np.inf
    m[300:310] = [0, np.nan, np.inf, 1]
    p = points(spark, m)
    assert knn._by_expression(p, [p], 5, "hof", exclude, last, Options()).count() < 8 * 900
    with np.errstate(invalid="ignore"):
        whole = ((m[:, None] - m) ** 2).sum(axis=2)
    if last:
        np.fill_diagonal(whole, knn.SELF_LAST)
    ids = np.arange(900)
    for parts in (Options(), Options(broadcast_bytes=20_000)):
        found = {(r.qid, r.rank, r.cid) for r in knn_join(p, k=5, strategy="hof", exclude_self=exclude, self_last=last, options=parts).collect()}
        assert found == {(q, r + 1, c) for q, v in enumerate(whole) for r, c in enumerate([c for c in np.lexsort((ids, v)).tolist() if not (exclude and c == q)][:5])}


def test_few_numbers_among_odd_ones(spark):
    """knn_hof: with fewer than k finite distances the least ids follow, infinite distances before NaN."""
    m = np.full((60, 2), np.nan)
    m[[5, 50]] = [[1, 2], [3, 4]]
    m[[7, 40], 0], m[[7, 40], 1] = np.inf, 0
    found = {(r.qid, r.rank, r.cid) for r in knn_join(points(spark, m), k=6, strategy="hof").collect()}
    assert {(5, r + 1, c) for r, c in enumerate([5, 50, 7, 40, 0, 1])} <= found
    assert {(7, r + 1, c) for r, c in enumerate([5, 50, 0, 1, 2, 3])} <= found
    assert {(0, r + 1, c) for r, c in enumerate(range(6))} <= found and len(found) == 360
