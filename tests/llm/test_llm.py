"""Operators against brute force on small tables with nulls, empty and long texts, ties, copies and clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vicinal.llm import decontaminate, graph, licenses, mtree, near, packing, pii, quality, queries, secrets, simhash, suffixes, tokens, warc
from vicinal.llm.common import Words, bounded_batches

RNG = np.random.default_rng(3)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


PASSAGE, COMMON, LONG = prose(60), prose(55), prose(6000)
COPY = prose(300)
EDITED = " ".join([*COPY.split()[:150], "changed", *COPY.split()[151:]])
TEXTS = [
    None, "", " \n\t ", "one", COPY, COPY, EDITED, LONG, f"{prose(80)} {PASSAGE} {prose(30)}", f"{prose(20)} {PASSAGE}", f"{COMMON} {prose(10)}", f"{prose(5)} {COMMON}",
    "Mail a.b+c@x-y.example.com, +1 (988) 555-2485 or 10.0.0.255 not 300.1.1.1; card 4111 1111 1111 1111. IBAN GB82 WEST 1234 5698 7654 32 \U0001f600 z@a.b@c.de",
    "password = 'hunter22' token:abc AKIA" + "Q" * 16 + " " + "0a" * 14 + " ghp_" + "x" * 36 + " é API_KEY=\"zzzzzz\"",
    "Licensed under the Apache License, Version 2.0. The MIT License. GNU  general-public LICENSE; cc by CC BY-NC 4.0", "a b c d e f g", "the " * 200,
    f"x {' '.join(VOCAB[:30])} y {prose(40)}",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(None, "nobody", "x", 1, "y"), (4, COPY, "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score long, rank string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(t):
    return t.encode().lower().split()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    only = lambda x: re.sub("[^0-9]", "", x)
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def base_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.BASE[0].pattern, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


@pytest.mark.parametrize("module, base", [(pii, base_pii), (secrets, base_secrets)])
def test_spans(docs, empty, module, base):
    found = module.digest(module.with_findings(docs, F.col("text")))
    want = sorted((str(i), hashlib.sha256(base(t).encode()).hexdigest()) for i, t in texts(docs))
    assert sorted((str(r.doc_id), r.base_sha256) for r in found.collect()) == want
    assert module.digest(module.with_findings(empty, F.col("text"))).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_more_kinds_and_redaction(docs):
    found = {r.doc_id: r.spans for r in pii.digest(pii.with_findings(docs, F.col("text"))).collect()}
    assert "iban:" in found[12]
    assert "github:" in {r.doc_id: r.spans for r in secrets.digest(secrets.with_findings(docs, F.col("text"))).collect()}[13]
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[12].text.startswith("Mail [EMAIL], [PHONE] or [IP] not 300.1.1.1; card [CARD]. IBAN [IBAN] \U0001f600 ")
    assert clean[0].text is None and clean[4].text == COPY and clean[4].spans == "x"


ODD = [
    "a.b+c@x-y.example.com", "z@a.b@c.de", "+1 (988) 555-2485", "+49 170 1234567", "10.0.0.255", "8.8.8.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559",
    "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 33", "219-09-9999", "000-12-3456", "password = 'hunter22'", "API_KEY:abcdefgh", "Token=\"x", "secret:",
    "AKIA" + "Q" * 16, "AKIA", "0a" * 14, "0a" * 11, "ghp_" + "x" * 36, "AIza" + "y" * 35, "xoxb-0123456789", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "-----BEGIN RSA PRIVATE KEY-----",
    " ", " ", ", ", "\n", "\t", "\U0001f600", "é", "card ", "iban ", "my ip ", "Call ", "ssn", "x", "7", "1", ".", "-", "@", "+", "=", "\"", "'",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts of pieces that make, break and touch matches, and their table for DuckDB."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + [(1500, None), (1501, "8.8.8.8 4111111111111111 \U0001f600" * 400)]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(path := str(tmp_path_factory.mktemp("odd") / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return spark.createDataFrame(rows, "doc_id long, text string"), con


@pytest.mark.parametrize("name, module, base", [("op3_pii", pii, base_pii), ("op5_secrets", secrets, base_secrets)])
def test_spans_of_odd_texts(odd, name, module, base):
    df, con = odd
    found = module.digest(module.with_findings(df, F.col("text")))
    want = {i: hashlib.sha256(base(t).encode()).hexdigest() for i, t in texts(df)}
    assert {r.doc_id: r.base_sha256 for r in found.collect()} == want
    columns = sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(con.sql(queries.SQL[name]).select(*columns).fetchall())
    kinds = {x.split(":")[0] for r in found.collect() for x in r.spans.split(",")} - {""}
    assert kinds == set(pii.KINDS if module is pii else [r.kind for r in secrets.RULES])


@pytest.mark.parametrize("least", [0.0, 0.7])
def test_redaction_of_odd_texts(odd, least):
    df, _ = odd
    found = {r.row.doc_id: r.findings for r in pii.with_findings(df, F.col("text")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df, least).collect()}
    for i, t in df.collect():
        if t is None:
            assert clean[i] is None
            continue
        out, at = "", 0
        for f in found[i]:
            if f.score >= least:
                if f.start >= at:
                    out += t[at : f.start] + f"[{f.kind.upper()}]"
                at = max(at, f.end)
        assert clean[i] == out + t[at:]


def test_addresses_of_single_digits(spark):
    rows = [(0, "8.8.8.8"), (1, "use 1.1.1.1 or\n9.9.9.9"), (2, "1.2.3"), (3, "v 2 . 1 . 0 . 4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_ip, r.base_sha256, r.spans) for r in pii.digest(pii.with_findings(df, F.col("text"))).collect()}
    assert found == {i: (base_pii(t).count("ip"), hashlib.sha256(base_pii(t).encode()).hexdigest(), base_pii(t)) for i, t in rows}
    assert [found[i][0] for i in range(4)] == [1, 2, 0, 0]
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["[IP]", "use [IP] or\n[IP]", *[t for _, t in rows[2:]]]


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("(abc|def)x?") == ("or", ("abc", "def"))
    assert secrets.trigram_query("(abcx|bcde)f") == ("or", (("and", ("abc", "bcx", "cxf")), ("and", ("bcd", "cde", "def"))))
    assert secrets.trigram_query("abcdefg") == ("and", ("abc", "cde", "efg"))
    assert secrets.trigram_query("abc|de") is True
    assert secrets.trigram_query("[Ab][cC]d(e|f)+") == ("or", ("acd", "bcd"))


def test_secrets_by_either_join(docs, monkeypatch):
    run = lambda: sorted(map(str, secrets.digest(secrets.with_findings(docs, F.col("text"))).collect()))
    first = run()
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    assert run() == first


def fingerprint(t):
    w = words(t)
    h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash(docs, empty):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.components(docs).collect()}
    prints = {i: fingerprint(t) for i, t in texts(docs) if i is not None}
    linked = [(a, b) for a in prints for b in prints if bin(prints[a] ^ prints[b]).count("1") <= 2]
    label = components(prints, linked)
    assert {k: v for k, v in rows.items() if k[0] is not None} == {(i, f"{p:016x}"): label[i] for i, p in prints.items()}
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 20])
def test_bit_sliced_distances(radius):
    fps = np.concatenate([RNG.integers(0, 2**63, 90, np.uint64), np.uint64(5) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))])
    want = np.bitwise_count(fps[:, None] ^ fps) <= radius
    assert (simhash.within(fps, radius) == want).all()
    upper = np.triu(np.ones_like(want), 1)
    assert (simhash.within(fps, radius, upper) == (want & upper)).all()


def test_divided_blocks_lose_no_link(spark):
    near_copies = [int(0xABCDEF ^ (1 << a) ^ (1 << b)) for a in range(30) for b in range(a, 30)]
    fps = sorted({*near_copies, *RNG.integers(0, 2**62, 50).tolist()})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {(r.u, r.v) for r in simhash.links(df, block=8).collect()}
    linked = [(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= 2]
    assert components(fps, list(found)) == components(fps, linked)


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    found = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(docs, empty):
    def shingles(t):
        w = words(t)
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in texts(docs) if i is not None}
    linked = [(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = components(sets, linked)
    kept = near.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label.values()))
    assert near.deduplicate(empty).count() == 0


def test_large_groups_of_near_copies(spark):
    base = prose(200).split()
    rows = [(i, " ".join([*base[: i % 150], f"edit{i}", *base[i % 150 + 1 :]])) for i in range(80)]
    assert [r.doc_id for r in near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_shared_hashes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(0, 2500), np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (near._common(sets, sets) == want).all()
    assert (near._common(sets[:4], sets[7:]) == np.array(want)[:4, 7:]).all()


def test_bands_of_similar_sets():
    """Both kinds of bands find pairs of similarity 0.8 about as often as independent hashes would."""
    rng = np.random.default_rng(1)
    first = narrow = 0
    for _ in range(600):
        s = rng.integers(0, 1 << 64, 99, np.uint64)
        a, b = s[:88], np.concatenate([s[:88][10:], s[88:97]])  # 78 shared of 97
        first += len(np.intersect1d(near.bands(a), near.bands(b)))
        narrow += len(np.intersect1d(near.narrow_bands(a), near.narrow_bands(b)))
    j = 78 / 97
    assert abs(first / (600 * near.BANDS) - j**near.ROWS) < 0.03 and abs(narrow / (600 * near.NARROW_BANDS) - j**near.NARROW_ROWS) < 0.03


def test_near_copies_of_large_blocks(spark):
    """Groups that no block of few members joins: each text has its own changes to one of two texts."""
    rows = family(11, 2, 60)
    want = least_of_groups(rows)
    kept = near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert 2 < len(want) < len(rows) and sorted(r.doc_id for r in kept.collect()) == want


def test_near_copies_without_an_id(spark):
    """Near copies with null ids are one group, and link others that are too different themselves."""
    base = prose(300).split()
    changed = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(base))
    rows = [(None, changed()), (None, changed(150)), (1, changed(20, 40, 60, 80, 100)), (2, changed(180, 200, 220, 240, 260))]
    schema = "doc_id long, text string"
    assert [r.doc_id for r in near.deduplicate(spark.createDataFrame(rows, schema)).collect()] == [1]
    assert [r.doc_id for r in near.deduplicate(spark.createDataFrame(rows[:2], schema)).collect()] == [None]


@pytest.fixture
def joins_change(spark):
    """Sort-merge joins that Spark turns into broadcast joins as it runs, over many partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_blocks_stay_together_after_a_join(spark, joins_change):
    """Rows of a key are in one task although a join by that key below may no longer deal them out."""
    one = F.lit(1).cast("long")
    rows = bounded_batches(spark.range(4000, numPartitions=7)).select((F.col("id") % 500).alias("band"), F.col("id").alias("node"), one.alias("fp"), F.lit(50).alias("size"))
    none = spark.range(1000, 1003).select(F.col("id").alias("band"))
    assert near._pairs(rows.join(none, "band", "left_anti")).count() == 500 * 28
    fps = spark.range(4000, numPartitions=7).select((F.col("id") % 500).alias("k1"), ((F.col("id") % 500) * 1024 + F.shiftright("id", 9)).alias("fp"))
    few = spark.range(500).select(F.col("id").alias("k1"))
    links = simhash._compared(fps.join(few, "k1", "left_semi"), ["k1"], 2).collect()
    want = [(r.fp, o.fp) for _, g in pd.DataFrame(fps.collect(), columns=["k1", "fp"]).groupby("k1") for r in g.itertuples() for o in g.itertuples() if (r.fp ^ o.fp).bit_count() <= 2]
    nodes = {x for p in want for x in p}
    assert components(nodes, [tuple(x) for x in links]) == components(nodes, want)


def test_near_copies_after_joins_change(spark, joins_change):
    rows = family(21, 6, 25)
    kept = near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(r.doc_id for r in kept.collect()) == least_of_groups(rows)


@pytest.mark.parametrize("n", [40, 1001])
def test_neighbours_in_a_large_block(spark, n):
    """Fingerprints in order differ in few bits, so that each member is in a pair, whatever task it is in."""
    fp = F.shiftright(F.lit(-1).cast("long"), 40) + F.col("id") % 7
    blocks = bounded_batches(spark.range(n)).select(F.lit(0).cast("long").alias("band"), fp.alias("fp"), F.lit(50).alias("size"), F.col("id").alias("node"))
    pairs = near._neighbours(blocks).collect()
    assert {x for p in pairs for x in p} == set(range(n)) and len(pairs) <= (near.NEIGHBOURS + 2) * n


def family(seed, bases, members):
    """Texts with their own changes to one of a few texts, so that many similarities are near 0.8."""
    rng = np.random.default_rng(seed)
    rows = []
    for base in (rng.choice(VOCAB, 300) for _ in range(bases)):
        for _ in range(members):
            changed = base.copy()
            for at in rng.integers(0, 300, rng.integers(2, 14)):
                changed[at] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(changed)))
    return rows


def least_of_groups(rows):
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    return sorted(set(components(range(len(rows)), linked).values()))


@pytest.mark.parametrize("block, tile", [(16, near.TILE_BYTES), (24, 20_000), (near.BLOCK, near.TILE_BYTES)])
def test_divided_blocks_of_near_copies(spark, monkeypatch, block, tile):
    """Blocks divided by narrower bands, and these by tiles, give what all pairs give."""
    monkeypatch.setattr(near, "PAIRWISE", 4)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "TILE_BYTES", tile)
    rows = family(block, 2, 80)
    want = least_of_groups(rows)
    kept = near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert 2 < len(want) < len(rows) and sorted(r.doc_id for r in kept.collect()) == want


def test_members_are_labelled_once(spark, monkeypatch):
    """Links across tiles are found without another look at the labels of every member of every block."""
    calls, found, members = [], [], near._members
    monkeypatch.setattr(near, "PAIRWISE", 4)
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "_members", lambda *a: calls.append(1) or members(*a))
    linked = near._linked
    monkeypatch.setattr(near, "_linked", lambda *a: found.append(1) or linked(*a))
    df = spark.createDataFrame(family(3, 2, 80), "doc_id long, text string")
    assert near.duplicates(df).count() == df.count()
    assert len(found) == 2 and len(calls) == 1  # two rounds, one look


def test_links_of_one_block(spark, monkeypatch):
    """All tiles of one block, whose members share no band otherwise."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = family(5, 1, 90)
    words = Words(alnum=False)
    found = [next(near.shingles([t.encode()], words)) for _, t in rows]
    blocks = spark.createDataFrame([(0, i, int(np.uint64(near.fingerprint_of(s)).view(np.int64)), len(s)) for i, s in enumerate(found)], "block long, node long, fp long, size int")
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(found)], "node long, s binary")
    labels = {r.node: r.label for r in near._joined(blocks, sets, spark.createDataFrame([], "node long, label long")).collect()}
    assert sorted({labels.get(i, i) for i, _ in rows}) == least_of_groups(rows)


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [(1, PASSAGE), (2, " ".join(VOCAB[:30])), (3, prose(30)), (4, None), (5, "b, C"), (6, ""), (7, " ".join(COMMON.split()[:50] + ["else"]))]
    table = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.leaks(docs, table).collect()}
    al = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = set()
    for i, t in items:
        k = min(5, len(al(t)))
        sh = lambda x: {tuple(al(x)[j : j + k]) for j in range(len(al(x)) - k + 1)}  # noqa: B023, E731
        want |= {(d, i, len(sh(t) & sh(x)), len(sh(t))) for d, x in texts(docs) if k and len(sh(t) & sh(x)) >= 0.8 * len(sh(t))}
    assert found == want and {1, 2, 5, 7} <= {x[1] for x in found}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)  # several passes
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.leaks(docs, table).collect()} == want
    clean = decontaminate.without_leaks(docs, table)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in texts(docs)} - {x[0] for x in want}
    assert decontaminate.leaks(empty, table).count() == decontaminate.leaks(docs, table.where("false")).count() == 0


@pytest.mark.parametrize("page, tree, query", [(mtree.PAGE, mtree.TREE_BYTES, mtree.QUERY_BYTES), (7, 4000, 500)])
def test_top_k(spark, monkeypatch, page, tree, query):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "TREE_BYTES", tree)
    monkeypatch.setattr(mtree, "QUERY_BYTES", query)
    v = RNG.normal(size=(700, 8)).round(1)
    v[50:300] = v[50]
    rows = [(i, [float(x) for x in r], "c") for i, r in enumerate(v)] + [(None, [1.0] * 8, "c"), (900, None, "c"), (901, [float("nan")] * 8, "c"), (902, [1.0, None], "c"), (903, [2.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").select("vec_id", mtree.whole_numbers(F.col("embedding")).alias("v"), "score")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), 10).collect()}
    whole = np.floor(v * 1024).astype(np.int64)
    for q in range(0, 700, 50):
        s = whole @ whole[q]
        best = [j for j in np.lexsort((np.arange(700), -s)) if j != q][:10]
        assert [found[q, n + 1] for n in range(10)] == [(j, s[j]) for j in best]
    assert len(found) == 10 * 14 and mtree.top_k(df.where("false"), df).count() == mtree.top_k(df, df.where("false")).count() == 0


PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("waiting, gathered", [(packing.WAITING, packing.GATHERED), (2, 3)])
def test_packing(spark, docs, empty, tokenizer, monkeypatch, waiting, gathered):
    monkeypatch.setattr(packing, "WAITING", waiting)
    monkeypatch.setattr(packing, "GATHERED", gathered)
    monkeypatch.setattr(packing, "GROUP_TOKENS", 2048)
    more = [(100 + i, prose(n), "x", 1, "y") for i, n in enumerate(RNG.integers(1, 1500, 60).tolist())]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).coalesce(2)
    want = {}
    for i, t in texts(docs):
        want.setdefault(i, []).append([*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    pieces = packing.pack(docs, PATH).toPandas().astype({"doc_id": "Int64"}).sort_values(["doc_id", "start"])
    # every id of every document is in one piece, and each piece, cut or not, has the document's own ids
    for i, rows in want.items():
        own = pieces[pieces.doc_id.isna() if i is None else pieces.doc_id == i]
        assert sorted(n for a, n in zip(own.start, own.doc_tokens) if a == 0) == sorted(map(len, rows))
        assert sorted((a + j) for a, n in zip(own.start, own.length) for j in range(n)) == sorted(j for ids in rows for j in range(len(ids)))
        for p in own.itertuples():
            assert any(len(ids) == p.doc_tokens and crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in rows)
    assert (pieces.length < pieces.doc_tokens).any()
    tiers = []
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        n = g.length.sum()
        assert (g.offset == g.length.cumsum() - g.length).all() and n == g.sequence_tokens.iloc[0]
        assert n.bit_count() == 1 and n <= 2048  # nothing to pad
        assert g.tier.nunique() == g.step_group.nunique() == 1 and n <= g.tier.iloc[0] and (n > 128 or g.tier.iloc[0] == 256)
        tiers.append((g.tier.iloc[0], g.step_group.iloc[0]))
    for tier in {t for t, _ in tiers}:
        sizes = pd.Series([g for t, g in tiers if t == tier]).value_counts()
        assert sizes.max() - sizes.min() <= 1 and sorted(sizes.index) == list(range(len(sizes)))
    assert packing.pack(empty, PATH).count() == 0


def test_few_documents_are_cut():
    rng = np.random.default_rng(8)
    sizes = rng.lognormal(6, 1, 5000).astype(int).clip(1, 2048)
    packer = packing.Packer(0)
    for i, n in enumerate(sizes.tolist()):
        packer.add(i, np.arange(n, dtype="<u4"))
        assert len(packer.waiting) <= packing.WAITING and len(packer.short) <= packing.GATHERED
    packer.end()
    pieces = pd.DataFrame(packer.done)
    assert pieces[2].sum() == sizes.sum() and (pieces[0].value_counts() > 1).mean() < 0.3
    assert pieces.groupby(5)[2].sum().map(lambda n: int(n).bit_count() == 1).all()


def test_ids_of_odd_texts(tokenizer):
    """The same as the plain tokenizer's, special tokens in a text and full tables included."""
    sets = [
        list("ab'sStTdlLrReEvVmM0½éÀΣς\n\t.,!|́ñ中¡×÷ßÿ  "), list("ab'sStTdlLrRvVeEmM01éÀñ.,!' \n"),
        ["a", "b", "<|", "endoftext", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "é", "'s", "中", "\x1c", "\u2028", "\xa0", "İ", "ﬁ", "\U0001f600"],
    ]
    for remember in (5, 1000, tokens.REMEMBER):
        encoder = tokens.Encoder(PATH, remember)
        assert encoder.by_pieces
        for _ in range(8):
            odd = ["".join(RNG.choice(s, RNG.integers(0, 50))) for s in sets for _ in range(30)] + ["", "it's WE'LL İi", "\x1c\x0b x", "a <|endoftext|> b"]
            assert [x.tolist() for x in encoder.encode([t.encode() for t in odd])] == [x.ids for x in tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_pieces_with_equal_hashes(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "mix", lambda h: h % np.uint64(50))
    odd = [prose(40), "it's " * 30, "été 12 中国"]
    assert [x.tolist() for x in tokens.Encoder(PATH).encode([t.encode() for t in odd])] == [x.ids for x in tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_another_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokens.known_kind(path)
    odd = ["It's  DE L'été 12\n", "", "a <|endoftext|> b"]
    assert [x.tolist() for x in tokens.Encoder(path).encode([t.encode() for t in odd])] == [x.ids for x in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("run", [suffixes.RUN, 1])
def test_repeats(spark, docs, empty, run, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", run)
    inside, both = prose(70), prose(64)
    more = [f"{inside} x {inside}", f"{both} y {both} z {both}", f"{prose(9)} {both} {both[:40]}", f"{both} {inside[:30]}"]
    docs = docs.unionByName(spark.createDataFrame([(300 + i, t, "x", 1, "y") for i, t in enumerate(more)], docs.schema))
    seen = {}
    every = texts(docs)
    for row, (_, t) in enumerate(every):
        w = words(t)
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(row)
    want = []
    for i, t in every:
        w = words(t)
        marks = np.zeros(len(w) + 2, int)
        for j in range(len(w) - 49):
            if len(seen[tuple(w[j : j + 50])]) > 1:
                marks[j + 1 : j + 51] = 1
        d = np.diff(marks)
        want.append((str(i), len(w), int(marks.sum()), ",".join(f"{a}:{b}" for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)))))
    assert sorted((str(r.doc_id), r.n_words, r.n_repeated, r.spans) for r in suffixes.repeats(docs).collect()) == sorted(want)
    assert suffixes.repeats(empty).count() == 0


def plain_statistics(t):
    """STATS by characters and words, one by one."""
    w = t.encode().lower().split()
    if not w:
        return [0.0] * len(quality.STATS)
    raw, n = t.encode(), len(w)
    of = lambda some: sum(chr(b) in some for b in raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = {(w[i], w[i + 1]) for i in range(n - 1)}
    return [
        np.log1p(n), sum(len(x) for x in w) / n, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / len(raw), of("0123456789") / len(raw), of(",.;:") / n, of("!?") / n, of("|") / n,
        of("*$%&#@~^<>{}=_/\\") / n, of(".") / n, len(set(w)) / n, max(w.count(x) for x in set(w)) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        1 - len(pairs) / max(1, n - 1), sum(len(x) > 20 for x in w) / n,
    ]


def plain_score(model, stats):
    x = dict(zip(quality.STATS, stats))
    z = model.intercept + sum(w for rule, w in model.rules if all(x[s] <= b if op == "<=" else x[s] > b for s, op, b in rule))
    return 1 / (1 + np.exp(-z))


def test_quality(spark, sf, docs, empty):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(own, labels)
    assert model.rules and all(len(rule) <= quality.DEPTH for rule, _ in model.rules)
    scored = queries.op9_quality(spark, sf).join(labels, "doc_id").toPandas()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]).all()
    assert (scored.predicted == (scored.score >= 0.7)).all() and scored.score.between(0, 1).all()
    assert (scored.predicted == scored.quality)[scored.held_out].mean() > 0.8
    every = own.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    found = quality.score(every, model).select("row.doc_id", "row.text", "score").collect()
    assert len(found) == own.count() + docs.count()
    for r in found:
        assert abs(r.score - plain_score(model, plain_statistics(r.text or ""))) < 1e-9
    assert quality.score(empty, model).count() == 0
    none = quality.learn(docs, labels.where("false"))
    assert quality.score(docs, none).select("score").distinct().count() == 1


def test_held_out_rows_are_never_learned(spark, sf):
    own, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(own, labels) == quality.learn(own, turned)


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_licenses(every, t):
    """Labels and score of one text: every template at every relative position, without an index."""
    rows, w, shares = [words_of(x) for x in every], words_of(t), {}
    df = lambda x: sum(x in set(r) for r in rows)
    for template in licenses.TEMPLATES:
        own = template.text.split()
        idf = {x: np.log((1 + len(rows)) / (1 + df(x))) + 1 for x in set(own)}
        looked_up = sorted(set(own) & set(w), key=lambda x: (df(x), x))[: licenses.LOOKED_UP]
        for p in range(-len(own), len(w)):
            met = {x for j, x in enumerate(own) if x in looked_up and 0 <= p + j < len(w) and w[p + j] == x}
            near = lambda j: range(max(0, p + j - licenses.DRIFT), p + j + licenses.DRIFT + 1)  # noqa: B023, E731
            stands = lambda k: any(own[j : j + len(k)] == k and w[i : i + len(k)] == k for j in range(len(own)) for i in near(j))  # noqa: B023, E731
            if len(met) >= licenses.MEET and all(stands(k.split()) for k in template.keys):
                share = sum(idf[x] for j, x in enumerate(own) if x in w[max(0, p + j - licenses.DRIFT) : max(0, p + j + licenses.DRIFT + 1)]) / sum(idf[x] for x in own)
                if share >= licenses.LEAST_SHARE:
                    shares[template.label] = max(shares.get(template.label, 0), min(1.0, share))
    return shares


def test_licenses(spark, docs, empty):
    whole = next(t for t in licenses.TEMPLATES if t.label == "isc").text
    edited = " ".join(x for i, x in enumerate(whole.split()) if i % 17 != 5)
    more = [
        whole.capitalize(), f"{prose(30)}. {edited}, {prose(10)}", whole[: len(whole) // 2], "permission to use copy modify", "the mit license of the mit license mit license",
        "License version 2.0 of the Apache License", licenses.TEMPLATES[0].text + " " + licenses.TEMPLATES[3].text, " ".join(reversed(whole.split())),
    ]
    docs = docs.unionByName(spark.createDataFrame([(200 + i, t, "x", 1, "y") for i, t in enumerate(more)], docs.schema))
    every = texts(docs)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    own = {i: t for i, t in every}
    found = licenses.scan(docs).toPandas()
    for r in found.itertuples():
        t = own[None if pd.isna(r.doc_id) else r.doc_id]
        w = words_of(t)
        at = sorted((i, x) for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (pd.isna(r.first_word) and pd.isna(r.last_word)) if not at else (r.first_word, r.last_word) == (at[0][0], at[-1][0])
        if len(w) < 1000:
            shares = plain_licenses([x for _, x in every], t)
            assert r.labels == ",".join(sorted({x for _, x in at} | set(shares)))
            assert abs(r.score - max([0.5 * bool(at), *shares.values()])) < 1e-6
    labels = found.set_index("doc_id").labels
    assert "isc" in labels[200] and "isc" in labels[201] and not labels[203] and {"mit", "bsd", "bsd-3-clause"} <= set(labels[206].split(",")) and not labels[207]
    assert licenses.scan(empty).count() == 0


def test_key_phrases_stand_in_their_templates():
    for t in licenses.TEMPLATES:
        assert t.text == " ".join(words_of(t.text)) and all(f" {k} " in f" {t.text} " for k in t.keys)


def test_hot_url(spark):
    """One URL with nearly all captures, many in the same second, against a scan in order."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        kind = rng.choice(["response", "revisit"])
        rows.append((i, f"http://h.com/{'a' if rng.random() < 0.9 else 'b'}", rng.choice([5, 5, 5, rng.randrange(200_000)]), kind, 200, rng.choice(["e1", "e2", None]), None, "d", None))
    s = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"
    want = {}
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            want[i] = max(((t, j) for j, u, t, k, *_ in rows if k == "response" and u == url and t < ts), default=(None, None))[1]
    found = warc.resolve_revisits(spark.createDataFrame(rows, s).repartition(5)).collect()
    assert {r.record_id: r.matched_id for r in found} == want and len(found) == len(want)


def test_revisits(spark):
    s = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, u string"
    rows = [
        (1, "http://www.A.com:80/x/?b=2&utm_source=q&a=1#f", 100, "response", 200, 'W/"e1"', None, "d1", {"etag": "old", "server": "s"}, "z"),
        (2, "https://a.com/x?a=1&b=2", 200, "revisit", 304, '"e1"', None, None, {"etag": "new", "server": "no"}, "z"),
        (3, "https://a.com/x?a=1&b=2", 90_000, "response", 404, "x", None, None, None, "z"),
        (4, "https://a.com/x?a=1&b=2", 500_000, "revisit", 304, '"e2"', None, None, None, "z"),
        (5, "https://a.com/x?a=1&b=2", 100, "revisit", 304, '"e1"', None, None, None, "z"),
        (6, None, 300, "revisit", 304, "x", None, None, None, "z"),
        (7, "http://a.com/x?a=1&b=2", 600_000, "revisit", 304, None, None, None, None, "z"),
        (8, "http://a.com/x?a=1&b=2", 600_000, "revisit", 304, None, None, "d1", None, "z"),
    ]
    df = spark.createDataFrame(rows, s)
    found = {r.record_id: r for r in warc.resolve_revisits(df.unionByName(df.where("record_id = 8"))).collect()}
    want = {2: ("resolved", 1), 4: ("mismatch", 1), 5: ("no_response", None), 6: ("no_response", None), 7: ("unvalidated", 1), 8: ("resolved", 1)}
    assert {k: (r.outcome, r.matched_id) for k, r in found.items()} == want
    assert found[2].headers == {"etag": "new", "server": "s"} and found[2].canonical_url == "a.com/x?a=1&b=2"
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_very_long_text(spark):
    """A text of a few megabytes, whose end counts, beside a short one."""
    body = " ".join(RNG.choice(VOCAB, 400_000))
    rows = [(1, f"{body} mail a.b@c.de AKIA{'Q' * 16} licensed under the apache license version 2 0 {PASSAGE}"), (2, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(words(rows[0][1]))
    assert [r.n_email for r in pii.digest(pii.with_findings(df, F.col("text"))).orderBy("doc_id").collect()] == [1, 0]
    assert "[EMAIL]" in pii.redact(df).where("doc_id = 1").first().text[-500:]
    assert [r.n_access for r in secrets.digest(secrets.with_findings(df, F.col("text"))).orderBy("doc_id").collect()] == [1, 0]
    found = licenses.scan(df).where("doc_id = 1").first()
    assert found.labels == "apache,apache-2.0" and found.first_word > 400_000
    assert {r.doc_id: r.fingerprint for r in simhash.components(df).collect()}[2] == f"{fingerprint(PASSAGE):016x}"
    assert {r.doc_id: (r.n_words, r.spans) for r in suffixes.repeats(df).collect()} == {1: (n, f"{n - 60}:{n}"), 2: (60, "0:60")}
    assert near.deduplicate(df).count() == 2
    assert packing.pack(df, PATH).agg(F.max("doc_tokens")).first()[0] > 400_000
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(df, items).collect()} == {1, 2}
    assert quality.score(df, quality.Model(0.5, [((("log_words", ">", 10.0),), 1.0)])).where("score > 0.8").count() == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark, sf, duck):
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df()
    columns = sorted(theirs.columns)
    canon = lambda df: sorted(tuple(None if pd.isna(x) else x for x in r) for r in df[columns].itertuples(index=False, name=None))
    assert sorted(ours.columns) == columns and canon(ours) == canon(theirs)


def test_pipeline(spark, sf):
    """Every stage against a plain version of it on what the one before kept."""
    import corpus_pipeline as p

    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("labels", "benchmark"))
    docs, kept = source, [source.toPandas()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == source.columns, name
        kept.append(docs.toPandas())
    model = quality.learn(source, labels)
    good = kept[0][[plain_score(model, plain_statistics(t)) >= quality.THRESHOLD for t in kept[0].text]]
    assert sorted(kept[1].doc_id) == sorted(good.doc_id) and 0 < len(good) < len(kept[0])
    rows = list(zip(good.doc_id, good.text))
    sets = {i: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} for i, t in rows}
    label = components(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert sorted(kept[2].doc_id) == sorted(set(label.values())) and len(kept[2]) < len(kept[1])
    shingles = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    own = [(shingles(words_of(r.text), min(5, len(words_of(r.text)))), min(5, len(words_of(r.text)))) for r in items.collect()]
    leaky = {i for i, t in zip(kept[2].doc_id, kept[2].text) if any(k and len(x & shingles(words_of(t), k)) >= 0.8 * len(x) for x, k in own)}
    assert sorted(kept[3].doc_id) == sorted(set(kept[2].doc_id) - leaky) and leaky
    before, after = dict(zip(kept[3].doc_id, kept[3].text)), dict(zip(kept[4].doc_id, kept[4].text))
    for i, t in before.items():
        assert (base_pii(t) == "") >= (after[i] != t and "[" not in after[i]) and not base_pii(after[i])
    assert (kept[4].n_chars == kept[4].text.map(len)).all() and before.keys() == after.keys()
    from tokenizers import Tokenizer

    sizes = {i: 1 + len(x.ids) for i, x in zip(after, Tokenizer.from_file(PATH).encode_batch(list(after.values()), add_special_tokens=False))}
    assert {r.doc_id: r.n for r in p.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == sizes


def test_stages_give_unused_heap_back(spark, sf):
    """Executors collect their garbage before each stage, so that its Python workers find room."""
    import corpus_pipeline as p

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(3)
    for name, stage in p.STAGES[2:]:
        before = whole()
        stage(spark, docs, sf)
        assert whole() > before, name


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, "8.8.8.8", "en", "a", 7)]])
def test_pipeline_of_odd_tables(spark, sf, tmp_path, rows):
    import corpus_pipeline as p

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, 0), (None, 1, None)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() <= len(rows)
