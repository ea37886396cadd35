"""Near-duplicate documents: SimHash comparison within blocks, verified on five-word shingles.

Documents with a Jaccard similarity of 0.8 differ in about 10 of 64 fingerprint bits, too many for
parts of equal bits.  Blocks here are bands of min-hashes of the same shingles.  In a block
fingerprints are compared bit-sliced within a wide radius, and what remains is verified by the exact
similarity of the shingle sets.  Pairs of small blocks are verified by a join.  In large blocks each
text is first verified with a few others; blocks that are still in several groups then are compared
where their sets are, and only links between groups leave the task.  Blocks too large for that are
divided by narrower bands, and by tiles if they still are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, checkpointed, dealt, lean, mix, shingle_hashes, text_chunks
from .graph import connected_components
from .simhash import _slabs, fingerprint_of, within

WORDS, SIMILARITY = 5, 0.8
#: Bits by which fingerprints of similar texts differ at most.  Sets of fewer than FEW shingles may differ
#: in more, and are compared without fingerprints.
RADIUS, FEW = 22, 10
#: min-hashes a band, and bands, of the blocks and of the narrower ones that divide large blocks.
ROWS, BANDS = 3, 12
NARROW_ROWS, NARROW_BANDS = 6, 32
#: Members of a block whose pairs are verified by a join; members of larger ones first are verified with
#: so many neighbours in the order of fingerprints, and with the first member.
PAIRWISE, NEIGHBOURS = 16, 2
#: Members, and bytes of their shingle sets, that are compared with one another at once.
BLOCK, TILE_BYTES = 512, 8 << 20
BROADCAST_ROWS = 100_000


def shingles(texts: list[bytes], words: Words) -> Iterator[np.ndarray]:
    """Distinct hashes of the runs of five words of each text; of all words if there are fewer."""
    h, ends = words.hashes(texts)
    for first, after in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield np.unique(shingle_hashes(h[first:after], min(WORDS, max(1, after - first))))


_SEEDS = mix(np.arange(1, 1 + ROWS * BANDS + NARROW_ROWS * NARROW_BANDS, dtype=np.uint64)) | np.uint64(1)


def min_hashes(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least product of each odd seed, which permutes the 64-bit numbers, and the hashes of a set."""
    least = np.full(len(seeds), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            np.minimum(least, (s[i : i + 2048] * seeds[:, None]).min(axis=1), out=least)
    return least


def _banded(least: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band's min-hashes, with the band's number in its last bits."""
    least = least.reshape(-1, rows)
    out = np.zeros(len(least), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * np.uint64(31) + least[:, j])
    return ((out & ~np.uint64(31)) | np.arange(len(least), dtype=np.uint64)).view(np.int64)


def bands(s: np.ndarray) -> np.ndarray:
    return _banded(min_hashes(s, _SEEDS[: ROWS * BANDS]), ROWS)


def narrow_bands(s: np.ndarray) -> np.ndarray:
    return _banded(min_hashes(s, _SEEDS[ROWS * BANDS :]), NARROW_ROWS)


def _node(text: str) -> Column:
    """A text's hash; one for all blank texts."""
    return F.xxhash64(F.when(F.trim(F.translate(text, "\t\n\r\x0b\x0c", "     ")) != "", F.col(text)).otherwise(""))


_BANDS = [f"b{i}" for i in range(BANDS)]
#: What is known of a text besides its bands: its number, fingerprint and number of shingles.
_SIGN = "node long, fp long, size int"


def _signatures(rows: DataFrame) -> DataFrame:
    """The distinct texts that have words: _SIGN and their bands."""
    schema = pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), *[(b, pa.int64()) for b in _BANDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alnum=False)
        for batch in batches:
            for nodes, texts in text_chunks(batch):
                some = [(n, s) for n, s in zip(nodes, shingles(texts, words)) if len(s)]
                fps = np.array([fingerprint_of(s) for _, s in some], np.uint64).view(np.int64)
                keys = np.array([bands(s) for _, s in some], np.int64).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.int64()), pa.array(fps), pa.array([len(s) for _, s in some], pa.int32()), *map(pa.array, keys.T)], schema=schema)

    signed = rows.select("node", "text").mapInArrow(lean(run), f"{_SIGN}, " + ", ".join(f"{b} long" for b in _BANDS))
    return signed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "size", *_BANDS)])


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows, dealt out by their keys, with all rows of a key together."""
    held = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = 0 if last.all() else len(b) - int(last[::-1].argmin())
        held, b = b.iloc[cut:], b.iloc[:cut]
        if len(b):
            yield b.reset_index(drop=True)
    if held is not None:
        yield held.reset_index(drop=True)


def _alike(fp: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Those of the wanted pairs whose sizes and fingerprints allow a similarity of SIMILARITY."""
    wanted = wanted & (size[:, None] >= SIMILARITY * size) & (size >= SIMILARITY * size[:, None])
    few = size < FEW
    return within(fp.view(np.uint64), RADIUS, wanted) | (wanted & few[:, None] & few)


def _pairs(blocks: DataFrame) -> DataFrame:
    """The pairs (u, v), u < v, of small blocks (band, _SIGN) that may be similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _runs(batches, ["band"]):
            band, fp, node, size = (b[c].to_numpy(np.int64) for c in ("band", "fp", "node", "size"))
            run_of = np.cumsum(np.concatenate([[0], band[1:] != band[:-1]]))
            some = np.flatnonzero(np.bincount(run_of)[run_of] > 1)
            for s in _slabs(run_of[some], BLOCK) if len(some) else ():
                x = some[s]
                i, j = np.nonzero(_alike(fp[x], size[x], np.triu(run_of[x][:, None] == run_of[x], 1)))
                u, v = node[x[i]], node[x[j]]
                yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    rows = blocks.select("band", "node", "fp", "size")
    return dealt(rows, ["band"], ["fp", "node"]).mapInPandas(lean(run), "u long, v long")


def _neighbours(blocks: DataFrame) -> DataFrame:
    """Some pairs (u, v), u < v, of large blocks (band, _SIGN): neighbours in the order of fingerprints, and each
    member with the first of its block in the task.

    Blocks are dealt out by ranges of fingerprints, so a very large one takes many tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            band, fp, node, size = (b[c].to_numpy(np.int64) for c in ("band", "fp", "node", "size"))
            first = np.concatenate([[0], np.flatnonzero(band[1:] != band[:-1]) + 1])
            first = first[np.searchsorted(first, np.arange(len(b)), side="right") - 1]
            u, v = [], []
            for other in (*(np.arange(len(b)) - back for back in range(1, NEIGHBOURS + 1)), first):
                i = np.flatnonzero((other >= first) & (other < np.arange(len(b))))
                j = other[i]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
                near &= np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j])
                u.append(node[i[near]]), v.append(node[j[near]])
            u, v = np.concatenate(u), np.concatenate(v)
            yield pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})
            last = int(first[-1])
            held = b.iloc[sorted({last, *range(max(last, len(b) - NEIGHBOURS), len(b))})]  # the first of the open block, and the last

    rows = blocks.select("band", "node", "fp", "size").repartitionByRange("band", "fp", "node").sortWithinPartitions("band", "fp", "node")
    return rows.mapInPandas(lean(run), "u long, v long")


def _sets(rows: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """(node, s, narrow) of the nodes (node, doc_id, large): their shingle hashes in order, as bytes, and of
    members of blocks to be divided the narrow bands.  repeated: whether rows repeat an id and text."""
    schema = pa.schema([("node", pa.int64()), ("s", pa.binary()), ("narrow", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alnum=False)
        for batch in batches:
            for some, large, texts in text_chunks(batch):
                found = list(shingles(texts, words))
                narrow = [narrow_bands(s) if x else None for s, x in zip(found, large)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(narrow, pa.list_(pa.int64()))], schema=schema)

    nodes = nodes.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"), "large")
    nodes = _hinted(nodes)
    same = (rows["node"] == F.col("__node")) & rows["doc_id"].eqNullSafe(F.col("__id"))
    found = rows.join(nodes, same).select("node", "large", "text").mapInArrow(lean(run), "node long, s binary, narrow array<long>")
    return found.dropDuplicates(["node"]) if repeated else found


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= SIMILARITY * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    return pairs.join(a, "u").join(b, "v").where(alike("a", "b")).select("u", "v")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of a shares with each set of b, by products of 0/1 matrices."""
    held = [*a, *b]
    _, at, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    place = (np.cumsum(often > 1) - 1)[at]
    shared = often[at] > 1
    row, place = row[shared], place[shared]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(a), len(b)))
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
        here = slice(*np.searchsorted(place, [first, first + 2048]))
        has = np.zeros((len(held), 2048), np.float32)
        has[row[here], place[here] - first] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out


def _hinted(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it has few rows, so that a join with it deals nothing out by a hot key."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _members(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (block, _SIGN) with label and tile, of the blocks that are in several groups.

    A block of up to BLOCK members with sets of up to TILE_BYTES together is one tile; larger ones are
    dealt out by hash, otherwise for each block.
    """
    now = blocks.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = now.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.min("label").alias("least"), F.max("label").alias("most"))
    tiles = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("hashes") * 8 / TILE_BYTES))
    of = checkpointed(of.where("least <> most").select("block", tiles.alias("tiles")), slim=True)
    return now.join(_hinted(of), "block").withColumn("tile", F.pmod(F.xxhash64("node", "block"), F.col("tiles"))).drop("tiles")


def _paired(members: DataFrame, across: bool) -> DataFrame:
    """`_members` for each pair of tiles (a, b) of a block to be compared, which are not in one group, with
    side, 1 for those of b: each tile with itself, or with `across` each with each other."""
    tiles = checkpointed(members.groupBy("block", "tile").agg(F.min("label").alias("least"), F.max("label").alias("most")), slim=True)
    a, b = (tiles.select("block", *[F.col(c).alias(f"{c}_{x}") for c in ("tile", "least", "most")]) for x in "ab")
    pairs = a.join(b, "block").where("tile_a < tile_b" if across else "tile_a = tile_b")
    pairs = pairs.where("least(least_a, least_b) <> greatest(most_a, most_b)").select("block", F.col("tile_a").alias("a"), F.col("tile_b").alias("b"))
    pairs = _hinted(pairs)
    first = members.join(pairs.withColumn("tile", F.col("a")), ["block", "tile"]).withColumn("side", F.lit(0))
    if not across:
        return first
    return first.unionByName(members.join(pairs.withColumn("tile", F.col("b")), ["block", "tile"]).withColumn("side", F.lit(1)))


def _linked(paired: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the groups (labels) that similar members of the same pair of tiles are in: of each
    pair of tiles as many as join all groups that its links join."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _runs(batches, ["block", "a", "b"]):
            for (_, one, two), t in b.groupby(["block", "a", "b"], sort=False):
                found = compared(t, None if one == two else int((t["side"] == 0).sum()))
                if found:
                    yield pd.DataFrame(found, columns=["u", "v"])

    def compared(t: pd.DataFrame, split: int | None) -> list[tuple[int, int]]:
        label, fp, size = (t[c].to_numpy(np.int64) for c in ("label", "fp", "size"))
        wanted = np.triu(label[:, None] != label, 1)
        if split:
            wanted[:split, :split] = wanted[split:, split:] = False
        i, j = np.nonzero(_alike(fp, size, wanted))
        if not len(i):
            return []
        rows, columns = np.unique(i), np.unique(j)
        s = [np.frombuffer(x, np.uint64) for x in t["s"]]
        both = _common([s[x] for x in rows], [s[x] for x in columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
        near = both >= SIMILARITY * (size[i] + size[j] - both)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out = []
        for u, v in zip(label[i[near]].tolist(), label[j[near]].tolist()):
            if (x := top(u)) != (y := top(v)):
                root[max(x, y)] = min(x, y)
                out.append((min(u, v), max(u, v)))
        return out

    held = paired.select("block", "a", "b", "side", "node", "fp", "size", "label").join(sets.select("node", "s"), "node")
    return dealt(held, ["block", "a", "b"], ["side", "node"]).mapInPandas(lean(run), "u long, v long").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of the labels that the `links` (u, v) join: the least label of each component."""
    roots = connected_components(links).select("node", F.col("label").alias("root"))
    return _hinted(roots)  # one label may have very many nodes


def _relabelled(labelled: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows that have a label, with the label's root."""
    now = labelled.join(roots.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("root", "label"))
    return now.select(*labelled.columns)


def _merged(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label) after `_roots`; a node without a row is a group of its own."""
    known = _relabelled(labels, roots).select("node", "label")
    fresh = roots.join(labels, "node", "left_anti").select("node", F.col("root").alias("label"))
    return checkpointed(known.unionByName(fresh), slim=True)


def _divided(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks (block, _SIGN) for the large ones (band, n, _SIGN): those of up to BLOCK members as they are, and
    the narrow bands of the members of others."""
    whole = blocks.where(f"n <= {BLOCK}").select(F.col("band").alias("block"), "node", "fp", "size")
    nodes = blocks.where(f"n > {BLOCK}").select("node", "fp", "size").distinct()
    narrow = nodes.join(sets, "node").select(F.explode("narrow").alias("block"), "node", "fp", "size")
    return whole.withColumn("kind", F.lit(0)).unionByName(narrow.withColumn("kind", F.lit(1))).select(F.xxhash64("kind", "block").alias("block"), "node", "fp", "size")


def _joined(blocks: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """`labels` after all links within the blocks (block, _SIGN): first those within tiles, then across.

    Members are looked up in the labels once, a row for each block that a member is in; later links only
    change the labels of those that are in several tiles.
    """
    members = checkpointed(_members(blocks, labels), slim=True)
    for across in (False, True):
        if across:  # only blocks of several tiles have something left to compare
            several = members.groupBy("block").agg(F.min("tile").alias("x"), F.max("tile").alias("y")).where("x <> y").select("block")
            members = members.join(several, "block", "left_semi")
            members = checkpointed(members if links.isEmpty() else _relabelled(members, roots), slim=True)
        if members.isEmpty():
            break
        links = checkpointed(_linked(_paired(members, across), sets), slim=True)
        if not links.isEmpty():
            roots = _roots(links)
            labels = _merged(labels, roots)
    return labels


def _groups(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, node, n, kept) of each distinct (id, text), which n rows have."""
    rows = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", _node("text").alias("node"))
    ids = checkpointed(rows.groupBy("doc_id", "node").agg(F.count("*").alias("n")), slim=True)
    least = ids.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    signed = checkpointed(_signatures(rows), slim=True)
    every = signed.select("node", "fp", "size", F.explode(F.array(*_BANDS)).alias("band"))
    large = checkpointed(every.groupBy("band").agg(F.count("*").alias("n")).where(f"n > {PAIRWISE}"), slim=True)
    blocks = every.join(large, "band")
    small = every.join(large.select("band"), "band", "left_anti")
    pairs = _pairs(small) if large.isEmpty() else _pairs(small).unionByName(_neighbours(blocks))
    pairs = checkpointed(pairs.where("u <> v").distinct(), slim=True)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"), F.lit(False).alias("large")).unionByName(blocks.select("node", (F.col("n") > BLOCK).alias("large")))
    nodes = ends.groupBy("node").agg(F.max("large").alias("large")).join(least, "node")
    sets = checkpointed(_sets(rows, nodes, not ids.where("n > 1").isEmpty()))
    labels = checkpointed(connected_components(_similar(pairs, sets)), slim=True)
    if not large.isEmpty():
        labels = _joined(checkpointed(_divided(blocks, sets), slim=True), sets, labels)
    group = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chosen = group.groupBy("label").agg(F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    same = group["doc_id"].eqNullSafe(chosen["best.doc_id"]) & (group["node"] == chosen["best.node"])
    return group.join(chosen, "label").select(group["doc_id"], group["node"], "n", same.alias("kept"))


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, kept) of each distinct (id, text) of `docs`; one of each group of near copies is kept.

    Texts are one group if a chain of pairs with a similarity of at least 0.8 joins them; equal texts
    always are, so are null, empty and blank ones among themselves.  The smallest doc_id of a group is
    kept, a null one only if there is no other.  node is the text's hash.  An empty table gives no
    rows.  Texts may have any length: a task takes memory in proportion to the longest.
    """
    return _groups(docs, text, doc_id).drop("n")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that `duplicates` keeps, with all their columns; of rows that repeat a kept
    id and text one stays."""
    found = checkpointed(_groups(docs, text, doc_id).where("not kept or n > 1"), slim=True)
    dropped, again = (found.where(w).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")) for w in ("not kept", "kept"))
    dropped = _hinted(dropped)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = packed.withColumn("node", _node("text"))
    kept = packed.join(dropped, packed["id"].eqNullSafe(F.col("__id")) & (packed["node"] == F.col("__node")), "left_anti")
    if not again.isEmpty():
        twin = kept["id"].eqNullSafe(F.col("__id")) & (kept["node"] == F.col("__node"))
        kept = kept.join(again, twin, "left_anti").unionByName(kept.join(again, twin, "left_semi").dropDuplicates(["id", "node"]))
    return kept.select("row.*")
