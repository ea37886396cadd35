"""SimHash fingerprints, compared in bit-sliced form.

The bit planes of a slab of fingerprints are stored vertically, 64 fingerprints a word.  Distances
of many pairs are counted at once by carry-save counters that hold one bit of each distance per
word; queries whose distances have all passed the radius are abandoned before the last plane.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, dealt, lean, space_words, text_chunks
from .graph import connected_components

RADIUS = 2
#: Fingerprints of a block that are compared at once; larger blocks are divided by more of their bits.
BLOCK = 512
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(h: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; 0 without hashes."""
    if not len(h):
        return 0
    at = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + (np.arange(8) << 8)
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(h), bitorder="little").tobytes(), "little")


def shingle_xxh64(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words joined by a space; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - k + 1)
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, ends[min(k, len(words)) - 1 :])), np.uint64, n)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_of(shingle_xxh64(space_words(t), k)) for _, texts in text_chunks(batch) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def within(fps: np.ndarray, radius: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix of the pairs of `fps` (uint64) that differ in at most `radius` bits.

    `wanted` says which pairs matter; a row is abandoned once all its wanted distances are beyond.
    """
    m = len(fps)
    words = -(-m // 64)
    wanted = np.ones((m, m), bool) if wanted is None else wanted
    bits = np.unpackbits(fps.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    planes = _packed(bits.T, words)
    flip = np.where(bits == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    over = ~_packed(wanted, words)
    alive = np.flatnonzero(wanted.any(axis=1))
    over = over[alive]
    counter = [np.zeros((len(alive), words), np.uint64) for _ in range((radius + 1).bit_length())]
    for b in range(64):
        if not len(alive):
            break
        carry = planes[b][None, :] ^ flip[alive, b][:, None]
        for c in counter:
            c ^= carry
            carry &= ~c
        over |= carry
        if b % 8 == 7:
            over |= _above(counter, radius)
            keep = (~over).any(axis=1)
            if not keep.all():
                alive, over = alive[keep], over[keep]
                counter = [c[keep] for c in counter]
    out = np.zeros((m, m), bool)
    if len(alive):
        out[alive] = np.unpackbits((~over).view(np.uint8).reshape(len(alive), -1), axis=1, bitorder="little")[:, :m]
    return out


def _packed(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    padded = np.zeros((len(bits), words * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bit-sliced comparison: where the counters hold more than `radius`."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            same = same & counter[level]
        else:
            more |= same & counter[level]
            same = same & ~counter[level]
    return more


def _slabs(runs: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of whole runs (equal neighbours) with about `size` rows each."""
    ends = [*(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
    start, last = 0, 0
    for e in ends:
        if e - start > size and last > start:
            yield slice(start, last)
            start = last
        last = e
    if last > start:
        yield slice(start, last)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric Boolean matrix."""
    seen, out = np.zeros(len(near), bool), []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def _blocks_of(x, width: int, places: list[int]):
    return [F.shiftrightunsigned(x, p).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for p in places]


def _divided(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """Rows of one more level: fingerprints that differ in 2 bits agree in 2 of any 4 parts.

    Level 1 takes the 4 parts of 16 bits; level 2 the 4 parts of 8 bits of what the key leaves open;
    level 3 the 4 parts of 4 bits.  A block of level 3 leaves 8 bits open: 256 fingerprints at most.
    """
    assert radius <= 2
    width = {1: 16, 2: 8, 3: 4}[level]
    x = F.col("fp") if level == 1 else F.col("open")
    parts = _blocks_of(x, width, [0, width, 2 * width, 3 * width])
    keys = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        a, b = [parts[k] for k in range(4) if k not in (i, j)]
        key = F.lit(t).cast("long") * (1 << (2 * width)) + parts[i] * (1 << width) + parts[j]
        keys.append(F.struct(key.alias("k"), (a * (1 << width) + b).alias("open")))
    old = [f"k{i}" for i in range(1, level)]
    return rows.select("fp", *old, F.explode(F.array(*keys)).alias("x")).select("fp", *old, F.col("x.k").alias(f"k{level}"), F.col("x.open").alias("open"))


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect the same distinct fingerprints as all links within `radius` do.

    Blocks of equal key parts are compared bit-sliced; a block of more than `block` fingerprints is
    divided by further bits of its own, which loses no link and ends with at most 256 fingerprints.
    """
    rows = fps.select("fp").distinct()
    out = None
    for level in (1, 2, 3):
        rows = _divided(rows, level, radius)
        keys = [f"k{i}" for i in range(1, level + 1)]
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        hot = None
        if level < 3:
            counts = checkpointed(counts, slim=True)
            hot = counts.where(f"n > {block}").select(*keys)
        small = rows.join(counts.where(f"n <= {block}").select(*keys) if level < 3 else counts.select(*keys), keys, "left_semi")
        found = _compared(small, keys, radius)
        out = found if out is None else out.unionByName(found)
        if hot is None or hot.isEmpty():
            break
        rows = rows.join(hot, keys, "left_semi")
    return out.distinct()


def _compared(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(b) - int(last[::-1].argmin() or (len(b) if last.all() else 0))
            held, b = b.iloc[cut:], b.iloc[:cut]
            yield from edges(b)
        if held is not None:
            yield from edges(held)

    def edges(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        changed = (b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)
        run_of = np.concatenate([[0], np.cumsum(changed)])
        fp = b["fp"].to_numpy(np.int64)
        u, v = [], []
        for s in _slabs(run_of, BLOCK):
            near = within(fp[s].view(np.uint64), radius, np.triu(run_of[s][:, None] == run_of[s], 1))
            for i, j in forest(near | near.T):
                u.append(fp[s][i])
                v.append(fp[s][j])
        if u:
            yield pd.DataFrame({"u": u, "v": v})

    return dealt(rows.select(*keys, "fp"), keys, ["fp"]).mapInPandas(lean(run), "u long, v long")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of `docs`.

    Null, empty and blank texts have fingerprint 0 and link like any other.  Repeated rows stay.  A
    null doc_id is kept; component_id is the smallest id of the component that isn't null, or null.
    An empty table gives no rows; other columns are ignored.  Texts may have any length: one is read
    at a time, and takes memory in proportion.
    """
    prints = checkpointed(fingerprints(docs, text, doc_id), slim=True)
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(prints))
    grouped = own.join(labels, own.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    grouped = checkpointed(grouped, slim=True)
    named = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    names = grouped.join(named, "label").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
