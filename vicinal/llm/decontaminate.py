"""Benchmark decontamination: containment search with size-partitioned MinHash sketches.

Items are partitioned by their number of shingles.  An item of n shingles that is contained to a
share of t lacks at most (1 - t) n of them, so at least one of its k = floor((1 - t) u) + 1 smallest
hashes is in the document, u being the largest size in the item's partition.  These bottom-k MinHash
sketches are looked up in the hashes of each whole document, however long; no share of a document is
too small.  Every candidate is verified by exact shingle containment, on the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_words, bounded_batches, lean, released, shingle_hashes, text_chunks

WORDS = 5
SHARE = 0.8
#: Bytes of items' texts that one pass over the documents looks for, or one item; more take further passes.
#: They and their sketches, about as much again, are broadcast.
ITEM_BYTES = 8_000_000
_TABLE_BITS = 20


def _shingles(words: list[bytes], k: int) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(k))))


class Sketches:
    """Bottom-k sketches of items, by shingle length and size partition, as sorted arrays."""

    def __init__(self, items: list[tuple[int | None, str | None]], share: float):
        self.share = share
        #: (item_id, words of a shingle, the text) of each item that has words
        self.items: list[tuple[int | None, int, bytes]] = []
        hashes = Words(alnum=True)
        sketches: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            raw = (text or "").encode()
            h = hashes.hashes([raw])[0]
            if not len(h):
                continue
            k = min(WORDS, len(h))
            h = np.unique(shingle_hashes(h, k))
            largest = (1 << len(h).bit_length()) - 1
            sketches[k].append((h[: int((1 - share) * largest + 1e-9) + 1], len(self.items)))
            self.items.append((item_id, k, raw))
        #: by shingle length: hashes in order, the items that have them, and a filter of the hashes' last bits
        self.lookup = {}
        for k, some in sketches.items():
            h = np.concatenate([x for x, _ in some])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _TABLE_BITS, bool)
            bits[(h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
            self.lookup[k] = (h[order], np.repeat([i for _, i in some], [len(x) for x, _ in some])[order], bits)

    def candidates(self, texts: list[bytes], hashes: Words) -> set[tuple[int, int]]:
        """(document, item) numbers whose sketches meet."""
        h, ends = hashes.hashes(texts)
        out = set()
        for k, (known, item, bits) in self.lookup.items():
            s = shingle_hashes(h, k)
            at = np.flatnonzero(bits[(s & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
            doc = np.searchsorted(ends, at, side="right")
            inside = at + k <= ends[doc]
            at, doc = at[inside], doc[inside]
            first, after = np.searchsorted(known, s[at]), np.searchsorted(known, s[at], side="right")
            for d, a, b in set(zip(doc.tolist(), first.tolist(), after.tolist())):
                out.update((d, i) for i in item[a:b].tolist())
        return out

    def verified(self, words: list[bytes], numbers: list[int]) -> list[list[int]]:
        """[item number, shared shingles, item's shingles] of the items that are contained."""
        own: dict[int, set] = {}
        out = []
        for i in sorted(numbers):
            _, k, raw = self.items[i]
            if k not in own:
                own[k] = _shingles(words, k)
            shingles = _shingles(alnum_words(raw), k)
            shared = len(shingles & own[k])
            if shared >= self.share * len(shingles) - 1e-9:
                out.append([i, shared, len(shingles)])
        return out


def _blocks(items: DataFrame, share: float) -> Iterator[Broadcast]:
    """Sketches of the items, in blocks of about ITEM_BYTES of text, each sent to the executors once."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield items.sparkSession.sparkContext.broadcast(Sketches([tuple(r) for r in block.collect()], share))


def _contained(sketches: Sketches, texts: list[bytes], hashes: Words) -> Iterator[tuple[int, int, int, int]]:
    """(document number, item number, shared shingles, item's shingles) of what the texts contain."""
    by_doc = defaultdict(list)
    for d, i in sketches.candidates(texts, hashes):
        by_doc[d].append(i)
    for d in sorted(by_doc):
        for i, shared, size in sketches.verified(alnum_words(texts[d]), by_doc[d]):
            yield d, i, shared, size


_LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])


def _searched(docs: DataFrame, held: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketches = Words(alnum=True), held.value
        for batch in batches:
            for ids, texts in text_chunks(batch):
                rows = [(ids[d], sketches.items[i][0], shared, size) for d, i, shared, size in _contained(sketches, texts, hashes)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_LEAK)

    return docs.mapInArrow(lean(run), "doc_id long, item_id long, n_shared long, n_item long")


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document and each item it contains.

    docs: doc_id, text; items: item_id, text.  Words are runs of letters and digits in lower case;
    an item of fewer than five words is one shingle of all its words.  Null, empty and wordless
    texts contain nothing and are contained nowhere; repeated rows on either side give a row each;
    empty tables give no rows; null ids are kept; other columns are ignored.  Documents may have any
    length: a worker takes memory in proportion to the longest.
    """
    pairs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = [_searched(pairs, held) for held in _blocks(items, share)]
    if not parts:
        parts = [pairs.where("false").selectExpr("doc_id", "cast(null as long) item_id", "0L n_shared", "0L n_item")]
    return reduce(DataFrame.unionByName, parts).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of `docs` that contain no item; the same rules as `leaks`."""
    docs = bounded_batches(docs)
    for held in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), share):
        docs = docs.where(~_leaky(held)("text"))
    return docs


def _leaky(held: Broadcast) -> Callable[[str], Column]:
    """Column function: whether a whole text contains an item."""

    @F.arrow_udf("boolean")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, sketches = Words(alnum=True), held.value
        for column in texts:
            out = []
            for (some,) in text_chunks(pa.RecordBatch.from_arrays([column], ["text"])):
                found = {d for d, *_ in _contained(sketches, some, hashes)}
                out += [d in found for d in range(len(some))]
            yield pa.array(out, pa.bool_())
        released()

    return run
