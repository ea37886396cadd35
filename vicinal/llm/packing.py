"""Hierarchical packing of documents into sequences of several context sizes.

A document's whole windows of the largest size become sequences at once.  What remains of it is
routed to the smallest tier that holds it.  There it fills the gap of a longer tier's window that it
fits best, or opens a window of its own tier; pieces of the shortest tier that fit nowhere gather and
fill windows of that tier.  Of too many windows that wait, the fullest is filled up with a part of
the emptiest, and at the end of a partition the last rest is cut into powers of two; neither needs
padding.  Documents are not shuffled, and a worker holds a bounded number of windows.  Step groups
are balanced over the whole table afterwards, from counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, lean, text_chunks
from .tokens import ENCODE, REMEMBER, Encoder, known_kind

SIZE = 2048
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group: sequences of one tier that are trained together.
GROUP_TOKENS = 64 * SIZE
#: Windows with a gap, and pieces of the shortest tier, that a worker holds.
WAITING, GATHERED = 64, 64
END = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier int, part long, number long"
)
_TYPES = {"long": pa.int64(), "int": pa.int32()}
_ARROW = pa.schema([(c, _TYPES[t]) for c, t in (x.split() for x in SCHEMA.split(", "))])

#: A part of a document: (doc_id, place of its first id in the document, its ids, ids of the document).
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Deals pieces of documents out to sequences, which `done` gets as rows of SCHEMA."""

    def __init__(self, part: int):
        self.part, self.order, self.sequence = part, count(), count(part << 36)
        self.numbers = {t: count() for t in TIERS}
        #: windows with a gap, by gap: (gap, order, tier, pieces)
        self.waiting: list[tuple[int, int, int, list[Piece]]] = []
        #: pieces of the shortest tier, by length: (length, order, piece)
        self.short: list[tuple[int, int, Piece]] = []
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= SIZE:
            self._close(SIZE, [(doc_id, at, ids[at : at + SIZE], n)])
            at += SIZE
        if at < n:
            self._route((doc_id, at, ids[at:], n))

    def _route(self, piece: Piece) -> None:
        n = len(piece[2])
        tier = _tier(n)
        # the smallest gap that holds the piece, of the windows of longer tiers
        i = bisect_left(self.waiting, (n,))
        while i < len(self.waiting) and self.waiting[i][2] <= tier:
            i += 1
        if i < len(self.waiting):
            gap, _, longer, pieces = self.waiting.pop(i)
            self._wait(longer, [*pieces, piece], gap - n)
        elif tier == TIERS[0]:
            insort(self.short, (n, next(self.order), piece))
            if len(self.short) > GATHERED:
                self._fill_short()
        else:
            self._wait(tier, [piece], tier - n)

    def _wait(self, tier: int, pieces: list[Piece], gap: int) -> None:
        """Fill the gap from the shortest tier, the longest pieces first; else the window waits."""
        while gap and self.short:
            i = bisect_left(self.short, (gap + 1,)) - 1
            if i < 0:
                break
            n, _, piece = self.short.pop(i)
            pieces, gap = [*pieces, piece], gap - n
        if not gap:
            self._close(tier, pieces)
            return
        insort(self.waiting, (gap, next(self.order), tier, pieces))
        if len(self.waiting) > WAITING:
            gap, _, tier, pieces = self.waiting.pop(0)
            while gap:
                _, _, emptiest, rest = self.waiting.pop()
                part, rest = _cut(rest, gap)
                pieces, gap = pieces + part, gap - _total(part)
            self._close(tier, pieces)
            if rest:
                self._wait(emptiest, rest, emptiest - _total(rest))

    def _fill_short(self) -> None:
        """A window of the shortest tier from the longest pieces; the last one is cut."""
        pieces, fill = [], 0
        while fill < TIERS[0]:
            n, _, piece = self.short.pop()
            pieces, fill = [*pieces, piece], fill + n
        pieces, rest = _cut(pieces, TIERS[0])
        self._close(TIERS[0], pieces)
        for piece in rest:
            insort(self.short, (len(piece[2]), next(self.order), piece))

    def end(self) -> None:
        """Fill what still waits up from one another, longest tiers first; the last rest is cut into
        powers of two."""
        rest = [p for *_, pieces in sorted(self.waiting, key=lambda w: (-w[2], w[1])) for p in pieces] + [p for *_, p in reversed(self.short)]
        self.waiting, self.short = [], []
        total = _total(rest)
        while total:
            size = min(SIZE, 1 << (total.bit_length() - 1))
            pieces, rest = _cut(rest, size)
            self._close(_tier(size), pieces)
            total -= size

    def _close(self, tier: int, pieces: list[Piece]) -> None:
        sequence, number, tokens, offset = next(self.sequence), next(self.numbers[tier]), _total(pieces), 0
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids), n, sequence, offset, tokens, tier, self.part, number))
            offset += len(ids)


def _tier(n: int) -> int:
    return next(t for t in TIERS if t >= n)


def _total(pieces: list[Piece]) -> int:
    return sum(len(p[2]) for p in pieces)


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first `size` ids of the pieces, or all, and the rest."""
    out = []
    for i, (doc_id, start, ids, n) in enumerate(pieces):
        if not size:
            return out, pieces[i:]
        out.append((doc_id, start, ids[:size], n))
        if len(ids) > size:
            return out, [(doc_id, start + size, ids[size:], n), *pieces[i + 1 :]]
        size -= len(ids)
    return out, []


def _pieces(docs: DataFrame, tokenizer: str, text: str, doc_id: str, remember: int, encode: int) -> DataFrame:
    by_pieces = known_kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer, remember, by_pieces), Packer(TaskContext.get().partitionId())
        end = np.array([END], "<u4")

        def taken() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            for numbers, texts in text_chunks(batch, encode):
                for i, ids in zip(numbers, encoder.encode(texts)):
                    packer.add(i, np.concatenate([ids, end]))
                if len(packer.done) > 20_000:
                    yield taken()
        packer.end()
        if packer.done:
            yield taken()

    rows = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", remember: int = REMEMBER, encode: int = ENCODE
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (ids in the sequence), tier and step_group.

    Ids are the tokenizer's own for the whole text, without special tokens at its ends, and END.  A
    null or empty text is a document of END alone; a null doc_id is kept as null; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.  A text may be of any
    length: it takes memory in proportion in one worker.  Sequence ids are unique, but depend on how
    the rows are partitioned.  The sequences of a tier are divided into step groups of GROUP_TOKENS
    tokens, whose numbers of sequences differ by one at most.  `tokenizer` is a file that the driver and
    every executor have; `remember` and `encode` bound a worker's memory and change no result.
    """
    pieces = checkpointed(_pieces(docs, tokenizer, text, doc_id, remember, encode))
    counts = pieces.where("offset = 0").groupBy("tier", "part").agg(F.count("*").alias("n"))
    tier = Window.partitionBy("tier")
    before = F.coalesce(F.sum("n").over(tier.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tier", "part", before.alias("before"), F.sum("n").over(tier).alias("every"))
    groups = F.greatest(F.lit(1), F.round(F.col("every") * F.col("tier") / GROUP_TOKENS).cast("long"))
    group = F.floor((F.col("before") + F.col("number")) * groups / F.col("every"))
    return pieces.join(counts, ["tier", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", group.cast("long").alias("step_group")
    )
