"""Repeated passages, found with a sparse suffix array.

Only suffixes at minimiser positions are kept: the place of the smallest k-gram hash in each window
of consecutive k-grams, which the text itself determines, so equal passages keep equal suffixes.
Suffixes whose first words occur in several texts are sorted and compared with their neighbours; the
common prefixes then are extended to the left.  A word is repeated if it lies in a passage of
LENGTH words that stands in another document as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, checkpointed, dealt, lean, mix, shingle_hashes, text_chunks

LENGTH = 50
GRAM, WINDOW = 8, 40
#: Words that follow a minimiser of a repeated passage in any case: the suffixes' key.
PREFIX = LENGTH - WINDOW + 1
#: Suffixes of one prefix that are sorted in one run; runs of more are divided, their windows compared after.
RUN = 1024
_WORDS = r"[^\x20\x09-\x0D]+"
_B = np.uint64(0x9E3779B97F4A7C15)


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of each window of `size` elements, by doubling."""
    out, width = x, 1
    while width < size:
        step = min(width, size - width)
        out = pick(out[: len(out) - step], out[step:])
        width += step
    return out


def minimisers(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the smallest k-gram hash of each window that starts a run of LENGTH words, for the
    word hashes of texts in a row; of equal ones all.  `ends`: the texts' ends."""
    if len(h) < LENGTH:
        return np.empty(0, np.int64)
    g = shingle_hashes(h, GRAM)
    least = _slide(g, WINDOW, np.minimum)[: len(h) - LENGTH + 1]
    first = np.arange(len(least))
    whole = first + LENGTH <= ends[np.searchsorted(ends, first, side="right")]
    # the largest minimum of the windows that hold a position; 0 where there is none
    held = np.concatenate([np.zeros(WINDOW - 1, np.uint64), np.where(whole, least, np.uint64(0)), np.zeros(WINDOW - 1, np.uint64)])
    most = _slide(held, WINDOW, np.maximum)
    return np.flatnonzero((g[: len(most)] == most[: len(g)]) & (most[: len(g)] > 0))


def _keys(texts) -> list:
    return [F.xxhash64(texts).alias("k1"), F.xxhash64(F.lit("second"), texts).alias("k2")]


def _prefixes(texts: DataFrame) -> DataFrame:
    """(h, k1) for each distinct minimiser prefix of each text (k1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alnum=False)
        for batch in batches:
            for keys, docs in text_chunks(batch):
                h, ends = words.hashes(docs)
                at = minimisers(h, ends)
                own = pd.DataFrame({"h": shingle_hashes(h, PREFIX)[at].view(np.int64), "k1": np.array(keys, np.int64)[np.searchsorted(ends, at, side="right")]})
                yield pa.RecordBatch.from_pandas(own.drop_duplicates(), preserve_index=False)

    return texts.select("k1", "text").mapInArrow(lean(run), "h long, k1 long")


_SUFFIX = "h long, k1 long, k2 long, pos int, lo int, hi int, lefts binary, rights binary"


def _suffixes(texts: DataFrame) -> DataFrame:
    """The suffixes of (k1, k2, text, hs) at minimisers whose prefix is in hs, with their contexts."""

    schema = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("lefts", pa.binary()), ("rights", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alnum=False)
        around = np.arange(LENGTH)
        for batch in batches:
            for k1, k2, hs, docs in text_chunks(batch):
                h, ends = words.hashes(docs)
                at = minimisers(h, ends)
                prefix = shingle_hashes(h, PREFIX).view(np.int64)
                at = at[np.isin(prefix[at], np.concatenate([np.array(x, np.int64) for x in hs]))]
                doc = np.searchsorted(ends, at, side="right")
                pos, left = at - np.concatenate([[0], ends])[doc], ends[doc] - at
                small = np.concatenate([np.zeros(WINDOW, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(LENGTH, np.uint32)])
                for s in range(0, len(at), 5000):
                    x = at[s : s + 5000, None] + WINDOW
                    lefts, rights = small[x - 1 - around[: WINDOW - 1]], small[x + around]
                    d = doc[s : s + 5000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(x) for x in (
                            prefix[at[s : s + 5000]], np.array(k1, np.int64)[d], np.array(k2, np.int64)[d], pos[s : s + 5000].astype(np.int32),
                            np.maximum(0, LENGTH - left[s : s + 5000]).astype(np.int32), np.minimum(WINDOW - 1, pos[s : s + 5000]).astype(np.int32),
                            [r.tobytes() for r in lefts], [r.tobytes() for r in rights],
                        )
                    ], schema=schema)

    return texts.select("k1", "k2", "hs", "text").mapInArrow(lean(run), _SUFFIX)


def _sums(matrix: np.ndarray) -> np.ndarray:
    """Column j: a hash of the first j words of each row."""
    out = np.empty((len(matrix), matrix.shape[1] + 1), np.uint64)
    out[:, 0] = 1
    with np.errstate(over="ignore"):
        for j in range(matrix.shape[1]):
            out[:, j + 1] = mix(out[:, j] * _B + matrix[:, j].astype(np.uint64) + np.uint64(1))
    return out


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an element's key has elements of more than one document."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    least, most = (f.reduceat(doc[order], starts) for f in (np.minimum, np.maximum))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(least != most, np.diff(np.append(starts, len(key))))
    return out


def compare(run: np.ndarray, lefts: np.ndarray, rights: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes: the most and least words to the left with which a window of LENGTH words
    around the suffix start occurs in several documents of its run; -1 and WINDOW where there is none."""
    same = (rights[1:] == rights[:-1]) & (run[1:] == run[:-1])[:, None]
    common = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    common = np.where(run[1:] == run[:-1], common, -1)
    left = _sums(lefts)
    most, least = np.full(len(run), -1), np.full(len(run), WINDOW)
    for o in range(WINDOW):
        block = np.concatenate([[0], np.cumsum(common < LENGTH - o)]).astype(np.uint64)
        rows = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(rows):
            continue
        with np.errstate(over="ignore"):
            key = mix(block[rows] * _B) ^ left[rows, o]
        found = rows[_several(key, doc[rows])]
        most[found] = o
        least[found] = np.minimum(least[found], o)
    return most, least


_MARK = "k1 long, k2 long, first int, after int, h long, bucket int, pack binary"
_PACK = np.dtype([("key", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("pos", "<i4"), ("o", "<i2"), ("done", "<i2")])


def _marked(suffixes: DataFrame, most_buckets: int) -> DataFrame:
    """Repeated places (k1, k2, first, after); of divided runs also their windows, packed."""

    def spans(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        ids = b[["h", "salt"]].to_numpy()
        run_of = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))])
        lefts = np.frombuffer(b"".join(b["lefts"]), np.uint32).reshape(len(b), WINDOW - 1)
        rights = np.frombuffer(b"".join(b["rights"]), np.uint32).reshape(len(b), LENGTH)
        lo, hi, pos, doc = (b[c].to_numpy(np.int64) for c in ("lo", "hi", "pos", "k1"))
        most, least = compare(run_of, lefts, rights, lo, hi, doc)
        found = most >= 0
        out = pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "first": pos - most, "after": pos - least + LENGTH})[found]
        yield out.assign(h=None, bucket=None, pack=None).astype({"h": "Int64", "bucket": "Int32"})
        hot = np.flatnonzero(b["salts"].to_numpy() > 1)
        for r in np.unique(run_of[hot]):
            yield packed(b[run_of == r], lefts[run_of == r], rights[run_of == r])

    def packed(b: pd.DataFrame, lefts: np.ndarray, rights: np.ndarray) -> pd.DataFrame:
        left, right = _sums(lefts), _sums(rights)
        parts = []
        for o in range(WINDOW):
            rows = np.flatnonzero((b["lo"].to_numpy() <= o) & (o <= b["hi"].to_numpy()))
            with np.errstate(over="ignore"):
                key = mix(left[rows, o] * _B + right[rows, LENGTH - o] + np.uint64(o))
            if not len(rows):
                continue
            # of a window that several documents here have one is enough for those in other parts
            done = _several(key, b["k1"].to_numpy()[rows])
            first = np.zeros(len(rows), bool)
            first[np.unique(key, return_index=True)[1]] = True
            some = np.flatnonzero(first | ~done)
            part = np.zeros(len(some), _PACK)
            part["key"], part["o"], part["done"] = key[some], o, done[some]
            for c in ("k1", "k2", "pos"):
                part[c] = b[c].to_numpy()[rows[some]]
            parts.append(part)
        every = np.concatenate(parts)
        buckets = min(most_buckets, 8 * int(b["salts"].iloc[0]))
        at = (every["key"] % np.uint64(buckets)).astype(np.int64)
        rows = [(None, None, None, None, int(b["h"].iloc[0]), x, every[at == x].tobytes()) for x in np.unique(at).tolist()]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _MARK.split(", ")]).astype({c: "Int64" for c in ("k1", "k2", "first", "after")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = ((b["h"] == b["h"].iloc[-1]) & (b["salt"] == b["salt"].iloc[-1])).to_numpy()
            cut = 0 if last.all() else len(b) - int(last[::-1].argmin())
            held, b = b.iloc[cut:], b.iloc[:cut]
            yield from spans(b.reset_index(drop=True))
        if held is not None:
            yield from spans(held.reset_index(drop=True))

    return dealt(suffixes, ["h", "salt"], ["rights"]).mapInPandas(lean(run), _MARK)


def _united(packs: DataFrame) -> DataFrame:
    """Windows that documents in several parts of a divided run have: (k1, k2, first, after)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        every = np.frombuffer(b"".join(group["pack"]), _PACK)
        # a window that is done in one part has several documents, whatever the others are
        done = np.isin(every["key"], every["key"][every["done"] == 1])
        new = every[(done | _several(every["key"], every["k1"])) & (every["done"] == 0)]
        first = new["pos"].astype(np.int64) - new["o"]
        return pd.DataFrame({"k1": new["k1"], "k2": new["k2"], "first": first, "after": first + LENGTH})

    return packs.groupBy("h", "bucket").applyInPandas(run, "k1 long, k2 long, first int, after int")


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_repeated and spans of each row of `docs`.

    spans: first:after word numbers (from 0, end exclusive) of the passages whose words stand, in
    runs of LENGTH words or more, in another row as well; joined by commas.  n_repeated: the words in
    them.  What repeats within one row only isn't counted.  Words are divided by ASCII white space, A-Z count as a-z.  Exact copies of a text
    of LENGTH words or more repeat as a whole.  Shorter, null and empty texts have none.  A null
    doc_id is kept, repeated rows are copies, an empty table gives no rows, other columns are ignored.
    Texts may have any length: a worker takes memory in proportion to the longest.
    """
    rows = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *_keys("text"), "text")
    slim = rows.select("doc_id", "k1", "k2", F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("n_words"))
    slim = checkpointed(slim, slim=True)
    one = slim.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.max("n_words").alias("n_words"))

    every = _prefixes(rows)
    several = every.groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("h")
    wanted = every.join(several, "h").groupBy("k1").agg(F.collect_set("h").alias("hs"))
    chosen = one.select("k1", "k2", "least").join(wanted, "k1")
    texts = rows.join(chosen, ["k1", "k2"]).where("doc_id <=> least").select("k1", "k2", "text", "hs")
    found = checkpointed(_suffixes(texts))

    sizes = found.groupBy("h").agg(F.count("*").alias("n"))
    hot = checkpointed(sizes.where(f"n > {RUN}").select("h", F.ceil(F.col("n") / RUN).cast("int").alias("salts")), slim=True)
    runs = found.join(hot, "h", "left") if not hot.isEmpty() else found.withColumn("salts", F.lit(1))
    runs = runs.withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.col("salts")).cast("int"))
    marked = checkpointed(_marked(runs, 1 << 14))
    places = marked.where("bucket is null").select("k1", "k2", "first", "after")
    places = places.unionByName(_united(marked.where("bucket is not null")))
    places = places.unionByName(one.where(f"copies > 1 and n_words >= {LENGTH}").select("k1", "k2", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("after")))
    by_text = places.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("first", "after"))).alias("x")).select("k1", "k2", _merged(F.col("x")).alias("x"))
    out = slim.join(by_text, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<first:int,after:int>>")
    out = out.withColumn("x", F.coalesce("x", none))
    return out.select(
        "doc_id", "n_words", F.aggregate("x", F.lit(0), lambda a, s: a + s["after"] - s["first"]).cast("long").alias("n_repeated"),
        F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["first"].cast("string"), s["after"].cast("string"))), ",").alias("spans"),
    )


def _merged(spans):
    """Sorted spans with those that touch or overlap united."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["after"], s["after"]).alias("after"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["first"] <= F.try_element_at(acc, F.lit(-1))["after"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<first:int,after:int>>"), step)
