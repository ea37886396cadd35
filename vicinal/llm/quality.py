"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on bootstrap samples of labelled rows; each path from a root is a conjunction
of comparisons, i.e. a rule.  Lasso logistic regression keeps few rules, and the fitted model is
compiled into one Spark column expression over the statistics' columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, space_words, text_chunks

#: Labelled rows that the classifier is fitted on, at most; they are chosen by a hash of the id.
MAX_LABELLED = 5_000
TREES, DEPTH, LASSO, STEPS = 40, 3, 2e-3, 300
#: Penalty of the second fit, on the rules that the first one kept; it undoes the first one's shrinking.
RELAXED = 2e-5
THRESHOLD = 0.7

# The statistics, in the order of the columns.
STATS = [
    "log_words", "mean_word", "upper", "digits", "punct", "marks", "bars", "symbols", "stops", "distinct", "common", "lines", "same_lines", "same_pairs", "long_words",
]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT, _MARKS, _BARS, _SYMBOLS, _STOPS = b",.;:", b"!?", b"|", b"*$%&#@~^<>{}=_/\\", b"."


def statistics(raw: bytes) -> tuple[float, ...]:
    """STATS of a whole text (UTF-8); all 0 for an empty or blank one."""
    lower = space_words(raw)
    n = len(lower)
    if n == 0:
        return (0.0,) * len(STATS)
    chars = len(raw)
    count = lambda some: chars - len(raw.translate(None, some))
    seen: dict[bytes, int] = {}
    for w in lower:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(lower, lower[1:])))
    return (
        float(np.log1p(n)), sum(map(len, lower)) / n, count(_UPPER) / chars, count(_DIGITS) / chars, count(_PUNCT) / n, count(_MARKS) / n, count(_BARS) / n,
        count(_SYMBOLS) / n, count(_STOPS) / n, len(seen) / n, max(seen.values()) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
        1 - pairs / max(1, n - 1), sum(len(w) > 20 for w in lower) / n,
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of the columns of `docs`) and the columns STATS."""
    df = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            rows = np.array([statistics(t) for (texts,) in text_chunks(batch) for t in texts]).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], STATS)
        released()

    stats = F.arrow_udf(run, ", ".join(f"{s} double" for s in STATS))
    return df.select("row", stats("text").alias("stats")).select("row", "stats.*")


@dataclass
class Model:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))"""

    intercept: float
    rules: list[tuple[tuple[tuple[str, str, float], ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        terms = [F.lit(self.intercept)]
        for conditions, weight in self.rules:
            holds = reduce(and_, [F.col(stat) <= bound if op == "<=" else F.col(stat) > bound for stat, op, bound in conditions])
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # in pairs, so that the expression stays shallow
            terms = [reduce(add, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Conjunctions (feature, is_greater, bound) of all nodes of one tree grown on a bootstrap sample."""
    out: list[tuple] = []
    every = x.shape[1]

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            out.append(path)
        p = y[rows].mean() if len(rows) else 0
        if len(path) == DEPTH or len(rows) < 20 or p in (0, 1):
            return
        best = (0.0, 0, 0.0)
        for f in rng.choice(every, max(2, every // 2), replace=False):
            v = x[rows, f]
            bounds = np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25)))
            below = v[:, None] <= bounds
            n = below.sum(0)
            ok = (n >= 8) & (n <= len(rows) - 8)
            if not ok.any():
                continue
            s = y[rows] @ below
            a, b = s / np.maximum(n, 1), (y[rows].sum() - s) / np.maximum(len(rows) - n, 1)
            gain = np.where(ok, p * (1 - p) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows), -1)
            if gain.max() > best[0]:
                best = (gain.max(), f, bounds[gain.argmax()])
        if best[0] > 1e-5:
            _, f, bound = best
            left = x[rows, f] <= bound
            grow(rows[left], (*path, (f, False, bound)))
            grow(rows[~left], (*path, (f, True, bound)))

    grow(rng.integers(0, len(y), min(len(y), 4000)), ())
    return out


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, bound in path:
        out &= (x[:, f] > bound) == greater
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Rule ensemble for rows x of STATS and 0/1 labels y; a constant if there is one class or none."""
    n, ones = len(y), float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if ones in (0, n):
        return Model(base)
    rng = np.random.default_rng(seed)
    paths: dict[bytes, tuple] = {}
    for _ in range(TREES):
        for p in _paths(x, y, rng):
            paths.setdefault(np.packbits(_holds(x, p)).tobytes(), tuple(sorted(p)))
    rules = list(paths.values())
    if not rules:
        return Model(base)
    r = np.column_stack([_holds(x, p) for p in rules]).astype("float32")
    w, _ = _lasso(r, y.astype("float32"), base, LASSO)
    some = np.flatnonzero(np.abs(w) > 1e-3)
    w, b = _lasso(r[:, some], y.astype("float32"), base, RELAXED)
    kept = [(rules[i], float(v)) for i, v in zip(some, w) if abs(v) > 1e-3]
    return Model(b, [(tuple((STATS[f], ">" if g else "<=", float(t)) for f, g, t in p), v) for p, v in kept])


def _lasso(r: np.ndarray, y: np.ndarray, b: float, penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the L1-penalised logistic loss; the intercept is free."""
    n = len(y)
    if not r.shape[1]:
        return np.empty(0, "float32"), b
    w = v = np.zeros(r.shape[1], "float32")
    c, t = b, 1.0
    u = np.ones(r.shape[1], "float32")
    for _ in range(30):  # the largest eigenvalue bounds the step
        u = r.T @ (r @ u)
        u /= np.linalg.norm(u)
    step = 1 / (0.25 * float(np.linalg.norm(r @ u) ** 2) / n + 0.25)
    for _ in range(STEPS):
        g = (1 / (1 + np.exp(-(r @ v + c))) - y) / n
        new = v - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = np.float32((t - 1) / t2)
        v, c = new + k * (new - w), new_b + float(k) * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 by 4 are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most `max_labelled` labelled documents, none of them held out.

    Labels without an id or a quality are ignored; a document with several labels takes the lowest,
    an id with several texts the last in their order.
    Without usable labels the model is a constant.
    """
    known = labels.where("doc_id is not null and quality is not null and not " + "(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("text").alias("text"))
    rows = with_statistics(some.withColumnRenamed("doc_id", "i")).select("row.i", "row.y", *STATS).toPandas().sort_values("i")
    return fit(rows[STATS].to_numpy("float64"), (rows["y"] > 0).to_numpy("float64"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of the columns of `docs`), score and predicted (1 if score >= THRESHOLD).

    Null, empty and blank texts have all statistics 0 and the score of that point; repeated rows
    stay; an empty table stays empty.  The columns of `docs` are kept in one struct, so no name can
    clash.  Texts may have any length: a worker takes memory in proportion to the longest.
    """
    scored = with_statistics(docs).select("row", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
