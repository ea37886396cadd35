"""Places of regular-expression matches, with built-in functions only.

`regexp_extract_all` gives the matches and `split` with the same pattern the gaps between them; both
walk the text by the same rule (leftmost, non-overlapping), so sums of their lengths are positions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN = 512


def _sums(xs: Column, start: Column) -> Column:
    """start, start + xs[0], ... without the last sum."""
    step = F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.slice(step, 1, F.size(xs))


def exclusive_sums(xs: Column) -> Column:
    """Sums of the elements before each element, in runs so that long arrays stay cheap."""
    runs = F.transform(
        F.sequence(F.lit(0), ((F.size(xs) - 1) / _RUN).cast("int")), lambda c: F.slice(xs, c * _RUN + 1, _RUN)
    )
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, _sums(totals, F.lit(0)), lambda r, b: _sums(r, b)))


def united(spans: Column) -> Column:
    """Sorted spans with those that overlap an earlier one left out, and `end` moved to the last end of each
    group: the spans of a group begin before the greatest end of those before them."""
    ends = _greatest(F.transform(spans, lambda x: x["end"]))  # up to and with each
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.size(spans) - 1))
    marked = F.zip_with(spans, before, lambda x, b: F.struct(x.alias("s"), b.alias("before")))
    firsts = F.filter(marked, lambda x: x["s"]["start"] >= x["before"])
    # a group reaches as far as what stands before the next group's first, the last one as far as all
    reach = F.concat(F.slice(F.transform(firsts, lambda x: x["before"]), 2, F.size(spans)), F.array(F.element_at(ends, -1)))
    joined = F.zip_with(firsts, reach, lambda x, r: x["s"].withField("end", r))
    return F.when(F.size(spans) > 1, joined).otherwise(spans)


def _greatest(xs: Column) -> Column:
    """The greatest element up to and with each, in runs so that long arrays stay cheap."""
    step = lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x)))
    sweep = lambda r, first: F.slice(F.aggregate(r, F.array(first), step), 2, F.size(r))
    runs = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / _RUN).cast("int")), lambda c: F.slice(xs, c * _RUN + 1, _RUN))
    tops = F.aggregate(F.transform(runs, F.array_max), F.array(F.lit(-1)), step)
    return F.flatten(F.zip_with(runs, F.slice(tops, 1, F.size(runs)), sweep))


#: Characters of a chunk of a text.
CHUNK = 256


def chunked(text: Column) -> Column:
    """A text in chunks of CHUNK code points, which `between` cuts without walking the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, a: Column, b: Column) -> Column:
    """The text of `chunks` from code point a to b (null: the end), end exclusive."""
    number = lambda x: F.floor(x / CHUNK).cast("int")
    last = F.when(b.isNull(), F.size(chunks)).otherwise(number(b) + 1)
    text = F.array_join(F.slice(chunks, number(a) + 1, F.greatest(last - number(a), F.lit(0))), "")
    whole = F.substring(text, a % CHUNK + 1, b - a)
    return F.when(b.isNull(), F.substring(text, a % CHUNK + 1, F.length(text))).otherwise(whole)


def with_matches(df: DataFrame, text: str, patterns: Iterable[tuple[str, str, Column | None]]) -> DataFrame:
    """Adds m_<kind>: array of (start, end, value, before, after) for each (kind, pattern, only_if).

    Positions count code points from 0, end exclusive; before and after hold up to 48 characters of
    the gaps next to the match.  `text` must not be null.  Rows that fail `only_if` aren't searched.
    """
    patterns = list(patterns)
    none = F.array().cast("array<string>")
    found = {
        f"m_{k}": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
        if when is None
        else F.when(when, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none)
        for k, p, when in patterns
    }
    df = df.withColumns(found)
    df = df.withColumns(
        {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split(F.col(text), p, -1)).otherwise(none) for k, p, _ in patterns}
    )
    df = df.withColumns({f"s_{k}": _starts(F.col(f"m_{k}"), F.col(f"g_{k}")) for k, _, _ in patterns})
    df = df.withColumns(
        {f"m_{k}": _structs(F.col(f"m_{k}"), F.col(f"g_{k}"), F.col(f"s_{k}")) for k, _, _ in patterns}
    )
    return df.drop(*[f"{x}_{k}" for k, _, _ in patterns for x in "gs"])


def _starts(m: Column, g: Column) -> Column:
    gap = F.transform(F.slice(g, 1, F.size(m)), F.length)
    moves = F.zip_with(gap, m, lambda a, b: a + F.length(b))
    starts = F.zip_with(exclusive_sums(moves), gap, lambda a, b: a + b)
    return F.when(F.size(m) > 0, starts).otherwise(F.array().cast("array<int>"))


def _structs(m: Column, g: Column, s: Column) -> Column:
    near = F.zip_with(
        F.transform(F.slice(g, 1, F.size(m)), lambda x: F.substring(x, -48, 48)),
        F.transform(F.slice(g, 2, F.size(m)), lambda x: F.substring(x, 1, 48)),
        lambda a, b: F.struct(a.alias("before"), b.alias("after")),
    )
    at = F.zip_with(s, m, lambda a, b: F.struct(a.alias("start"), (a + F.length(b)).alias("end"), b.alias("value")))
    return F.zip_with(
        at, near, lambda a, b: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["value"].alias("value"), b["before"].alias("before"), b["after"].alias("after"))
    )


def merged(kinds: list[str], columns: dict[str, Column]) -> Column:
    """All spans of the kinds, by start and then in the order of `kinds`, with kind and score."""

    def ranked(i: int, kind: str) -> Column:
        return F.transform(
            columns[kind],
            lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["score"].alias("score")),
        )

    return F.array_sort(F.concat(*[ranked(i, k) for i, k in enumerate(kinds)]))


def number(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
