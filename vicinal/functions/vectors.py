"""Arithmetic on array columns.

The `*_expr` forms unroll the coordinates into one sum, which stays in generated code; the others
take any length but are interpreted.  Terms are added from the first coordinate to the last, so both
forms give the same doubles.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinates up to which unrolling pays; beyond it the generated code grows too large.
UNROLL = 128


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def element(v: Column, j: Column | int) -> Column:
    """Coordinate j, from 0; null beyond the end."""
    return F.get(v, F.lit(j) if isinstance(j, int) else j)


def flat_index(i: Column, j: Column, ld: Column | int) -> Column:
    """Place of (row i, column j) in a row-major matrix with rows of length ld."""
    return i * ld + j


def sq_l2(x: Column, y: Column) -> Column:
    return _total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def sq_l2_expr(x: Column, y: Column, d: int) -> Column:
    return reduce(add, [(element(x, j) - element(y, j)) * (element(x, j) - element(y, j)) for j in range(d)], F.lit(0.0))


def dot(x: Column, y: Column) -> Column:
    return _total(F.zip_with(x, y, lambda a, b: a * b))


def sq_norm(x: Column) -> Column:
    return _total(F.transform(x, lambda a: a * a))


def expanded_query(x: Column) -> Column:
    """(x, |x|^2, 1), whose product with the `expanded_corpus` of y is |x|^2 + |y|^2 - 2 x.y."""
    return F.concat(x, F.array(sq_norm(x), F.lit(1.0)))


def expanded_corpus(y: Column) -> Column:
    """(-2 y, 1, |y|^2)"""
    return F.concat(F.transform(y, lambda a: a * F.lit(-2.0)), F.array(F.lit(1.0), sq_norm(y)))


def dims(v: Column, d: int | None) -> Column:
    """The first d coordinates; all if d is None."""
    return v if d is None else F.slice(v, 1, d)


def digits(i: Column, base: int, d: int) -> Column:
    """The d lowest digits of i in a base, the lowest first, as doubles."""
    return F.array(*[F.pmod(F.floor(i / F.lit(base**c)), F.lit(base)).cast("double") for c in range(d)])


def rendered(v: Column, width: int = 28) -> Column:
    """Rows of `width` coordinates as text: whole numbers of three characters, longer ones in full."""
    cell = lambda x: F.lpad(x, F.greatest(F.length(x), F.lit(3)), F.lit(" "))
    cells = F.transform(v, lambda x: cell(x.cast("int").cast("string")))
    starts = F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1)
    rows = F.transform(starts, lambda r: F.array_join(F.slice(cells, r * width + 1, width), " "))
    return F.when(F.size(v) > 0, F.array_join(rows, "\n")).otherwise("")


def ranges_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether the half-open ranges [a0, a1) and [b0, b1) share an element."""
    return (a0 < b1) & (b0 < a1)
