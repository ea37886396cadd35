"""Secret scan over a trigram inverted index.

Each rule's expression yields a Boolean query over the trigrams that any match must contain.  The
postings of those trigrams are intersected and united by the query; only the texts that remain are
verified with the expression.  Rules without a mandatory trigram are run over every text.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import checkpointed

#: Candidate texts (16 to 100 bytes each) up to which their list is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 100_000
_EXACT = 64
#: Trigrams of a string that are looked up.
EACH = 3


@dataclass(frozen=True)
class Rule:
    """`pattern` proposes; a match stays if group `group` has at least `least` characters.

    `scan` is an expression for the scan that finds the same matches faster, if there is one.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str | None = None
    score: float = 0.9


def either_case(pattern: str) -> str:
    """`pattern`, whose only letters are literal ones, with a class of both cases for each ASCII letter."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in pattern)


# The base rules in their order, then those that this operator adds.
BASE = [
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, score=0.7),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"(?<![0-9a-f])[0-9a-f]{24,}+", 0.5),
]
RULES = [
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]


# -- Boolean queries: True, a trigram, or ("and" | "or", parts) ---------------------------------
def _join(op: str, parts: list):
    parts = list(dict.fromkeys(parts))
    if op == "or" and True in parts:
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]):
    """What a text that has one of the strings must contain; a string that has another one adds nothing."""
    least = [s for s in sorted(strings) if not any(t in s for t in strings - {s})]
    return _join("or", [_join("and", _spread([s[i : i + 3] for i in range(len(s) - 2)])) for s in least])


def _spread(trigrams: list[str]) -> list[str]:
    """At most EACH of a string's trigrams, first and last ones included; more rule little out."""
    n = len(trigrams)
    return trigrams if n <= EACH else [trigrams[i * (n - 1) // (EACH - 1)] for i in range(EACH)]


def _of_node(op, arg) -> tuple[set[str] | None, object]:
    """The strings that a node can match, if few, and what any match requires."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}, True
        return None, True
    if op is sre.SUBPATTERN:
        return _of_sequence(arg[-1])
    if op is sre.BRANCH:
        found = [_of_sequence(x) for x in arg[1]]
        if all(x is not None for x, _ in found) and len(every := set().union(*(x for x, _ in found))) <= _EXACT:
            return every, True
        return None, _join("or", [q if x is None else _of_strings(x) for x, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, item = arg
        exact, query = _of_sequence(item)
        if exact is not None and high <= 1:
            return exact | ({""} if low == 0 else set()), True
        if exact is not None and low == high and len(exact) == 1:
            return {next(iter(exact)) * int(low)}, True
        return None, True if low == 0 else query if exact is None else _of_strings(exact)
    if op in (sre.ASSERT, sre.ASSERT_NOT, sre.AT):
        return {""}, True
    return None, True


def _of_sequence(nodes) -> tuple[set[str] | None, object]:
    held, needs, whole = {""}, [], True
    for op, arg in nodes:
        exact, query = _of_node(op, arg)
        if exact is not None and len(held) * len(exact) <= _EXACT:
            held = {a + b for a, b in product(held, exact)}
            continue
        whole = False
        needs += [_of_strings(held), query if exact is None else _of_strings(exact)]
        held = {""}
    return (held, True) if whole else (None, _join("and", [*needs, _of_strings(held)]))


def trigram_query(pattern: str):
    """What the lower-cased text of any match of `pattern` must contain; True if nothing."""
    exact, query = _of_sequence(sre.parse(pattern))
    return query if exact is None else _of_strings(exact)


def _trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _evaluated(query, has: Column, ids: dict[str, int]) -> Column:
    if isinstance(query, str):
        return F.array_contains(has, ids[query])
    out = _evaluated(query[1][0], has, ids)
    for q in query[1][1:]:
        more = _evaluated(q, has, ids)
        out = out & more if query[0] == "and" else out | more
    return out


# -- the index ----------------------------------------------------------------------------------
def postings(texts: DataFrame, ids: dict[str, int]) -> DataFrame:
    """(trigram, key) for the wanted trigrams of each text; texts has key and text (not null)."""
    low = texts.select("key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for t, i in ids.items()]))
    return low.select("key", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, object], ids: dict[str, int]) -> DataFrame:
    """(key, rules) of the texts whose postings satisfy the query of at least one rule."""
    by_text = index.groupBy("key").agg(F.collect_set("trigram").alias("has"))
    passed = F.array_compact(F.array(*[F.when(_evaluated(q, F.col("has"), ids), F.lit(r)) for r, q in queries.items()]))
    return by_text.select("key", passed.alias("rules")).where(F.size("rules") > 0)


def with_findings(docs: DataFrame, text: Column, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of `docs`: row (a struct of its columns), text, and findings.

    findings: array of (start, rank, end, kind, value, score) by start, code points, end exclusive.
    A null text counts as empty and has no findings; repeated rows stay; an empty table stays empty.
    The columns of `docs` are kept in one struct, so no name can clash.  Texts may have any length:
    the expressions take linear time.
    """
    rules = RULES if rules is None else rules
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    ids = {t: i for i, t in enumerate(sorted(set().union(*map(_trigrams, queries.values()))))}
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    df = df.withColumn("key", F.xxhash64("text"))
    if queries:
        found = checkpointed(candidates(postings(df.select("key", "text"), ids), queries, ids), slim=True)
        df = df.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "key", "left")
    else:
        df = df.withColumn("rules", F.array().cast("array<int>"))
    df = df.withColumn("rules", F.coalesce("rules", F.array().cast("array<int>")))
    df = S.with_matches(
        df, "text", [(r.kind, r.scan or r.pattern, F.array_contains("rules", i) if i in queries else None) for i, r in enumerate(rules)]
    )
    good = {r.kind: _verified(r) for r in rules}
    return df.select("row", "text", S.merged([r.kind for r in rules], good).alias("findings"))


def _verified(rule: Rule) -> Column:
    part = lambda x: x["value"] if rule.group == 0 else F.regexp_extract(x["value"], rule.pattern, rule.group)
    kept = F.filter(f"m_{rule.kind}", lambda x: F.length(part(x)) >= rule.least)
    return F.transform(kept, lambda x: x.withField("score", F.lit(rule.score)))


def digest(findings: DataFrame) -> DataFrame:
    """doc_id, counts and spans of each document, from `with_findings` with the standard rules."""
    df = findings.select(F.col("row.doc_id").alias("doc_id"), "findings", F.filter("findings", lambda x: x["rank"] < len(BASE)).alias("base"))
    return df.select(
        "doc_id",
        *[S.number("base", r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"),
        S.written(F.col("findings")).alias("spans"),
    )
