"""The queries in DuckDB's SQL, written without regard to how the operators find their rows."""

from __future__ import annotations

from . import licenses, pii, secrets, suffixes

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- spans of expressions -----------------------------------------------------------------------
def _matches(rank: int, kind: str, pattern: str, kept: str, score: str) -> str:
    """Rows (r, start, rank, stop, kind, score) of one kind: matches and the gaps between them give the places;
    v is the match, before and after are the ends of the gaps next to it."""
    p = quoted(pattern)
    return f"""SELECT r, start, {rank} AS rank, start + length(v) AS stop, '{kind}' AS kind, CAST({score} AS DOUBLE) AS score
FROM (SELECT r, m[i] AS v, right(g[i], 48) AS before, left(g[i + 1], 48) AS after,
  coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS start
 FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i
  FROM (SELECT r, regexp_extract_all(x, {p}) AS m, string_split_regex(x, {p}) AS g FROM t WHERE regexp_matches(x, {p}))))
WHERE {kept}"""


def _digest(parts: list[str], base: list[str], more: str) -> str:
    written = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents), s AS ({' UNION ALL '.join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({written} FILTER (rank < {len(base)}), '')) AS base_sha256, coalesce({written}, '') AS spans{more}
FROM t LEFT JOIN s USING (r) GROUP BY r, doc_id"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({_DIGITS}[len({_DIGITS}) - i] AS INT)
 ELSE (2 * CAST({_DIGITS}[len({_DIGITS}) - i] AS INT)) // 10 + (2 * CAST({_DIGITS}[len({_DIGITS}) - i] AS INT)) % 10 END)) % 10 = 0"""
#: An IBAN's characters from the fifth on, then the first four, letters as numbers from 10.
_NUMBER = """array_to_string(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"""
_MOD97 = f"substr({_NUMBER}, 1, 30)"
for _first in (31, 61):  # in steps that a number of 38 digits holds
    _MOD97 = f"CAST(CAST({_MOD97} AS HUGEINT) % 97 AS VARCHAR) || substr({_NUMBER}, {_first}, 30)"
_MOD97 = f"CAST({_MOD97} AS HUGEINT) % 97 = 1"
_CONFIRMED = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(v, '.'), lambda y: CAST(right('0' || ltrim(y, '0'), 4) AS INT) + 1000 * CAST(length(ltrim(y, '0')) > 3 AS INT))) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": _MOD97,
    "ssn": f"NOT regexp_matches(v, {quoted(pii.NO_SSN)}) AND NOT regexp_matches(before, '[0-9-]\\z') AND NOT regexp_matches(after, '^[0-9-]')",
}


def _scored(kind: str) -> str:
    near = " OR ".join(f"regexp_matches(translate({side}, '{pii.UPPER}', '{pii.LOWER}'), {quoted(pii.context(kind))})" for side in ("before", "after"))
    return f"CASE WHEN {near} THEN {pii.SCORES[kind][1]} ELSE {pii.SCORES[kind][0]} END"


SQL["op3_pii"] = _digest(
    [_matches(i, k, pii.PATTERNS[k], _CONFIRMED[k], _scored(k)) for i, k in enumerate(pii.KINDS)], pii.BASE, ", coalesce(max(score), 0.0::DOUBLE) AS max_score"
)
SQL["op5_secrets"] = _digest(
    [_matches(i, r.kind, r.pattern, f"length(regexp_extract(v, {quoted(r.pattern)}, {r.group})) >= {r.least}", str(r.score)) for i, r in enumerate(secrets.RULES)],
    [r.kind for r in secrets.BASE], "",
)

# -- repeated passages --------------------------------------------------------------------------
_N = suffixes.LENGTH
_LEADS = lambda column, n, step: " || ' ' || ".join(f"lead({column}, {i * step}) OVER o" if i else column for i in range(n))
#: Runs of 10 words, then five of them, give the windows of LENGTH words.
SQL["op8_repeats"] = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{pii.UPPER}', '{pii.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
w AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM t WHERE len(w) >= {_N}),
ten AS (SELECT r, i, n, md5({_LEADS('word', 10, 1)}) AS h FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
whole AS (SELECT r, i, n, md5({_LEADS('h', _N // 10, 10)}) AS h FROM ten WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, min(r) OVER (PARTITION BY h) AS a, max(r) OVER (PARTITION BY h) AS b FROM whole WHERE i + {_N} <= n) WHERE a <> b),
parts AS (SELECT r, i, sum(CAST(coalesce(i > before + {_N}, true) AS INT)) OVER (PARTITION BY r ORDER BY i) AS part FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice)),
spans AS (SELECT r, min(i) AS first, max(i) + {_N} AS after FROM parts GROUP BY r, part)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, CAST(coalesce(sum(after - first), 0) AS BIGINT) AS n_repeated, coalesce(string_agg(first || ':' || after, ',' ORDER BY first), '') AS spans
FROM t LEFT JOIN spans USING (r) GROUP BY r, doc_id"""

# -- licenses -----------------------------------------------------------------------------------
def _rows(rows: list[tuple]) -> str:
    """A VALUES list; tuples in a row are lists of words."""
    shown = lambda x: quoted(x) if isinstance(x, str) else "[" + ", ".join(map(quoted, x)) + "]" if isinstance(x, tuple) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


_TEXTS = [(n, t.label, tuple(t.text.split())) for n, t in enumerate(licenses.TEMPLATES)]
_KEYS = [(n, k, tuple(key.split())) for n, t in enumerate(licenses.TEMPLATES) for k, key in enumerate(t.keys)]
SQL["op10_licenses"] = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{pii.UPPER}', '{pii.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
texts AS (SELECT * FROM {_rows(_TEXTS)} x(n, label, w)), keys AS (SELECT * FROM {_rows(_KEYS)} x(n, k, w)),
phrases AS (SELECT * FROM {_rows([(tuple(p.split()), label) for p, label in licenses.PHRASES.items()])} x(w, label)),
tw AS (SELECT n, unnest(w) AS word, unnest(range(len(w))) AS j FROM texts),
known AS (SELECT DISTINCT word FROM (SELECT word FROM tw UNION ALL SELECT unnest(w) FROM phrases)),
hits AS (SELECT r, word, i FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM t) SEMI JOIN known USING (word)),
idf AS (SELECT word, count(DISTINCT r) AS df, ln((1 + (SELECT count(*) FROM t)) / (1 + count(DISTINCT r))) + 1 AS idf FROM known LEFT JOIN hits USING (word) GROUP BY word),
base AS (SELECT r, i, label FROM hits JOIN phrases p ON word = p.w[1] JOIN t USING (r) WHERE t.w[i + 1 : i + len(p.w)] = p.w),
stands AS (SELECT r, n, k, i FROM hits JOIN keys p ON word = p.w[1] JOIN t USING (r) WHERE t.w[i + 1 : i + len(p.w)] = p.w),
own AS (SELECT keys.n, k, j FROM keys JOIN texts USING (n), unnest(range(len(texts.w))) u(j) WHERE texts.w[j + 1 : j + len(keys.w)] = keys.w),
needed AS (SELECT n, count(*) AS c FROM keys GROUP BY n),
open AS (SELECT r, n FROM stands JOIN needed USING (n) GROUP BY r, n, c HAVING count(DISTINCT k) = c),
looked AS (SELECT r, n, word FROM (SELECT DISTINCT r, n, word, df FROM open JOIN tw USING (n) JOIN hits USING (r, word) JOIN idf USING (word))
 QUALIFY row_number() OVER (PARTITION BY r, n ORDER BY df, word) <= {licenses.LOOKED_UP}),
meet AS (SELECT r, n, i - j AS p FROM looked JOIN tw USING (n, word) JOIN hits USING (r, word) GROUP BY ALL HAVING count(DISTINCT word) >= {licenses.MEET}),
true_ AS (SELECT r, n, p FROM meet JOIN stands USING (r, n) JOIN own USING (n, k) JOIN needed USING (n) WHERE abs(i - j - p) <= {licenses.DRIFT} GROUP BY r, n, p, c HAVING count(DISTINCT k) = c),
weight AS (SELECT n, sum(idf) AS whole FROM tw JOIN idf USING (word) GROUP BY n),
share AS (SELECT r, n, p, sum(idf) AS found FROM (SELECT DISTINCT r, n, p, j, idf FROM true_ JOIN tw USING (n) JOIN hits USING (r, word) JOIN idf USING (word) WHERE abs(i - j - p) <= {licenses.DRIFT}) GROUP BY ALL),
more AS (SELECT r, label, max(least(1, found / whole)) AS share FROM share JOIN weight USING (n) JOIN texts USING (n) WHERE found / whole >= {licenses.LEAST_SHARE} GROUP BY r, label),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
m AS (SELECT r, list(label) AS labels, max(share) AS share FROM more GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
 round(greatest(CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END, coalesce(share, 0::DOUBLE)), 6) AS score
FROM t LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""

# -- fingerprints -------------------------------------------------------------------------------
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = 2**64
_SEED = 42


def _n(x: int | str) -> str:
    return f"{x}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_n(_M - 1)})"


def _times(x: str, y: int) -> str:
    return _low(f"({x}) * {_n(y)}")


def _turned(x: str, r: int) -> str:
    return _low(f"(({x}) << {r}) | (({x}) >> {64 - r})")


def _word(at: str, size: int) -> str:
    """A little-endian number of `size` bytes of the hexadecimal string x, from byte `at`."""
    return "CAST('0x' || " + " || ".join(f"substr(x, 2 * (({at}) + {j}) + 1, 2)" for j in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_low(f"{acc} + {_times(lane, _P2)}"), 31), _P1)


def _chain(source: str, steps: list[tuple[str, str]]) -> str:
    """Nested selects, of which each replaces a column by an expression of those before."""
    for column, value in steps:
        source = f"(SELECT * REPLACE ({value} AS {column}) FROM {source})"
    return source


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE h END"


_STRIPE = ", ".join(f"{_round(f'v{i}', _word(f'32 * k + {8 * i}', 8))}" for i in range(4))
_TAIL = [
    ("h", _when(f"n - pos >= {8 * (j + 1)}", _low(f"{_times(_turned(f'xor(h, {_round(_n(0), _word(f'pos + {8 * j}', 8))})', 27), _P1)} + {_n(_P4)}"))) for j in range(3)
] + [
    ("pos", "pos + (n - pos) // 8 * 8"),
    ("h", _when("n - pos >= 4", _low(f"{_times(_turned(f'xor(h, {_times(_word('pos', 4), _P1)})', 23), _P2)} + {_n(_P3)}"))),
    ("pos", "pos + (n - pos) // 4 * 4"),
    *[("h", _when(f"n - pos >= {j + 1}", _times(_turned(f"xor(h, {_times(_word(f'pos + {j}', 1), _P5)})", 11), _P1))) for j in range(3)],
    *[("h", step) for step in ("xor(h, h >> 33)", _times("h", _P2), "xor(h, h >> 29)", _times("h", _P3), "xor(h, h >> 32)")],
]
_MERGED = [("h", _low(" + ".join(_turned(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18)))))] + [
    ("h", _low(f"{_times(f'xor(h, {_round(_n(0), f'v{i}')})', _P1)} + {_n(_P4)}")) for i in range(4)
]
SQL["op4_simhash"] = f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{pii.UPPER}', '{pii.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
w AS (SELECT r, len(w) AS c, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
sh AS (SELECT r, concat_ws(' ', word, CASE WHEN c > 1 THEN lead(word) OVER o END, CASE WHEN c > 2 THEN lead(word, 2) OVER o END) AS s, c, i FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, hex(encode(s)) AS x FROM sh WHERE i = 0 OR i + 3 <= c),
d AS (SELECT DISTINCT x, length(x) // 2 AS n FROM s),
stripes AS (SELECT x, n, 0 AS k, {_n((_SEED + _P1 + _P2) % _M)} AS v0, {_n((_SEED + _P2) % _M)} AS v1, {_n(_SEED)} AS v2, {_n((_SEED - _P1) % _M)} AS v3 FROM d WHERE n >= 32
 UNION ALL SELECT x, n, k + 1, {_STRIPE} FROM stripes WHERE 32 * (k + 1) <= n),
starts AS (SELECT x, n, n // 32 * 32 AS pos, h FROM {_chain(f'(SELECT *, {_n(0)} AS h FROM stripes WHERE 32 * (k + 1) > n)', _MERGED)}
 UNION ALL SELECT x, n, 0, {_n((_SEED + _P5) % _M)} FROM d WHERE n < 32),
hashed AS (SELECT x, CAST(h AS UBIGINT) AS h FROM {_chain(f'(SELECT x, n, pos, {_low("h + n::UHUGEINT")} AS h FROM starts)', _TAIL)}),
prints AS (SELECT t.r, doc_id, coalesce(fp, 0) AS fp FROM t LEFT JOIN (SELECT r, {' + '.join(f'(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)' for b in range(64))} AS fp
 FROM s JOIN hashed USING (x) GROUP BY r) f ON f.r = t.r),
own AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM own a JOIN own b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach AS (SELECT fp, fp AS other FROM own UNION SELECT reach.fp, b FROM reach JOIN links ON a = other),
named AS (SELECT reach.fp, min(least) AS component_id FROM reach JOIN own ON own.fp = other GROUP BY reach.fp)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)"""
