"""Personal data: expressions propose spans, check digits confirm them, nearby words set the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

# The kinds in their order, base kinds first, and their patterns.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
#: Characters of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE IL TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Forms of PATTERNS that find the same matches in linear time: a match starts at the start of its run or where
#: the last one ended.
FAST = PATTERNS | {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
}
#: (score of a confirmed span, score if a context word stands near)
SCORES = {"email": (0.8, 0.95), "ip": (0.6, 0.9), "card": (0.7, 0.95), "phone": (0.6, 0.9), "iban": (0.8, 0.95), "ssn": (0.5, 0.9)}
#: Context words, in lower case and between other characters than letters and digits.
CONTEXT = {
    "email": "e-?mail|contact|write to|mailto",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|debit|visa|mastercard|amex|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
NO_SSN = r"^(?:000|666|9[0-9][0-9])|-00-|-0000$"


def context(kind: str) -> str:
    return f"(?:^|[^a-z0-9])(?:{CONTEXT[kind]})(?:[^a-z0-9]|$)"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 by mod 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, x: Column) -> Column:
    value = x["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    if kind == "ssn":
        return ~value.rlike(NO_SSN) & ~x["before"].rlike(r"[0-9-]\z") & ~x["after"].rlike("^[0-9-]")
    return F.lit(True)


def _scored(kind: str, x: Column) -> Column:
    sure, surer = SCORES[kind]
    near = [F.translate(x[side], UPPER, LOWER).rlike(context(kind)) for side in ("before", "after")]
    return x.withField("score", F.when(near[0] | near[1], F.lit(surer)).otherwise(F.lit(sure)))


def _judged(kind: str) -> Column:
    return F.transform(F.filter(f"m_{kind}", lambda x: _confirmed(kind, x)), lambda x: _scored(kind, x))


def with_findings(docs: DataFrame, text: Column) -> DataFrame:
    """One row per row of `docs`: row (a struct of its columns), text, and findings.

    findings: array of (start, rank, end, kind, value, score) by start, code points, end exclusive.
    A null text counts as empty and has no findings; repeated rows stay; an empty table stays empty.
    The columns of `docs` are kept in one struct, so no name can clash.  Texts may have any length:
    the expressions take linear time.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    df = df.withColumn("digits", F.col("text").rlike("[0-9][ .-]?[0-9]"))  # where the other kinds have one
    signs = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    signs |= {k: F.col("digits") & F.col("text").rlike(x) for k, x in (("ip", "[0-9][.][0-9]"), ("card", "[0-9][ -]?[0-9]"), ("iban", "[A-Z]{2}[0-9]{2}"), ("ssn", "[0-9]-[0-9]"))}
    df = S.with_matches(df, "text", [(k, FAST[k], signs[k]) for k in KINDS])
    good = {k: _judged(k) for k in KINDS}
    return df.select("row", "text", S.merged(KINDS, good).alias("findings"))


def digest(findings: DataFrame) -> DataFrame:
    """doc_id, counts and spans of each document, from `with_findings`."""
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    df = findings.select(F.col("row.doc_id").alias("doc_id"), "findings", base.alias("base"))
    return df.select(
        "doc_id",
        *[S.number("base", k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"),
        S.written(F.col("findings")).alias("spans"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )


def redact(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """`docs` with each finding in `text` replaced by its kind in brackets; n_chars follows, if there.

    Findings that overlap are covered together, under the kind of the first.  A null text stays null;
    repeated rows stay; an empty table stays empty.  Texts may have any length and number of findings:
    the expressions take linear time.
    """
    df = with_findings(docs, F.col("text")).withColumn("f", F.filter("findings", lambda x: x["score"] >= min_score))
    df = df.withColumn("f", S.united(F.col("f"))).withColumn("chunks", F.when(F.size("f") > 0, S.chunked(F.col("text"))))
    clean = F.when(F.size("f") > 0, _covered(F.col("f"), F.col("chunks"))).otherwise(F.col("text"))
    df = df.select("row", F.when(F.col("row.text").isNotNull(), clean).alias("clean"))
    out = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return df.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _covered(f: Column, chunks: Column) -> Column:
    """The text of `chunks` with the sorted, disjoint spans f replaced."""
    between = F.zip_with(F.concat(F.array(F.lit(0)), f["end"]), F.concat(f["start"], F.array(F.lit(None).cast("int"))), lambda a, b: S.between(chunks, a, b))
    kinds = F.concat(F.transform(f, lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, kinds, lambda a, b: F.concat(a, b)), "")
