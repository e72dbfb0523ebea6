"""Operator 6, native: personal data by patterns, checksums and context words.

Patterns propose spans, validators (Luhn, mod-97, ranges, digit counts) confirm them, and words in
the `window` code points around a span raise or lower its score.  Every step is a built-in
expression on one row, so there is no shuffle at all.

Positions: `split` on a pattern gives the texts between the matches that `regexp_extract_all` gives,
so running sums of their lengths are the match positions, in code points.  Patterns are written with
possessive repeats and one starting point a run, which changes no match but keeps the matcher linear
and off the stack on very long runs.

Base kinds are always reported.  Kinds that the method adds (`iban`, `ssn`, and `secret`: access keys,
and values given to passwords, tokens and the like) are reported where their score reaches `threshold`.  Defined results: null text is empty; no span gives zero counts and the
digest of the empty string; rows are independent, so repeated rows repeat their result; extra columns
pass through and the result column replaces one of the same name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of IBANs by country, of the registry and of countries that use them outside it.  A
# span has its country's length, so what follows an IBAN isn't taken into it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BI CF CG DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CM CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_FORMS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# Patterns of the contract, in its order of kinds, then those the method adds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN_FORMS})\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?i:password|passwd|secret|token|api[_-]?key)[\x20\"':=]{1,6}[A-Za-z0-9_+/-]{16,}+",
}
BASE = ("email", "ip", "card", "phone")
#: A text without a match of this has no span of the kind; a cheap look before the pattern itself.
MUST_HAVE = {
    "email": ["@"], "ip": ["."], "phone": ["+"], "ssn": ["-"],
    "secret": ["AKIA", "ASIA", "assw", "ASSW", "ecret", "ECRET", "oken", "OKEN", "api", "Api", "API"],
}
# Scores before context, and words that raise or lower them.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.7}
RAISING = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|visa|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account",
    "ssn": "ssn|social|security",
    "secret": "key|login|user|auth|access",
}
LOWERING = "example|sample|test|version|isbn"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where a string of digits passes: every second digit from the right doubled, 9 taken off."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an IBAN's remainder is 1: the first four characters last, letters as 10 to 35."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97
    return F.aggregate(F.transform(chars, value), F.lit(0), step) == 1


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(IP_PARTS),
    "card": lambda m: F.when(F.char_length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(False),
    "phone": lambda m: F.char_length(digits(m)).between(10, 15),
    "iban": mod97,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    # what is assigned must look drawn at random: digits and letters, no letter or digit four times in a row
    "secret": lambda m: m.rlike(r"^A[KS]IA|[0-9][^\x20\"':=]*[A-Za-z]|[\x20\"':=][^\x20\"':=]*[A-Za-z][^\x20\"':=]*[0-9]") & ~m.rlike(r"([A-Za-z0-9])\1{3}"),
}
#: Matches whose positions are added up together: arrays that grow are copied once a group, not once a match.
GROUP = 256


def proposed(text: Column, kind: str) -> Column:
    """array<struct<gap, value>>: the text before each match of the pattern and the match; last, what is behind them."""
    between = F.split(text, PATTERNS[kind], -1)
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("value"))
    if kind not in MUST_HAVE:
        return pairs
    return F.when(reduce(or_, [F.contains(text, F.lit(w)) for w in MUST_HAVE[kind]]), pairs).otherwise(F.array().cast("array<struct<gap:string,value:string>>"))


def confirmed(pairs: Column, kind: str) -> Column:
    """array<struct<start, end, i>> of the matches that the validator accepts, i their place in `pairs`."""
    none = F.array().cast("array<struct<start:int,end:int,i:int>>")

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.char_length(p["gap"])
        end = start + F.coalesce(F.char_length(p["value"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), a["i"].alias("i")))
        spans = F.when(F.coalesce(VALID[kind](p["value"]) & p["value"].isNotNull(), F.lit(False)), F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), spans.alias("spans"))

    def group(a: Column, g: Column) -> Column:
        part = F.aggregate(F.slice(pairs, g * GROUP + 1, GROUP), F.struct(a["at"].alias("at"), a["i"].alias("i"), none.alias("spans")), step)
        return F.struct(part["at"].alias("at"), part["i"].alias("i"), F.concat(a["spans"], part["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("spans"))
    groups = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / GROUP).cast("int"))
    return F.when(F.size(pairs) > 1, F.aggregate(groups, start, group, lambda a: a["spans"])).otherwise(none)


def scored(pairs: Column, spans: Column, kind: str, order: int, window: int) -> Column:
    """Spans as struct<start, kind_no, end, kind, score>; context words adjust the prior.

    The context is put together from the nearest gaps and matches, of which any three code points or
    more hold a pair, so a span costs the same wherever it is in its text.
    """
    n = window // 3 + 2

    def one(s: Column) -> Column:
        i = s["i"]
        before = F.transform(F.slice(pairs, F.greatest(F.lit(1), i + 1 - n), F.least(F.lit(n), i)), lambda p: F.concat(F.right(p["gap"], F.lit(window)), F.right(p["value"], F.lit(window))))
        behind = F.transform(F.slice(pairs, i + 2, n), lambda p: F.concat(F.left(p["gap"], F.lit(window)), F.left(F.coalesce(p["value"], F.lit("")), F.lit(window))))
        left = F.right(F.concat(F.array_join(before, ""), F.right(F.get(pairs, i)["gap"], F.lit(window))), F.lit(window))
        around = F.lower(F.concat_ws(" ", left, F.left(F.array_join(behind, ""), F.lit(window))))
        raised = F.when(around.rlike(rf"\b(?:{RAISING[kind]})"), 0.3).otherwise(0.0)
        lowered = F.when(around.rlike(rf"\b(?:{LOWERING})\b"), 0.2).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + raised - lowered))
        return F.struct(
            s["start"].alias("start"), F.lit(order).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score")
        )

    return F.transform(spans, one)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", window: int = 40, threshold: float = 0.6) -> DataFrame:
    """All columns of `docs` plus `out`: array<struct<start, kind_no, end, kind, score>> by start, then kind."""
    names = docs.columns
    held = [f"c{i}" for i in range(len(names))]
    body = F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    rows = docs.toDF(*held).select(*held, *[proposed(body, k).alias(f"pairs_{k}") for k in PATTERNS])
    rows = rows.select("*", *[confirmed(F.col(f"pairs_{k}"), k).alias(f"spans_{k}") for k in PATTERNS])
    every = []
    for order, kind in enumerate(PATTERNS):
        with_score = scored(F.col(f"pairs_{kind}"), F.col(f"spans_{kind}"), kind, order, window)
        every.append(with_score if kind in BASE else F.filter(with_score, lambda s: s["score"] >= threshold))
    found = rows.select(*held, F.sort_array(F.concat(*every)).alias("found"))
    columns = [F.col("found" if n == out else h).alias(n) for n, h in zip(names, held, strict=True)]
    return found.select(*columns, *([] if out in names else [F.col("found").alias(out)]))


def redact(docs: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted") -> DataFrame:
    """`text` with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    folded = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("t")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["t"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("t"),
            )
        ),
    )
    return docs.withColumn(out, F.concat(folded["t"], F.substring(body, folded["at"] + 1, F.lit(2**31 - 1))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, counts of base kinds, base_sha256, spans."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind_no"] < len(BASE))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )
