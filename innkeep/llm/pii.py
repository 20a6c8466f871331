"""Personal data: proposed by patterns, confirmed by checksums, scored by context.

Everything is built from Spark SQL functions on the row of the document; there
is no shuffle.  For each kind a pattern proposes leftmost, non-overlapping
matches of the whole text; ``split`` by the same pattern gives the gaps between
them, so positions (code points, end exclusive) are running sums of lengths.
The patterns are written with possessive loops and run-start anchors: they
match exactly what the plain forms match, but neither recurse nor rescan a long
run from each of its characters.

Kinds, in reporting order:

========  ==============================================================
email     address with a dotted domain
ip        four dotted numbers, each at most 255
card      13 to 19 digits (single blanks or hyphens between), Luhn
phone     ``+`` and 9 to 15 digits with the usual separators
iban      country code, check digits, letters and digits to the country's
          length, as a word of its own, mod-97 (added)
secret    long key-like string after a naming word (added by context only)
========  ==============================================================

The first four are *base* kinds: a match that passes its validator is always
reported.  An added kind is reported when its score reaches ``threshold``.  The
score is a prior per kind, plus a bonus for a passed checksum, plus a bonus if
one of the kind's context words stands in the ``window`` characters before it, at most 1.

Defined results: null text counts as empty; a document without personal data
has empty spans; repeated rows are each reported; an empty table gives an empty
result; columns other than the id and the text are not read by ``find`` and are
passed through by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import texts

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = ("email", "ip", "card", "phone")

# fixed values: patterns
# lengths of international account numbers by length, then country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9_])(?:{_IBAN})(?![A-Za-z0-9_])",
    "secret": r"[A-Za-z0-9_+/-]{20,}+",
}
# a cheap test that every match of the kind passes, run before the pattern
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_+/-]{20}"),
}
# fixed values: context words by kind
CONTEXT = {
    "email": r"(?i)(mail|contact|kontakt|correo|courriel)",
    "ip": r"(?i)(ip|host|server|address|login)",
    "card": r"(?i)(card|visa|credit|karte|tarjeta|carte)",
    "phone": r"(?i)(phone|call|tel|mobil|fax)",
    "iban": r"(?i)(iban|account|bank|konto|cuenta|compte)",
    "secret": r"(?i)(token|secret|password|passwd|api[_ -]?key|access[_ -]?key|credential)",
}
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "secret": 0.3}
CHECKSUM_BONUS = 0.4
CONTEXT_BONUS = 0.3
WINDOW = 32
THRESHOLD = 0.6


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn checksum."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
            i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(
                d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number (blanks allowed) passes the mod-97 checksum."""
    s = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(kind: str, text: Column, matches: Column, window: int, threshold: float) -> Column:
    """Validated spans of one kind: array of (kind, start, end, score)."""
    gaps = F.split(text, PATTERNS[kind], -1)
    bonus = CHECKSUM_BONUS if kind in ("card", "iban") else 0.0

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        before = F.right(F.concat(acc["tail"], pair["gap"]), F.lit(window))
        score = F.round(F.least(F.lit(1.0), F.lit(PRIOR[kind] + bonus) + F.when(
            before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)), 2)
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"),
                        end.cast("long").alias("end"), score.alias("score"))
        keep = _valid(kind, pair["hit"])
        if kind not in BASE:
            keep = keep & (score >= threshold)
        return F.struct(end.alias("at"),
                        F.right(F.concat(before, pair["hit"]), F.lit(window)).alias("tail"),
                        F.when(keep, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches,
                       lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    walked = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out")),
        step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, walked).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): spans are (kind, start, end, score), ordered by kind, then start."""
    t = texts(docs, id_col, text_col)
    return _with_spans(t, "text", window, threshold).select("doc_id", "spans")


def _with_spans(df: DataFrame, text_col: str, window: int, threshold: float) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = {f"_hits_{k}": F.when(HINTS[k](t), F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0)))
            .otherwise(F.array().cast("array<string>")) for k in KINDS}
    df = df.withColumns(hits)
    df = df.withColumn("spans", F.concat(*[
        _spans(k, t, F.col(f"_hits_{k}"), window, threshold) for k in KINDS]))
    return df.drop(*hits)


def redact(docs: DataFrame, text_col: str = "text", window: int = WINDOW,
           threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with every span replaced by ``<KIND>``.

    Spans that overlap are replaced together by the kind of the first one (by
    start, then the longer one).  A null text stays null.  Columns named
    ``spans`` or ``_hits_*`` of the input are kept as they are.
    """
    cols = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"),
                       F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = _with_spans(base, "_text", window, threshold)
    order = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind")))

    def step(acc, s):
        gap = F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.array(F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"),
            (-s["neg"]).alias("at"))).otherwise(F.struct(
                acc["out"].alias("out"), F.greatest(acc["at"], -s["neg"]).alias("at")))

    done = F.aggregate(
        F.array_sort(order),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")), step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(
            F.col("_text"), (acc["at"] + 1).cast("int"), F.length("_text"))))
    masked = found.withColumn("_masked", F.when(F.size("spans") > 0, done).otherwise(F.col("_text")))
    return masked.select(*[F.col("_masked").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)
                           for c in cols])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans,
    all spans as text (``kind:start:end``, comma-joined) and their scores in percent."""
    def label(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return find(docs, id_col, text_col).select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
        .alias("scores"))
