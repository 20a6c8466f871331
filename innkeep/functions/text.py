"""Text helpers: search tokens, customer texts, salutations and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innkeep.functions.money import format_money

# Tokens: maximal runs of letters and digits of the lower-cased text ("simple"
# configuration: no stemming, no stop words).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Salutation lookup title -> letter greeting.
LETTER_BY_TITLE = [
    ("Herrn", "Sehr geehrter Herr"),
    ("Herrn und Frau", "Sehr geehrte Frau, sehr geehrter Herr"),
    ("Frau", "Sehr geehrte Frau"),
    ("Herrn Dr.", "Sehr geehrter Herr Dr."),
    ("Frau Dr.", "Sehr geehrte Frau Dr."),
    ("Familie", "Liebe Familie"),
]

# Room descriptions offered by the booking form.
ROOM_DESCRIPTIONS = ["Einzelzimmer", "Doppelzimmer", "Dreibettzimmer", "Vierbettzimmer",
                     "Doppel- als Einzelzimmer", "Kurtaxe"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-cased letter/digit tokens of a text, in order (duplicates kept)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


# Stands between the leaves of a document; no query word contains it, so a phrase
# cannot match across two leaves.
LEAF_END = "\x1f"


def leaf_tokens(data="data") -> Column:
    """Search tokens of a customer document, a ``LEAF_END`` after every leaf but the last."""
    return F.regexp_extract_all(F.lower(customer_text(data)), F.lit(TOKEN_PATTERN + "|" + LEAF_END), 0)


def customer_text(data="data") -> Column:
    """All string leaves of a customer document, joined by ``LEAF_END``."""
    d = _c(data)
    leaves = [d["name"][f] for f in ("title", "letter", "given", "family")]
    leaves += [d["company"][f] for f in ("name", "address")]
    leaves += [d["address"][f] for f in ("street_with_num", "postal_code", "city", "country",
                                         "country_code")]
    leaves += [d["contact"][f] for f in ("phone", "phone2", "mobile", "fax", "fax2", "mail",
                                         "mail2", "web")]
    leaves += [d["keyword"], d["note"]]
    return F.concat_ws(LEAF_END, *[F.coalesce(x, F.lit("")) for x in leaves])


def letter_for_title(title) -> Column:
    """Letter greeting for a title; null when the title is not in the lookup."""
    m = F.create_map(*[F.lit(x) for pair in LETTER_BY_TITLE for x in pair])
    return F.try_element_at(m, _c(title))


def recipient_block(data="data") -> Column:
    """Three-line recipient: name / street / code-postcode city."""
    d = _c(data)
    return F.format_string("%s %s\n%s\n%s-%s %s", d["name"]["given"], d["name"]["family"],
                           d["address"]["street_with_num"], d["address"]["country_code"],
                           d["address"]["postal_code"], d["address"]["city"])


def alloc_phrase(alloc: Column) -> Column:
    """'2 Personen im Doppelzimmer zu je 45,00 € pro Nacht' (singular below 2 beds)."""
    one = alloc["beds"] < 2
    return F.format_string("%d %s im %s %s %s € pro Nacht", alloc["beds"],
                           F.when(one, F.lit("Person")).otherwise(F.lit("Personen")),
                           alloc["description"],
                           F.when(one, F.lit("für")).otherwise(F.lit("zu je")),
                           format_money(alloc["price_per_bed"]))


def blank_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.trim(c) != "", c)


def coalesce_blank(prefer, fallback) -> Column:
    """``prefer`` unless it is empty text, else ``fallback``."""
    p = _c(prefer)
    return F.when(F.coalesce(p, F.lit("")) == "", _c(fallback)).otherwise(p)
