"""Tax codes, their decoding, labels and the local (visitor) tax.

A tax code is stored as ``tax STRING`` plus ``legacy_rate INT``:
``General19`` (19 %), ``Reduced7`` (7 %), ``Reduced7With3EuroDrinks19`` (a split
rule: 3.00 of every unit at 19 %, the rest at 7 %) and ``Legacy`` with its own
rate.  On input a bare integer is accepted: 19 -> General19, 7 -> Reduced7,
any other n -> Legacy n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tax code names, the split rule and its description text.
GENERAL19 = "General19"
REDUCED7 = "Reduced7"
SPLIT = "Reduced7With3EuroDrinks19"
LEGACY = "Legacy"
SPLIT_DRINKS_CENTS = 300          # 3.00 per unit at 19 %, the remainder at 7 %
SPLIT_DESCRIPTION = "Enthält 3,00€ Getränke-Anteil pro Frühstück zu 19%, Rest 7%"

# Local tax per guest and night in cents, by year band and season
# (season = April to October): up to 2021: 0.80 / 2.00; up to 2025: 1.00 / 2.50;
# later: 1.50 / 3.30.
LOCAL_TAX_BANDS = [(2021, 80, 200), (2025, 100, 250), (None, 150, 330)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_tax(raw) -> Column:
    """JSON text of a tax code -> STRUCT<tax STRING, legacy_rate INT>.

    ``19`` / ``7`` / ``n`` (bare integers) or ``["General19"]``, ``["Reduced7"]``,
    ``["Reduced7With3EuroDrinks19"]``, ``["Legacy", n]``.  Unknown text -> null.
    """
    r = F.trim(_c(raw))
    as_int = F.when(r.rlike(r"^-?[0-9]+$"), r.try_cast("int"))
    # the variant form is a JSON array of a code name and an optional integer
    variant = r"^\[\s*\"([A-Za-z0-9]+)\"\s*(?:,\s*(-?[0-9]+)\s*)?\]$"
    code = F.nullif(F.regexp_extract(r, variant, 1), F.lit(""))       # '' when no match
    arr_rate = F.nullif(F.regexp_extract(r, variant, 2), F.lit("")).try_cast("int")
    tax = (F.when(as_int == 19, F.lit(GENERAL19))
           .when(as_int == 7, F.lit(REDUCED7))
           .when(as_int.isNotNull(), F.lit(LEGACY))
           .when(code.isin(GENERAL19, REDUCED7, SPLIT) & arr_rate.isNull(), code)
           .when((code == LEGACY) & arr_rate.isNotNull(), F.lit(LEGACY)))
    rate = (F.when(as_int.isNotNull() & ~as_int.isin(7, 19), as_int)
            .when(as_int.isNull() & (code == LEGACY), arr_rate))
    return F.struct(tax.alias("tax"), rate.cast("int").alias("legacy_rate"))


def encode_tax(tax, legacy_rate) -> Column:
    """Tax code -> its JSON text in variant form."""
    t, r = _c(tax), _c(legacy_rate)
    return (F.when(t == LEGACY, F.format_string('["Legacy",%d]', r))
            .otherwise(F.format_string('["%s"]', t)))


def simple_rate(tax, legacy_rate) -> Column:
    """Percent of a simple code; null for the split rule."""
    t = _c(tax)
    return (F.when(t == GENERAL19, F.lit(19)).when(t == REDUCED7, F.lit(7))
            .when(t == LEGACY, _c(legacy_rate))).cast("int")


def tax_key(tax, legacy_rate) -> Column:
    """Form key of a tax code (round trip with ``tax_of_key``)."""
    t = _c(tax)
    # Form keys of the tax codes.
    return (F.when(t == GENERAL19, F.lit("general19"))
            .when(t == REDUCED7, F.lit("reduced7"))
            .when(t == SPLIT, F.lit("reduced7-3€-drinks19"))
            .when(t == LEGACY, F.format_string("custom%d", _c(legacy_rate))))


def tax_of_key(key) -> Column:
    """Form key -> STRUCT<tax, legacy_rate> (inverse of ``tax_key``)."""
    k = _c(key)
    n = F.regexp_extract(k, r"^custom(-?[0-9]+)", 1)
    tax = (F.when(k == "general19", F.lit(GENERAL19))
           .when(k == "reduced7", F.lit(REDUCED7))
           .when(k == "reduced7-3€-drinks19", F.lit(SPLIT))
           .when(n != "", F.lit(LEGACY)))
    return F.struct(tax.alias("tax"),
                    F.when(n != "", n.try_cast("int")).alias("legacy_rate"))


def tax_label(tax, legacy_rate) -> Column:
    """Form label of a tax code."""
    t = _c(tax)
    # Form labels of the tax codes.
    return (F.when(t == GENERAL19, F.lit("Generell, 19%"))
            .when(t == REDUCED7, F.lit("Reduziert, 7%"))
            .when(t == SPLIT, F.lit("Reduziert, 3€ Getränke"))
            .when(t == LEGACY, F.format_string("%d%% (alt)", _c(legacy_rate))))


def tax_short(tax, legacy_rate) -> Column:
    """Short printed form: 19%, 7%, 7% (*), n%."""
    t = _c(tax)
    return (F.when(t == GENERAL19, F.lit("19%"))
            .when(t == REDUCED7, F.lit("7%"))
            .when(t == SPLIT, F.lit("7% (*)"))
            .when(t == LEGACY, F.format_string("%d%%", _c(legacy_rate))))


def local_tax_cents(day) -> Column:
    """Local tax per guest and night (cents) for a departure date."""
    d = _c(day)
    y, m = F.year(d), F.month(d)
    off_season = (m < 4) | (m > 10)
    out = None
    for upto, off, season in LOCAL_TAX_BANDS:
        value = F.when(off_season, F.lit(off)).otherwise(F.lit(season))
        if upto is None:
            out = value if out is None else out.otherwise(value)
        else:
            out = (F.when(y <= upto, value) if out is None
                   else out.when(y <= upto, value))
    return out.cast("bigint")


def tax_parts(position) -> Column:
    """Position -> ARRAY<STRUCT<rate INT, gross BIGINT>> of taxed amounts (cents)."""
    p = _c(position)
    q = p["quantity"].cast("bigint")
    price = p["price"]
    split = F.array(
        F.struct(F.lit(7).alias("rate"), (q * (price - SPLIT_DRINKS_CENTS)).alias("gross")),
        F.struct(F.lit(19).alias("rate"), (q * F.lit(SPLIT_DRINKS_CENTS)).alias("gross")),
    )
    simple = F.array(F.struct(simple_rate(p["tax"], p["legacy_rate"]).alias("rate"),
                              (q * price).alias("gross")))
    return F.when(p["tax"] == SPLIT, split).otherwise(simple)


def included_tax_cents(gross_sum, rate) -> Column:
    """round_half_up(S * r / (100 + r)) in exact integer arithmetic; null for rates
    of -100 % and below, of which no gross amount can include a tax."""
    from innkeep.functions.money import floor_div
    s, r = _c(gross_sum).cast("bigint"), _c(rate).cast("bigint")
    base = F.when(r > -100, 100 + r)
    return floor_div(2 * s * r + base, 2 * base)
