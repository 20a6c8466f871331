"""Money as BIGINT cents.

Decoding a JSON float of whole currency units rounds half up:
``floor(x * 100 + 0.5)``.  Formatting writes the sign once (``-1,50``), an
intended improvement over printing it on both parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cents_of_units(x) -> Column:
    """Whole units (double) -> cents, half up."""
    return F.floor(_c(x) * 100 + F.lit(0.5)).cast("bigint")


def units_of_cents(x) -> Column:
    return _c(x).cast("double") / 100


def format_money(x, sep: str = ",") -> Column:
    """Cents -> text with two decimals: 1234 -> 12,34; -150 -> -1,50."""
    v = _c(x).cast("bigint")
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    # a format string is parsed anew for every amount, which takes most of a letter's time
    text = F.concat(sign, F.floor(a / 100).cast("bigint").cast("string"), F.lit(sep),
                    F.lpad(F.pmod(a, F.lit(100)).cast("string"), 2, "0"))
    return F.when(v.isNotNull(), text)


def format_money_dot(x) -> Column:
    return format_money(x, ".")


def floor_div(x, d) -> Column:
    """Integer division rounding toward minus infinity (``div`` truncates)."""
    x = _c(x)
    d = _c(d) if not isinstance(d, int) else F.lit(d)
    return F.call_function("div", x - F.pmod(x, d), d)


def default_zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0).cast("bigint"))


def nonzero_or_null(x) -> Column:
    x = _c(x)
    return F.when(x != 0, x)
