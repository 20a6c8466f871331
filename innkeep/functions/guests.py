"""Guest rules: tax payers and registration age categories.

Both use the *departure* date.  A guest is a tax payer when the birth date is
unknown or ``born < departure - 15 years`` (strict).  The registration category
uses the opposite boundary: 7 when ``departure - 6y < born``, 8 when
``departure - 15y < born``, else 1 (unknown birth date -> 1).  A guest born
exactly at the 15-year cut-off is therefore neither tax payer nor category 8.
``add_months`` clips 29 February to 28 February like the original date library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAX_AGE_YEARS = 15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def years_before(day, years: int) -> Column:
    return F.add_months(_c(day), -12 * years)


def is_tax_payer(guest: Column, departure) -> Column:
    """Unknown birth date, or born strictly before departure - 15 years."""
    cutoff = years_before(departure, TAX_AGE_YEARS)
    return guest["born"].isNull() | (guest["born"] < cutoff)


def guest_count(guests="data.guests") -> Column:
    return F.size(_c(guests))


def tax_payer_count(guests="data.guests", departure="departure") -> Column:
    """Number of tax-paying guests of a booking."""
    dep = _c(departure)
    return F.size(F.filter(_c(guests), lambda g: is_tax_payer(g, dep)))


def age_category(born, departure) -> Column:
    """Registration category: '7' under 6, '8' under 15, else '1' (at departure)."""
    b = _c(born)

    def younger(x):
        return b.isNotNull() & (years_before(departure, x) < b)

    return F.when(younger(6), F.lit("7")).when(younger(15), F.lit("8")).otherwise(F.lit("1"))


def guest_is_blank(given, family, born) -> Column:
    """All parts of a guest slot empty."""
    return (F.coalesce(F.trim(_c(given)), F.lit("")) == "") & \
           (F.coalesce(F.trim(_c(family)), F.lit("")) == "") & _c(born).isNull()
