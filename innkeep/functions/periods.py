"""Period and date helpers (Column -> Column).

A period is a pair of dates whose order is not significant: arrival is the
smaller, departure the larger end; nights are departure - arrival (half open).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# German month names used in report titles.
MONTH_NAMES = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli",
               "August", "September", "Oktober", "November", "Dezember"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def arrival_of(period="data.period") -> Column:
    """Arrival: the smaller end of the stored period (either order)."""
    p = _c(period)
    return F.least(p.getField("a"), p.getField("b"))


def departure_of(period="data.period") -> Column:
    """Departure: the larger end of the stored period."""
    p = _c(period)
    return F.greatest(p.getField("a"), p.getField("b"))


def nights(arrival="arrival", departure="departure") -> Column:
    """Nights of a stay (half open: departure - arrival)."""
    return F.datediff(_c(departure), _c(arrival))


def cover(a_from, a_till, b_from, b_till) -> tuple[Column, Column]:
    """Smallest period covering two periods (the documented contract)."""
    return F.least(_c(a_from), _c(b_from)), F.greatest(_c(a_till), _c(b_till))


def update_period(period, a=None, b=None) -> Column:
    """Replace either endpoint; a missing replacement keeps the old value."""
    p = _c(period)
    new_a = p.getField("a") if a is None else F.coalesce(_c(a), p.getField("a"))
    new_b = p.getField("b") if b is None else F.coalesce(_c(b), p.getField("b"))
    return F.struct(new_a.alias("a"), new_b.alias("b"))


def local_date(d) -> Column:
    """German short date text, unpadded: 1.2.1997."""
    return F.date_format(_c(d), "d.M.yyyy")


def period_text(arrival="arrival", departure="departure", sep: str = "bis") -> Column:
    """Human period text; a shared month/year is written once.

    same day           -> 7.5.2020
    same month & year  -> 1. bis 7.5.2020
    same year          -> 1.5. bis 2.6.2020
    otherwise          -> 1.5.2020 bis 2.1.2021 (also when only the day matches)
    """
    f, t = _c(arrival), _c(departure)
    t_txt = local_date(t)
    same_d = F.dayofmonth(f) == F.dayofmonth(t)
    same_m = F.month(f) == F.month(t)
    same_y = F.year(f) == F.year(t)
    return (F.when(same_d & same_m & same_y, t_txt)
            .when(~same_d & same_m & same_y,
                  F.format_string(f"%d. {sep} %s", F.dayofmonth(f), t_txt))
            .when(~same_d & ~same_m & same_y,
                  F.format_string(f"%d.%d. {sep} %s", F.dayofmonth(f), F.month(f), t_txt))
            .otherwise(F.format_string(f"%s {sep} %s", local_date(f), t_txt)))


def month_start(d) -> Column:
    return F.trunc(_c(d), "MM")


def month_end(d) -> Column:
    return F.last_day(_c(d))


def month_name(d) -> Column:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.element_at(names, F.month(_c(d)))
