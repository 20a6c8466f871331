"""Legacy migration rules against a direct Python statement of them, on random rows."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from innkeep.operators import migration as MG
from tests.test_migration_quality import BASE, legacy

amount = st.sampled_from(["", "0", "1", "2", "3", "x", " 2 "])
price = st.sampled_from(["", "0.00", "45.00", "30.5", "12"])
percent = st.sampled_from(["", "100", "150", "200", "abc", "50"])
art = st.sampled_from(["", "Einzelzimmer", "Kurtaxe", "Suite"])
day = st.one_of(st.just(""), st.dates(dt.date(2020, 1, 1), dt.date(2020, 12, 31)).map(str))
slot = st.tuples(amount, art, price, percent)
row = st.tuples(st.lists(slot, min_size=4, max_size=4), st.sampled_from(["", "12", " 7 ", "A"]),
                day, day, day, day, st.sampled_from(["", "Bemerkung", "zwei\nZeilen"]))


def py_int(s):
    s = s.strip()
    return int(s) if s.lstrip("+-").isdigit() and s not in ("+", "-") else None


def py_cents(s):
    s = s.strip()
    if s == "":
        return None
    try:
        import math
        return math.floor(float(s) * 100 + 0.5)
    except ValueError:
        return None


def py_allocs(slots, room):
    out = []
    for i, (amt, a, p, pct) in enumerate(slots, start=1):
        cents = py_cents(p)
        if a.strip() == "Kurtaxe" or cents is None or cents == 0:
            continue
        n = py_int(amt) or 0
        per = py_int(pct)
        beds = int(((per if per is not None else 100) + 99) / 100)
        for j in range(max(n, 0)):
            out.append(((room.strip() if i == 1 else "") if j == 0 else "", cents, beds, a.strip()))
    return out


def py_note(rid, slots, remark):
    head = f"Importiert aus Combit ({rid}).\n\n"
    lines = "".join("" if (a.strip() == "" and p.strip() == "0.00") else
                    f"- {amt.strip()}x {a.strip()} à {p.strip()}€ ({pct.strip()}%)\n"
                    for amt, a, p, pct in slots)
    return (head + lines + "\n" + remark.strip()).strip(" \t\n\r\x0c")


def py_period(avon, abis, anreise, abreise):
    def d(x):
        return dt.date.fromisoformat(x) if x else None
    f = d(avon) or d(anreise)
    t = d(abis) or d(abreise)
    if f is None and t is None:
        return None
    a = f if f is not None else t - dt.timedelta(days=1)
    b = t if t is not None else f + dt.timedelta(days=1)
    return min(a, b), max(a, b)


@settings(max_examples=4, deadline=None, derandomize=True)
@given(st.lists(row, min_size=1, max_size=25))
def test_legacy_rules_match_python(spark, rows):
    recs = []
    for i, (slots, room, avon, abis, anreise, abreise, remark) in enumerate(rows):
        r = dict(BASE, RECORDID=str(i), ZIMMER=room, AVON=avon, ABIS=abis, ANREISE=anreise,
                 ABREISE=abreise, BEMAUFE=remark)
        for k, (amt, a, p, pct) in enumerate(slots, start=1):
            r.update({f"ANZAHL{k}": amt, f"ART{k}": a, f"PREIS{k}": p, f"PROZ{k}": pct})
        recs.append(r)
    _, bookings = MG.migrate(legacy(spark, recs))
    got = {b.id: b for b in bookings.collect()}
    for i, (slots, room, avon, abis, anreise, abreise, remark) in enumerate(rows):
        period = py_period(avon, abis, anreise, abreise)
        if period is None:
            assert i not in got
            continue
        b = got[i]
        assert (b.arrival, b.departure) == period
        assert [(a.room, a.price_per_bed, a.beds, a.description) for a in b.data.allocs] == \
            py_allocs(slots, room)
        assert b.data.note == py_note(i, slots, remark)
