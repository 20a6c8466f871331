"""The Lodging facade over stored tables."""

import tempfile

from innkeep.api import Lodging
from innkeep.sources.fixtures import derive_model


def test_facade_round_trip(spark):
    m = derive_model(spark, "/root/testdata/sf0.001")
    path = tempfile.mkdtemp(prefix="lodging-") + "/t"
    Lodging(m.customers, m.bookings, m.invoice_numbers).save(path)
    lodging = Lodging.open(spark, path)
    total = [r for r in lodging.month_stats("1997-02-01").collect() if r.country is None]
    assert len(total) <= 1
    assert lodging.agenda("1997-02-14").count() >= 0
    assert lodging.search_keyword("_customer#0000000").count() > 0
    assert lodging.search_text("machinery").count() > 0
    assert lodging.tax_table().count() > 0
    assert lodging.violations().count() == 0
    assert lodging.interchange().count() == lodging.bookings.count()
    assert lodging.customer_bookings().count() >= lodging.customers.count()


def test_facade_from_legacy_csv(spark):
    from innkeep.sources import legacy as LG
    from tests.test_migration_quality import BASE, legacy
    root = tempfile.mkdtemp(prefix="lodging-csv-")
    rows = [dict(BASE, RECORDID=str(i), GROUPID=str(1 + i % 2), AVON="2020-04-0%d" % i,
                 ABIS="2020-04-1%d" % i, ANZAHL1="1", ART1="Doppelzimmer", PREIS1="50.00",
                 PROZ1="200") for i in range(1, 6)]
    LG.write_legacy_csv(legacy(spark, rows), f"{root}/export.csv", sep=";")
    lodging = Lodging.from_legacy_csv(spark, f"{root}/export.csv", sep=";")
    assert lodging.customers.count() == 2 and lodging.bookings.count() == 5
    lodging.save(f"{root}/tables")
    back = Lodging.open(spark, f"{root}/tables")
    agenda = back.agenda("2020-04-03").collect()
    assert len(agenda) == 3 and {r.kind for r in agenda} == {"arrive", "stay"}
