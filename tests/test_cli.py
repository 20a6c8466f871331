"""The batch jobs end to end on a small legacy export."""

import argparse
import os
import tempfile

from innkeep import cli
from innkeep.sources import legacy as LG
from tests.test_migration_quality import BASE, legacy


def test_migrate_backup_restore_stats(spark):
    root = tempfile.mkdtemp(prefix="cli-")
    rows = [dict(BASE, RECORDID=str(i), GROUPID=str(i % 3 + 1), AVON="2020-02-0%d" % (i % 9 + 1),
                 ABIS="2020-02-1%d" % (i % 9), VORNAME=f"G{i}", ANZAHL1="1", ART1="Einzelzimmer",
                 PREIS1="40.00") for i in range(1, 10)]
    LG.write_legacy_csv(legacy(spark, rows), f"{root}/export.csv", sep=";")
    ns = argparse.Namespace
    cli.run(spark, ns(cmd="migrate", csv=f"{root}/export.csv", out=f"{root}/t", sep=";", dialect="iso"))
    c, b = spark.read.parquet(f"{root}/t/customers"), spark.read.parquet(f"{root}/t/bookings")
    assert c.count() == 3 and b.count() == 9
    cli.run(spark, ns(cmd="backup", tables=f"{root}/t", out=f"{root}/bk"))
    cli.run(spark, ns(cmd="restore", backup=f"{root}/bk", out=f"{root}/r", customer_start=100,
                      booking_start=500))
    rc = spark.read.parquet(f"{root}/r/customers")
    assert sorted(r.id for r in rc.collect()) == [100, 101, 102]
    cli.run(spark, ns(cmd="stats", tables=f"{root}/r", month="2020-02-01", out=f"{root}/s"))
    assert spark.read.parquet(f"{root}/s").count() == 0      # migrated stays carry no invoice
    cli.run(spark, ns(cmd="agenda", tables=f"{root}/r", day="2020-02-05", out=f"{root}/a"))
    assert spark.read.parquet(f"{root}/a").count() >= 1
    cli.run(spark, ns(cmd="interchange", tables=f"{root}/r", out=f"{root}/x"))
    assert os.path.isdir(f"{root}/x")


def test_registrations_xml_command(spark):
    root = tempfile.mkdtemp(prefix="cli-xml-")
    rows = [dict(BASE, RECORDID=str(i), GROUPID="1", AVON="2020-03-01", ABIS="2020-03-04",
                 P_VORNAME="Kim", GEB_DAT02="2015-01-01") for i in range(1, 4)]
    LG.write_legacy_csv(legacy(spark, rows), f"{root}/export.csv")
    ns = argparse.Namespace
    cli.run(spark, ns(cmd="migrate", csv=f"{root}/export.csv", out=f"{root}/t", sep=",", dialect="iso"))
    cli.run(spark, ns(cmd="registrations", tables=f"{root}/t", out=f"{root}/xml"))
    back = spark.read.format("xml").option("rowTag", "meldeschein").load(f"{root}/xml")
    assert back.count() == 3
    first = back.select("name", "begleitperson").first()
    assert first.name == "Muster"
