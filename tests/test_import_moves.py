"""What the import moves: winners and repeated ids are found on narrow tables."""

import random

from pyspark.sql import functions as F

from innkeep.operators import migration as MG
from innkeep.sources import legacy as LG


def _raw(spark, path, rows):
    cells = [{"RECORDID": r, "GROUPID": g, "VORNAME": v, "NAME": "N", "ANREISE": "2020-01-02", "ABREISE": ""}
             for r, g, v in rows]
    df = spark.createDataFrame([tuple(c.get(x) for x in LG.COLUMNS) for c in cells], LG.LEGACY_SCHEMA)
    df.write.parquet(path)
    return spark.read.schema(LG.LEGACY_SCHEMA).parquet(path)


def _scans(df, path):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [RECORDID")


def test_without_repeated_ids_the_wide_rows_are_read_once(spark, tmp_path):
    raw = _raw(spark, str(tmp_path / "raw"), [("1", "", "a"), ("2", "7", "b"), ("3", "7", "c"), ("x", "7", "d")])
    customers, bookings = MG.migrate(raw)
    assert _scans(customers, raw) == 1 and _scans(bookings, raw) == 1
    assert sorted((r.id, r.data["name"]["given"]) for r in customers.collect()) == [(1, "a"), (7, "c")]
    assert sorted(r.id for r in bookings.collect()) == [1, 2, 3]


def test_winners_with_and_without_the_bitmap(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    rows = [(str(rnd.randrange(300)), rnd.choice(["", " 5 ", str(rnd.randrange(60)), "x"]), f"V{i}") for i in range(600)]
    rows += [rows[3], rows[4], (None, "5", "z"), (" ", "5", "z")]
    raw = _raw(spark, str(tmp_path / "raw"), rows)
    plain = sorted(map(str, MG.migrate_customers(raw).collect()))
    monkeypatch.setattr(MG, "FEW_GROUPS", 0)
    monkeypatch.setattr(MG, "FILTER_BITS", 256)            # many rows share a bit
    assert sorted(map(str, MG.migrate_customers(raw).collect())) == plain
    group: dict = {}
    for r, g, _ in rows:
        if r and r.strip():
            g = g.strip()
            group.setdefault(int(r), []).append(int(g) if g.isdigit() else int(r))
    best: dict = {}
    for r, gs in group.items():
        best[min(gs)] = max(best.get(min(gs), -1), r)
    assert {r.id for r in MG.migrate_customers(raw).collect()} == set(best)


def test_the_bitmap_drops_rows_and_no_wanted_one(spark):
    rows = spark.range(20000).select(F.col("id").alias("groupid"), (F.col("id") * 3).alias("recordid"))
    wanted = rows.where("groupid % 10 = 0")
    left = MG._may_match(rows, wanted, ["groupid", "recordid"])
    assert left.columns == rows.columns and left.where("groupid % 10 = 0").count() == 2000
    assert left.count() < 2200
