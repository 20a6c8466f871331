"""What the import works out again: files are read once, the room lines in compiled methods."""

import datetime as dt

from innkeep.operators import migration as MG
from innkeep.plans import q_migration as QM
from innkeep.sources import legacy as LG


def _raw(spark, rows):
    base = {"GROUPID": "", "VORNAME": "V", "NAME": "N", "ANREISE": "2020-01-02", "ABREISE": ""}
    return spark.createDataFrame([tuple((base | r).get(c) for c in LG.COLUMNS) for r in rows], LG.LEGACY_SCHEMA)


def test_room_lines_are_not_interpreted(spark):
    """the projection of the room lines is generated apart from its stage, in short methods, and gives the same lines."""
    rows = [{"RECORDID": "1", "ZIMMER": " 7 ", "ANZAHL1": " 3 ", "ART1": "Doppel", "PREIS1": "12.50", "PROZ1": "150",
             "ANZAHL2": "2", "ART2": "Kurtaxe", "PREIS2": "2.00", "ANZAHL3": "1", "ART3": "x", "PREIS3": "0.00",
             "ANZAHL4": "2", "ART4": "y", "PREIS4": "1"},
            {"RECORDID": "2", "ZIMMER": "8", "ANZAHL1": "-2", "ART1": "a", "PREIS1": "1", "ANZAHL2": "1000", "ART2": "b", "PREIS2": "1",
             "ANZAHL3": "999999999999999999999", "ART3": "c", "PREIS3": "1", "ANZAHL4": "+1", "PREIS4": "-1.00", "PROZ4": "100001"},
            {"RECORDID": "3", "ANZAHL1": "x", "PREIS1": "1", "PREIS2": "y", "ANZAHL2": "5"}]
    typed = MG.cast_legacy(_raw(spark, rows))
    lines = typed.select("recordid", MG.legacy_allocs().alias("a"))
    got = {r.recordid: [tuple(x) for x in r.a] for r in lines.collect()}
    assert got == {1: [("7", 1250, 2, "Doppel")] + [("", 1250, 2, "Doppel")] * 2 + [("", 100, 1, "y")] * 2,
                   2: [("", -100, 1, "")], 3: []}
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "array_repeat" in x and "*(" in x.split("Project")[0]]


def test_the_foreign_export_is_read_once(spark, tmp_path, monkeypatch):
    """the file is loaded into a parquet copy, on which all steps run."""
    raw = _raw(spark, [{"RECORDID": str(i), "ANZAHL2": "1", "BEMAUFE": 'a\n"b"'} for i in range(1, 100)])
    monkeypatch.setattr(QM, "legacy_source", lambda *a: raw)
    monkeypatch.setattr(QM, "model_location", lambda *a: str(tmp_path))
    read, reader = [], LG.read_legacy_csv
    monkeypatch.setattr(LG, "read_legacy_csv", lambda *a, **k: read.append(a) or reader(*a, **k))
    problems, rows = QM.c3_import_problems(spark, ""), QM.s3_foreign_export(spark, "")
    for df in (problems, rows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "parquet" in plan
    assert len(read) == 1
    assert sorted(map(tuple, problems.collect())) == [
        (" ", "record id missing or not a number", 2), ("47", "record id occurs several times", 2),
        ("53", "item count or percent out of range", 1), ("94", "record id occurs several times", 2),
        ("n/a", "record id missing or not a number", 2)]
    got = sorted(r.id for r in rows.collect())
    assert got == [i for i in range(1, 100) if i % 41 and i % 43]
    assert {r.arrival for r in rows.collect()} == {dt.date(2020, 1, 2)}
