"""What the legacy export moves of a booking to its customer."""

from innkeep import schemas
from innkeep.sources import legacy as LG


def test_only_the_lines_the_layout_holds_move(spark, tmp_path):
    allocs = [(f"{i}", 100 * i, 2, f"Art {i}") for i in range(1, 8)]
    guests = [(f"G{i}", "N", None) for i in range(1, 9)]
    none = (None, None, None, None)

    def booking(k, guests, allocs):
        return k, 5, None, None, (None, 1234, None, False, "n", guests, allocs, None), None, None
    rows = [booking(1, guests, allocs), booking(2, [], []), booking(3, None, None), booking(6, None, [None, none])]
    customer = (5, None, None, (("Frau", "", "A", "B"), ("", ""), ("Weg 1", "1", "O", "L", "XL"), None, "K", "", None), "K", [])
    spark.createDataFrame(rows, schemas.BOOKINGS).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([customer], schemas.CUSTOMERS).write.parquet(str(tmp_path / "c"))
    out = LG.legacy_rows(spark.read.parquet(str(tmp_path / "b")), spark.read.parquet(str(tmp_path / "c")))
    got = {r["RECORDID"]: r for r in out.collect()}
    assert [got["1"][f"ART{i}"] for i in range(1, 5)] == ["Art 1", "Art 2", "Art 3", "Art 4"]
    assert [got["1"][f"PREIS{i}"] for i in range(1, 5)] == ["1.00", "2.00", "3.00", "4.00"]
    assert (got["1"]["ZIMMER"], got["1"]["P_VORNAME6"], got["1"]["AGEF"], got["1"]["AEING"]) == ("1", "G6", "12.34", "0.00")
    assert [(got[k]["ZIMMER"], got[k]["ART1"], got[k]["PREIS1"], got[k]["ANZAHL1"]) for k in "236"] == [
        ("", "", "0.00", "")] * 3
    assert (got["6"]["PREIS2"], got["6"]["PREIS3"]) == ("", "0.00")
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[1]
    assert below.count("slice(") == 2
