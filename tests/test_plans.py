"""Plan properties of the flagship query: pruning and pushdown reach the scan."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_month_statistics_prune_and_push_down(spark):
    df = E.queries()["a1_month_country_stats"](spark, SF)
    plan = _plan(spark, df)
    scan = plan[plan.index("bookings]"):]
    assert "PartitionFilters: [isnotnull(arrival_year" in scan
    assert "EqualTo(invoiced,true)" in scan
    assert "LessThanOrEqual(arrival,1997-02-28)" in scan
    read = [ln for ln in scan.splitlines() if ln.startswith("ReadSchema")][0]
    assert "recipient" in read and "positions" not in read and "allocs" not in read


def test_tax_table_has_no_exchange(spark):
    df = E.queries()["a7_tax_table"](spark, SF)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
