"""Registered queries of this package against their SQL at sf0.001."""

import os

import duckdb
import pytest

from innkeep.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    rel = con.execute(Q.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(rel.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op4_pii", "op6_chat"])
def test_native_plans_have_no_python(spark, name):
    plan = Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in Q.queries())
    assert numbers == list(range(1, 14)) and os.path.exists("corpus_pipeline.py")
