"""Change detection over whole documents."""

import pytest
from pyspark.sql import functions as F

from innkeep.operators import quality as Q

DOC = ("id long, data struct<name:struct<given:string,family:string>,n:int,born:date,tags:array<string>,"
       "rooms:array<struct<no:string,beds:int>>>")


def _rows(spark, *docs):
    return spark.createDataFrame(list(docs), DOC)


def _doc(given="A", family="B", n=1, born=None, tags=("x",), rooms=(("1", 2),), name=True):
    return ((given, family) if name else None, n, born, list(tags) if tags is not None else None,
            list(rooms) if rooms is not None else None)


@pytest.mark.parametrize("one, two, paths", [
    (_doc(), _doc(), None),
    (_doc(), _doc(given="C"), ["name.given"]),
    (_doc(given=None), _doc(given=""), ["name.given"]),
    (_doc(given="1", family=""), _doc(given="", family="1"), ["name.family", "name.given"]),
    (_doc(), _doc(name=False), ["name", "name.family", "name.given"]),
    (_doc(n=None), _doc(n=0), ["n"]),
    (_doc(tags=()), _doc(tags=None), ["tags", "tags.length"]),
    (_doc(tags=("x", "y")), _doc(tags=("y", "x")), ["tags[0]", "tags[1]"]),
    (_doc(tags=("x",)), _doc(tags=("x", None)), ["tags.length", "tags[1]"]),
    (_doc(rooms=(("1", 2), ("2", 2))), _doc(rooms=(("1", 2), ("2", 3))), ["rooms[1].beds"]),
    (_doc(rooms=(("1", 2),)), _doc(rooms=(None,)), ["rooms[0]", "rooms[0].beds", "rooms[0].no"]),
    (_doc(), None, ["data"]),
])
def test_paths(spark, one, two, paths):
    got = Q.changed_documents(_rows(spark, (1, one)), _rows(spark, (1, two))).collect()
    if two is None:
        assert got[0].status == "changed" and "" in got[0].paths
    elif paths is None:
        assert got == []
    else:
        assert [(r.id, r.status, r.paths) for r in got] == [(1, "changed", paths)]


def test_added_removed_and_missing_documents(spark):
    a = _rows(spark, (1, _doc()), (2, None), (3, _doc()), (4, None))
    b = _rows(spark, (1, _doc()), (2, None), (5, _doc()), (6, None))
    got = sorted((r.id, r.status, r.paths) for r in Q.changed_documents(a, b).collect())
    assert got == [(3, "removed", []), (4, "removed", []), (5, "added", []), (6, "added", [])]


def test_documents_move_only_where_they_differ(spark):
    """The documents are read again for the keys that differ, behind a semi join."""
    a = _rows(spark, (1, _doc()), (2, _doc()))
    plan = Q.changed_documents(a, a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
    with pytest.raises(ValueError):
        Q.changed_documents(a, a.select("id", F.lit(1).alias("data")))
