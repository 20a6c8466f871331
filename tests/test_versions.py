"""Versioned tables: batches, replays, races, readers and clean-up."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from innkeep.operators import quality as Q
from innkeep.sources import shared
from innkeep.sources import versions as V

DAY = dt.datetime(2024, 1, 1)
CHANGE = "id long, op string, ts timestamp_ntz, change_id long, keyword string"


def _table(spark, n=100, block_rows=10):
    root = tempfile.mkdtemp(prefix="versions-") + "/customers"
    rows = spark.range(n).select("id", F.format_string("kw-%d", "id").alias("keyword"),
                                 F.lit(DAY).cast("timestamp_ntz").alias("modified"))
    V.create(spark, root, rows, block_rows=block_rows)
    return root


def _change(spark, *rows):
    return spark.createDataFrame([(i, op, DAY + dt.timedelta(days=d), d, kw) for i, op, d, kw in rows], CHANGE)


def _files(spark, root, version):
    return {r.block: r.path for r in V.files(spark, root, version).collect()}


def _content(spark, root, version=None):
    return {r.id: (r.keyword, r.modified) for r in V.read(spark, root, version).collect()}


def test_batches_replay_and_untouched_files(spark):
    root = _table(spark)
    first = _change(spark, (5, "update", 1, "five"), (5, "update", 2, "FIVE"), (203, "insert", 1, "new"))
    second = _change(spark, (5, "delete", 3, None), (42, "update", 3, "answer"))
    assert V.commit(spark, root, first, Q.apply_changes, "web", 1) == 1
    assert V.commit(spark, root, second, Q.apply_changes, "web", 2) == 2
    assert V.commit(spark, root, first, Q.apply_changes, "web", 1) == 2      # replayed: nothing happens
    assert V.versions(spark, root) == [0, 1, 2]
    v0, v1, v2 = (_files(spark, root, n) for n in range(3))
    assert {b for b in v1 if v0.get(b) != v1[b]} == {0, 20}                  # only touched blocks were rewritten
    assert {b for b in v2 if v1.get(b) != v2[b]} == {0, 4}
    now = _content(spark, root)
    assert 5 not in now and now[42] == ("answer", DAY + dt.timedelta(days=3)) and now[203][0] == "new" and len(now) == 100
    assert _content(spark, root, 1)[5] == ("FIVE", DAY + dt.timedelta(days=2))   # older versions stay whole
    assert _content(spark, root, 0) == {i: (f"kw-{i}", DAY) for i in range(100)}


def test_random_batches_equal_one_big_batch(spark):
    rnd = random.Random(4)
    root = _table(spark, 40, 7)
    changes = [(rnd.randint(-5, 60), rnd.choice(["insert", "update", "delete"]), d, f"c{d}") for d in range(1, 60)]
    base = V.read(spark, root, 0)
    for n, at in enumerate(range(0, 59, 20)):
        V.commit(spark, root, _change(spark, *changes[at:at + 20]), Q.apply_changes, "w", n)
    want = {r.id: (r.keyword, r.modified) for r in Q.apply_changes(base, _change(spark, *changes)).collect()}
    assert _content(spark, root) == want


def test_a_lost_race_is_made_again_on_the_newer_version(spark):
    root = _table(spark)
    mine, other = _change(spark, (1, "update", 1, "mine")), _change(spark, (1, "delete", 2, None), (2, "update", 2, "other"))
    raced = []

    def merge(rows, batch):
        if not raced:                                    # somebody publishes while this commit is under way
            raced.append(V.commit(spark, root, other, Q.apply_changes, "b", 1))
        return Q.apply_changes(rows, batch)
    assert V.commit(spark, root, mine, merge, "a", 1) == 2
    now = _content(spark, root)
    assert (now[1][0], now[2][0]) == ("mine", "other")
    with pytest.raises(V.Conflict):
        V.commit(spark, root, mine, lambda rows, batch: (
            V.commit(spark, root, other, Q.apply_changes, "b", V.latest(spark, root) + 9), Q.apply_changes(rows, batch))[1], "a", 2, tries=2)


def test_readers_keep_the_version_they_opened(spark):
    root = _table(spark)
    reader = V.read(spark, root)
    V.commit(spark, root, _change(spark, *[(i, "delete", 1, None) for i in range(100)]), Q.apply_changes, "w", 1)
    assert reader.count() == 100 and V.read(spark, root).count() == 0
    V.commit(spark, root, _change(spark, (7, "insert", 2, "back")), Q.apply_changes, "w", 2)
    assert _content(spark, root) == {7: ("back", DAY + dt.timedelta(days=2))}


def test_find_opens_only_the_blocks_of_the_ids(spark):
    root = _table(spark)
    found = V.find(spark, root, [15, 93, 1000])
    assert sorted(r.id for r in found.collect()) == [15, 93]
    assert {int(p.split("block=")[1].split("/")[0]) for p in found.inputFiles()} == {1, 9}
    assert V.find(spark, root, [1000]).count() == 0


def test_expire_keeps_what_is_listed(spark):
    root = _table(spark)
    for n in range(1, 5):
        V.commit(spark, root, _change(spark, (1, "update", n, f"n{n}")), Q.apply_changes, "w", n)
    before = _content(spark, root)
    spark.range(1).write.parquet(f"{root}/data/commit=abc")           # left by a commit that lost
    assert V.expire(spark, root, keep=2) == []                        # all are young
    gone = V.expire(spark, root, keep=2, older_than_ms=-1)
    assert "commit=abc" in gone and len(gone) == 3                    # two overwritten commits and the lost one
    assert V.versions(spark, root) == [3, 4] and _content(spark, root) == before
    assert len(os.listdir(f"{root}/data")) == len(shared.names(spark, f"{root}/data")) == 3


def test_rows_without_an_id_are_refused(spark):
    with pytest.raises(ValueError):
        V.create(spark, tempfile.mkdtemp() + "/t", spark.createDataFrame([(None, 1)], "id long, x int"))


def test_last_stays_are_kept_through_batches(spark, tmp_path):
    """Deletes of the maximum and of others, moves between customers, a hot customer, replays."""
    import datetime as dt
    import random

    from innkeep.operators import stays
    rnd = random.Random(4)
    schema = "id long, customer long, arrival date, departure date"

    def row(i):
        a = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 40))
        return (i, rnd.choice([1, 1, 1, 2, 3, 4, 5, 6]), a, a + dt.timedelta(days=rnd.randint(0, 3)))
    now = {i: row(i) for i in range(60)}
    root = str(tmp_path / "last")
    V.create(spark, root, stays.last_stays(spark.createDataFrame(list(now.values()), schema)), "customer", 2)
    for number in range(4):
        last = max(now.values(), key=lambda r: (r[2], r[3], r[0]))[0]
        out = {*rnd.sample(sorted(now), 8), last, *([i for i, r in now.items() if r[1] == 5] if number == 1 else [])}
        old = [now.pop(i) for i in sorted(out)]
        new = [row(i) for i in [*sorted(out)[::2], *range(100 * number + 100, 100 * number + 103)]]
        now.update({r[0]: r for r in new})
        changes = spark.createDataFrame([(-1, *r) for r in old] + [(1, *r) for r in new], f"sign int, {schema}")
        after = spark.createDataFrame(list(now.values()), schema)
        for _ in range(2):
            V.commit(spark, root, changes, lambda rows, b: stays.merged_last_stays(rows, b, after), "w", number)
        want = {}
        for i, c, a, d in now.values():
            want[c] = max(want.get(c, (dt.date.min, dt.date.min, 0)), (a, d, i))
        got = {r.customer: (r.last_from, r.last_till, r.last_booking) for r in V.read(spark, root).collect()}
        assert got == want
