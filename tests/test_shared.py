"""Publishing derived datasets once into the shared folder."""

import os
import tempfile

from innkeep.sources import shared


def test_publish_once_and_lost_race(spark):
    root = tempfile.mkdtemp(prefix="publish-")
    target = os.path.join(root, "ds")
    calls = []

    def write(p):
        calls.append(p)
        spark.range(5).write.parquet(p)

    assert shared.publish_once(spark, target, write) == target
    assert shared.publish_once(spark, target, write) == target
    assert len(calls) == 1 and spark.read.parquet(target).count() == 5
    # a second writer that finished after the first published: its rename is refused
    late = target + ".tmp-late"
    spark.range(3).write.parquet(late)
    assert shared.rename_once(spark, late, target) is False
    assert spark.read.parquet(target).count() == 5
    assert not os.path.exists(os.path.join(target, "ds.tmp-late"))
