import os

import pytest

from rayloom import lineage


def test_scratch_tables_go_but_for_what_is_kept(spark):
    with lineage.cleared(spark) as kept:
        lineage.stored(spark.range(5), "one")
        gone = lineage.last_made()
        held = lineage.stored(spark.range(7), "two")
        kept.append(lineage.last_made())
    assert held.count() == 7 and not os.path.exists(gone.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def isDefined(self):
            return False

    class Fake:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()})()

    with pytest.raises(ValueError):
        lineage.shared_dir(Fake())
