import os

import pytest

from nearcite import session


def test_materialize_and_drop(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {})
    table = session.materialize(spark.range(1000), spread=("id",))
    empty = session.materialize(spark.range(0))
    assert table.count() == 1000 and empty.count() == 0
    assert table.rdd.getNumPartitions() >= 4
    folders = {os.path.dirname(f.removeprefix("file://")) for f in table.inputFiles()}
    assert all(f.startswith(session.checkpoint_dir(spark).removeprefix("file:")) for f in folders)
    assert session.drop_materialized(spark) == 2
    assert not any(os.path.exists(f) for f in folders)
    assert session.drop_materialized(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Unset()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, name, default: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_turns_delete_the_table_before(spark):
    turns = session.Turns(spark)
    first = turns.next(spark.range(5))
    folder = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    kept = turns.next(first.where("id > 1"))
    assert not os.path.exists(folder)
    turns.keep()
    assert turns.next(kept.where("id > 2")).count() == 2 and kept.count() == 3
