import os

import pytest

from fieldweave import shared


def test_places_follow_the_order(spark):
    rows = spark.range(5000).selectExpr("id", "hash(id) % 97 AS k")
    got = shared.numbered(shared.settle(rows), ["k", "id"], "place").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((r.k, r.id) for r in got)
    assert sorted(r.place for r in got) == list(range(5000))
    assert shared.numbered(shared.settle(rows.limit(0)), ["k"], "place").count() == 0


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    few = shared.settle(spark.range(100).selectExpr("id", "repeat('x', 1000) AS text", "array(id) AS a"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(shared.small(few))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 100_000)
    assert "broadcast" not in plan(shared.small(few)) and "broadcast" in plan(shared.small(few.select("id")))


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_tables_go_on_request(spark):
    table = shared.settle(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and shared.release(spark) >= 1 and not os.path.exists(path)
