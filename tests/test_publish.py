import os

import pytest

from fieldweave.sources import sinks
from fieldweave.sources.sinks import current, publish, roll_forward, write_csv, write_text

NAMES = ("train.csv", "test.csv", "report.json")


class StoppedHere(BaseException):
    """As if the driver had gone."""


def files(spark, version):
    rows = spark.createDataFrame([(version, k) for k in range(3)], "version string, k int")
    return {"train.csv": lambda p: write_csv(rows, p), "test.csv": lambda p: write_csv(rows.limit(1), p), "report.json": lambda p: write_text(spark, p, version)}


def seen(spark, folder):
    """The version that each file holds for a reader, through Spark."""
    out = []
    for name in NAMES:
        text = "\n".join(r.value for r in spark.read.text(current(spark, folder, name)).collect())
        out.append("old" if "old" in text else "new" if "new" in text else text)
    return out


@pytest.mark.parametrize("step", range(9))
def test_stopped_between_any_two_steps(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "out")
    publish(spark, folder, files(spark, "old"))
    assert sorted(os.listdir(folder)) == sorted(NAMES) and seen(spark, folder) == ["old"] * 3
    taken = []

    def stopping(real):
        def run(*args):
            if len(taken) == step:
                raise StoppedHere
            taken.append(real)
            return real(*args)

        return run

    with monkeypatch.context() as m:
        m.setattr(sinks, "_replace", stopping(sinks._replace))
        m.setattr(sinks, "_exists", stopping(sinks._exists))
        own = {name: stopping(write) for name, write in files(spark, "new").items()}
        m.setattr(sinks, "uuid", type("U", (), {"uuid4": staticmethod(lambda: type("H", (), {"hex": f"step{step}"}))}))
        with pytest.raises(StoppedHere):
            publish(spark, folder, own)
    # whole sets only, and no place is empty
    assert seen(spark, folder) == (["old"] * 3 if step < 3 else ["new"] * 3)
    assert set(NAMES) <= set(os.listdir(folder))
    assert roll_forward(spark, folder) == (step >= 3) and not roll_forward(spark, folder)
    assert seen(spark, folder) == (["old"] * 3 if step < 3 else ["new"] * 3)
    assert sorted(os.listdir(folder)) == sorted(NAMES)


def test_the_next_publication_ends_a_stopped_one(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    publish(spark, folder, files(spark, "old"))
    with monkeypatch.context() as m:
        m.setattr(sinks, "_replace", lambda *a: (_ for _ in ()).throw(StoppedHere()))
        with pytest.raises(StoppedHere):
            publish(spark, folder, files(spark, "new"))
    os.makedirs(f"{folder}/.staging-left")
    publish(spark, folder, {"more.json": lambda p: write_text(spark, p, "more")})
    assert sorted(os.listdir(folder)) == sorted([*NAMES, "more.json"]) and seen(spark, folder) == ["new"] * 3


def test_folders_of_part_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    for version in ("old", "new"):
        rows = spark.createDataFrame([(version,)], "v string")
        publish(spark, folder, {"train.csv": lambda p, rows=rows: write_csv(rows, p, one_file=False)})
    assert [r.v for r in spark.read.csv(current(spark, folder, "train.csv"), header=True).collect()] == ["new"]
