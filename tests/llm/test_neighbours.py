import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import neighbours
from fieldweave.llm.hilbert import hilbert_keys
from fieldweave.llm.neighbours import nearest


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_each_cell_and_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def table(spark, n=900, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    v = centres[rng.integers(0, 9, n)] + 0.2 * rng.normal(size=(n, dims))
    v[100:160] = v[100]
    rows = [(k, [float(np.float32(x)) for x in r], "x") for k, r in enumerate(v)]
    rows += [(2000, None, "x"), (2020, [0.0] * dims, "x"), (2040, [float("nan")] + [1.0] * (dims - 1), "x"), (2060, [float("inf")] * dims, "x"), (2080, [None] + [1.0] * (dims - 1), "x"), (2100, [1.0], "x"), (None, [1.0] * dims, "x"), rows[5], rows[40]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), {k: np.array(r) for k, r, _ in rows[:n]}


def brute_force(vectors, every, k):
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = np.round(m @ vectors[q], 12)
        s[ids == q] = -np.inf
        out[int(q)] = ids[np.lexsort((ids, -s))][: min(k, len(ids) - 1)].tolist()
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_all_neighbours_are_found(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 700)
    df, vectors = table(spark)
    got = nearest(df, df.vec_id % 20 == 0, half=64, widen=True)
    assert answers(got) == brute_force(vectors, 20, 20)
    r = got.first()
    assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)


def test_windows_alone_find_most(spark):
    df, vectors = table(spark)
    want = brute_force(vectors, 20, 20)
    got = answers(nearest(df, df.vec_id % 20 == 0, half=64))
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9
    assert answers(nearest(df, df.vec_id % 20 == 0)) == want  # the window holds nearly all rows


def test_the_size_of_a_range_changes_nothing(spark, monkeypatch):
    df, _ = table(spark, seed=3)
    found = []
    for rows in (30, 700, 20_000):
        monkeypatch.setattr(neighbours, "RANGE_ROWS", rows)
        found.append(answers(nearest(df, df.vec_id % 20 == 0, half=30)))
    assert found[0] == found[1] == found[2]


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    got, want = answers(nearest(df, df.vec_id % 100 == 0)), brute_force(dict(enumerate(v)), 100, 20)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.98


def test_an_id_with_several_vectors_has_the_least(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.5, 0.5]), (1, [0.9, 0.1]), (2, [0.7, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 0.7), (1, 0.5)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert answers(nearest(df, df.vec_id % 20 == 0)) == {0: [2, 1]}
    assert nearest(df.limit(0), df.vec_id % 20 == 0).count() == 0


def test_orderings_are_added_until_enough_is_found(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    want = brute_force(dict(enumerate(v)), 50, 20)
    recall = lambda: np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    monkeypatch.setattr(neighbours, "ORDERINGS", (2, 6))
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    got = answers(nearest(df, df.vec_id % 50 == 0, half=40))
    few = recall()
    monkeypatch.setattr(neighbours, "ROUNDS", 20)
    got = answers(nearest(df, df.vec_id % 50 == 0, half=40))
    assert few < 0.5 and recall() >= 0.93
