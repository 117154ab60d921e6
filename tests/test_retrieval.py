import numpy as np
import pytest

from fieldweave.operators import retrieval
from fieldweave.operators.retrieval import cosine_top_k


def brute(q, c, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = np.round(unit(q) @ unit(c).T, 12)
    return {i: np.argsort(-row, kind="stable")[:k].tolist() for i, row in enumerate(s)}


@pytest.mark.parametrize(("queries", "candidates", "step"), [(11, 23, 4), (2, 3, 4096), (30, 1, 4096)])
def test_equal_to_the_full_matrix(spark, monkeypatch, queries, candidates, step):
    monkeypatch.setattr(retrieval, "CANDIDATE_STEP", step)
    monkeypatch.setattr(retrieval, "CANDIDATE_BLOCK", 9)
    rng = np.random.default_rng(queries)
    q, c = rng.normal(size=(queries, 7)), rng.normal(size=(candidates, 7))
    c[-1] = c[0]
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(None, [1.0] * 7), (999, None)], "id long, v array<double>")
    got = cosine_top_k(frame(q), frame(c), 5, query_id="id", candidate_id="id", vector="v").collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.candidate_id)
    assert found == brute(q, c, 5)


def test_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<float>")
    got = cosine_top_k(df, df, 9, query_id="id", candidate_id="id", vector="v", skip_same_id=True).collect()
    assert sorted((r.query_id, r.candidate_id, r.similarity) for r in got) == [(1, 2, 0.0), (2, 1, 0.0)]
    assert cosine_top_k(df.limit(0), df, 1, query_id="id", candidate_id="id", vector="v").count() == 0
    with pytest.raises(ValueError):
        cosine_top_k(df, df, 0, query_id="id", candidate_id="id", vector="v")
    with pytest.raises(ValueError):
        cosine_top_k(df, spark.createDataFrame([(1, [1.0])], "id long, v array<float>"), 1, query_id="id", candidate_id="id", vector="v")


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.candidate_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_the_better_of_two_that_round_alike(spark):
    at = lambda s: [s, float(np.sqrt(1 - s * s))]
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<double>")
    c = spark.createDataFrame([(1, at(0.5000001)), (2, at(0.5000003)), (3, at(0.5000003)), (4, at(0.4))], "id long, v array<double>")
    assert answers(cosine_top_k(q, c, 1, query_id="id", candidate_id="id", vector="v")) == {0: [2]}
    assert answers(cosine_top_k(q, c, 3, query_id="id", candidate_id="id", vector="v")) == {0: [2, 3, 1]}


@pytest.mark.parametrize("clustered", [True, False])
def test_balls_lose_nothing(spark, monkeypatch, clustered):
    monkeypatch.setattr(retrieval, "BALL_ROWS", 60)
    monkeypatch.setattr(retrieval, "CANDIDATE_BLOCK", 25)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 12))
    v = centres[rng.integers(0, 10, 600)] + 0.1 * rng.normal(size=(600, 12)) if clustered else rng.normal(size=(600, 12))
    v[50:60], v[7] = v[50], 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    q = df.filter("id % 5 = 2")
    visited = []
    real = retrieval.to_visit
    monkeypatch.setattr(retrieval, "to_visit", lambda *a: (visited.append(x := real(*a)), x)[1])
    got = answers(cosine_top_k(q, df, 6, query_id="id", candidate_id="id", vector="v"))
    own = [i for i in range(600) if i % 5 == 2]
    want = brute(v[own], v, 6)
    assert got == {own[i]: x for i, x in want.items()}
    if clustered:
        assert visited[0].count() < 0.3 * len(own) * 10
