import numpy as np
import pytest

from fieldweave.llm import embedding_dedup
from fieldweave.llm.embedding_dedup import near_vectors, tables_for

KIND = "vec_id long, embedding array<double>, label int, node string, n_links string"


def brute_force(rows, threshold):
    """{place in rows: (links, least id of the component)}."""
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    near = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                near[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((int(near[i].sum()), min(ids) if ids else None))
    return out


def table(seed=0, n=240, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    v = centres[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, dims))
    v[60:80] = v[60]
    rows = [(k, [float(x) for x in r], k % 3, "x", "y") for k, r in enumerate(v)]
    rows += [(500, rows[0][1], None, "x", "y"), (501, None, 0, "x", "y"), (502, [0.0] * dims, 0, "x", "y"), (503, [float("nan")] * dims, 0, "x", "y"), (504, [None] + [1.0] * (dims - 1), 0, "x", "y")]
    rows += [(505, [], 0, "x", "y"), (506, [1.0, 2.0], 0, "x", "y"), (507, [2.0, 4.0], 0, "x", "y"), (None, rows[3][1], 0, "x", "y"), (None, [3.0, 1.0, 2.0], 1, "x", "y"), rows[5], (508, [1e300 * x for x in rows[6][1]], 0, "x", "y")]
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_links_and_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = table()
    got = near_vectors(spark.createDataFrame(rows, KIND)).collect()
    with np.errstate(over="ignore"):
        want = brute_force([(r[0], None if r[1] is None else [x / 1e300 if x and abs(x) > 1e200 else x for x in r[1]], *r[2:]) for r in rows], 0.93)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted((str(r[0]), n, str(c), r[0] == c) for r, (n, c) in zip(rows, want, strict=True))
    assert max(n for n, _ in want) > 9


def test_a_large_group_of_near_copies_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    rows = [(k, [float(x) for x in centre + 0.01 * rng.normal(size=16)], 1, "", "") for k in range(700)]
    got = near_vectors(spark.createDataFrame(rows, KIND)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(699, 0)}


def test_tables_reach_the_recall():
    for rows in (1, 300, 10_000, 10**9):
        tables, signs = tables_for(0.93, 0.9999, rows)
        agree = (1 - np.arccos(0.93) / np.pi) ** signs
        assert 1 - (1 - agree) ** tables >= 0.9999
    assert tables_for(0.93, 0.9999, 10**9)[1] > tables_for(0.93, 0.9999, 300)[1]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1500):  # pairs at a cosine just above the threshold
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b = rng.normal(size=32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0, "", ""), (2 * k + 1, (0.9301 * a + np.sqrt(1 - 0.9301**2) * b).tolist(), 0, "", "")]
    got = near_vectors(spark.createDataFrame(rows, KIND)).filter("n_links > 0").count()
    assert got >= 2 * 1500 * 0.999


def test_no_rows_and_no_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "", ""), (2, [0.0, 1.0], 1, "", ""), (3, [1.0, 0.0], 2, "", "")], KIND)
    assert near_vectors(df.limit(0)).count() == 0
    assert sorted(map(tuple, near_vectors(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
