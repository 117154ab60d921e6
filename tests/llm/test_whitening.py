import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import whitening
from fieldweave.llm.queries import op13_whitening


def frame(spark, m, kind="double"):
    return spark.createDataFrame([(k, [x.item() for x in r]) for k, r in enumerate(m)], f"id long, x array<{kind}>")


def brute_force(m):
    c = m - m.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(m))
    return e[::-1], v.T[::-1]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_merged_parts_equal_one_decomposition(spark, parts):
    rng = np.random.default_rng(1)
    m = np.floor(1024 * rng.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.int64) + 100_000
    found = whitening.fit(frame(spark, m, "bigint").repartition(parts), "x")
    e, v = found.components()
    want_e, want_v = brute_force(m.astype(float))
    assert found.n == 300 and found.sums.tolist() == m.sum(axis=0).tolist()
    assert np.allclose(e, want_e, rtol=1e-10) and np.allclose(np.abs((v * want_v).sum(axis=1)), 1)
    assert np.allclose(found.covariance(), np.cov(m.T, bias=True), rtol=1e-9)


def test_a_merge_loses_no_dimension():
    rng = np.random.default_rng(2)
    # neither half alone has more than three dimensions, both together have all
    a, b = np.zeros((20, 6)), np.zeros((20, 6))
    a[:, :3], b[:, 3:] = rng.normal(size=(20, 3)), 1e6 + rng.normal(size=(20, 3))
    both = whitening.merged(whitening.summary_of(a), whitening.summary_of(b))
    assert np.allclose(both.covariance(), np.cov(np.concatenate((a, b)).T, bias=True))
    one = whitening.merged(whitening.summary_of(a[:1]), whitening.summary_of(a[1:2]))
    assert np.allclose(one.covariance(), np.cov(a[:2].T, bias=True))


def test_whitened_rows_have_the_identity_as_covariance(spark):
    m = np.random.default_rng(3).normal(size=(400, 5)) @ np.diag([5, 4, 3, 2, 1.0]) + 1e5
    df = frame(spark, m).withColumn("whitened", F.lit("of the input"))
    found = whitening.fit(df, "x")
    white = whitening.whiten(df, "x", found, 3)
    got = np.array([r.whitened for r in white.orderBy("id").collect()])
    e, v = found.components()
    assert np.allclose(got, (m - m.mean(axis=0)) @ v[:3].T / np.sqrt(e[:3]), atol=1e-9)
    assert whitening.identity_error(whitening.fit(white, "whitened")) < 1e-9
    assert white.columns == ["id", "x", "whitened"]


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (None, [3.0, 1.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    kept = whitening.usable(df, "x")
    assert sorted((r.id or 0) for r in kept.collect()) == [0, 1, 1]
    assert whitening.fit(kept, "x").n == 3
    assert whitening.fit(df.limit(0), "x") is None and whitening.usable(df.limit(0), "x").count() == 0
    same = spark.createDataFrame([(k, [2.0, 3.0]) for k in range(5)], "id long, x array<double>")
    assert [r.whitened for r in whitening.whiten(same, "x", whitening.fit(same, "x"), 8).collect()] == [[]] * 5


def test_the_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(90, 10)).astype(np.float32)
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(m)] + [(900, None), (901, [float("nan")] * 10), (902, [0.0] * 10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path)).toPandas()
    x = np.floor(np.concatenate((m, np.zeros((1, 10), np.float32))).astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    e, v = brute_force(x.astype(float))
    assert len(got) == n * 8 and (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    ids = [*range(90), 902]
    for i, own in got.groupby("vec_id"):
        at = ids.index(i)
        assert (own["deviation"] == ((n * x[at] - s) ** 2).sum()).all()
        own = own.sort_values("component")
        assert own["component"].tolist() == list(range(1, 9))
        assert np.allclose(np.abs(own["whitened"]), np.abs((x[at] - s / n) @ v[:8].T / np.sqrt(e[:8])), atol=1e-9)
        assert np.allclose(own["explained"], e[:8] / e.sum(), rtol=1e-9)


def test_the_query_on_no_rows_and_huge_entries(spark, tmp_path):
    kind = "vec_id long, embedding array<double>"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op13_whitening(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], kind).write.parquet(f"{tmp_path}/huge/embeddings.parquet")
    assert {r.deviation for r in op13_whitening(spark, f"{tmp_path}/huge").collect() if r.vec_id == 1} == {None}
