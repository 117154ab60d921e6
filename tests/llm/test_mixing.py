import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldweave.llm.mixing import mix, source_plan, with_copies, word_count


def targets(sizes, max_rate=3, weights=3):
    """Reshare by weight again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % weights + 1 for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w >= max_rate * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / w for s in open_}
        out |= {s: float(max_rate * sizes[s]) for s in over}
        open_ -= over
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "B", "é", "zz", None, "", "hot", "tiny"]
    rows = [(k, " ".join(["w"] * rng.randrange(0, 30)), rng.choices(names, [5, 5, 2, 9, 3, 4, 60, 1])[0], "x") for k in range(n)]
    return rows + [(None, "null id", "a", "x"), (7, None, "a", "x"), (8, "x " * 20_000, "tiny", "x"), (1, rows[1][1], rows[1][2], "x")]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_copies(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    got = with_copies(df, word_count(F.col("text"))).collect()
    assert len(got) == len(rows)
    taken, seen = defaultdict(int), {}
    for r in got:
        assert r["__size"] == size(r.text) and r["__source_size"] == sizes[r.source] and r["__target"] == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        u = int(hashlib.md5(f"17:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["__copies"] == int(rate) + (u < rate - int(rate)) <= 3
        taken[r.source] += r["__size"] * r["__copies"]
        seen[r.doc_id, r.text, r.source] = r["__copies"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert taken["hot"] == pytest.approx(want["hot"], rel=0.3)
    mixed = Counter((r.doc_id, r.text, r.source) for r in mix(df).collect())
    times = Counter((r.doc_id, r.text, r.source) for r in got)
    assert mixed == {k: c * times[k] for k, c in seen.items() if c}


def test_small_inputs(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and mix(df).columns == df.columns
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and all(r["__copies"] == 0 for r in with_copies(empty, word_count(F.col("text"))).collect())
    one = spark.createDataFrame([("s", 5), ("s", 6)], "source string, size long")
    assert source_plan(one).first().asDict() == {"source": "s", "source_size": 11, "target": 11.0}


def test_columns_of_clashing_names_come_back(spark):
    kind = "doc_id long, text string, source string, __size int, __source_size int, __target int, __copies int, __copy int, __source int"
    df = spark.createDataFrame([(k, "a b c", "s", 100 + k, 200, 300, 400, 500 + k, 600) for k in range(9)], kind)
    got = mix(df)
    assert got.columns == df.columns and got.count()
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}
    plain = with_copies(df, word_count(F.col("text")))
    assert {(r["__size"], r["__source_size"]) for r in plain.collect()} == {(3, 27)} and plain.columns.count("__target") == 1
    assert mix(df.limit(0)).count() == 0
