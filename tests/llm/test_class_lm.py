import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldweave.llm import class_lm


def texts(seed=4, n=300):
    rng = random.Random(seed)
    sides = [["a%d" % k for k in range(40)], ["b%d" % k for k in range(40)]]
    out = []
    for _ in range(n):
        side, words = rng.randrange(2), []
        for _ in range(rng.randrange(0, 40)):
            words.append(rng.choice(sides[side]))
            side = 1 - side if rng.random() < 0.9 else side
        out.append(" ".join(words))
    return out + ["", None, "UPPER upper Üpper", "new%d words" % seed, "x " * 3000, "tab\tline\x0bend\x1cin", "a1", "a1"]


def tokens(text):
    return [*(w.lower() for w in (text or "").encode().split()), None]


def base_scores(rows):
    n = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    total = sum(n.values())
    out = {}
    for i, x in rows:
        own = tokens(x)
        out[i] = (len(own), sum(n[t] > 0 for t in own), total, sum(math.log10((n[t] + 0.5) / (total + 0.5 * (len(n) + 1))) for t in own))
    return out


@pytest.mark.parametrize("frequent", [500_000, 7])
def test_counts_and_base_are_exact(spark, monkeypatch, frequent):
    from pyspark.sql import functions as F

    from fieldweave.llm.split import held_out

    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    fitted = class_lm.fit(df.filter(~held_out(F.col("doc_id"), 5, 1)))
    got = class_lm.score(df, fitted).collect()
    want = base_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert abs(r.base_score - want[r.doc_id][3]) < 1e-6 * max(1, abs(r.base_score))
    # words that take turns are foreseen better from the class before
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.perplexity > 0 for r in got)


def test_model_sums_to_one(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    model, counts = class_lm.fit(df)
    assert np.allclose((10**model.step).sum(axis=1), 1)
    table = counts.toPandas()
    word = table["word"].to_numpy(dtype=np.int64).view(np.uint64)
    own = model.classes[model.units.of(word, table["ending"].to_numpy())]
    p = (table["n"].to_numpy() + 0.5) / 10 ** model.inside[own]
    inside = np.bincount(own, weights=p, minlength=class_lm.CLASSES)
    assert (inside <= 1 + 1e-9).all() and model.tokens == table["n"].sum() and model.distinct == len(table)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    side = rng.integers(0, 3, size=60)
    side[0] = 0
    b = rng.poisson(np.where((side[:, None] + 1) % 3 == side[None, :], 8.0, 0.3)).astype(np.float32)

    def likelihood(own):
        m = np.eye(8)[own]
        g = m.T @ b @ m
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    one = class_lm.exchange(b, 8, 1)
    more = class_lm.exchange(b, 8, 8)
    assert likelihood(more) >= likelihood(one) - 1e-6
    start = np.zeros(60, dtype=int)
    start[np.argsort(-(b.sum(0) + b.sum(1))[1:], kind="stable") + 1] = 1 + np.arange(59) % 7
    assert likelihood(one) > likelihood(start)


def test_three_thousand_words_are_clustered_on_their_own(spark):
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(3000)),)] * 2, "text string")
    model, _ = class_lm.fit(df)
    assert len(model.units.words) == 3001


def test_words_of_equal_counts_fill_the_units(spark):
    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(5000)),)] * 2, "text string")
    model, counts = class_lm.fit(df)
    assert len(model.units.words) == class_lm.UNITS - class_lm.ENDINGS
    least = sorted(r.word for r in counts.filter("n = 2").collect())[: class_lm.UNITS - class_lm.ENDINGS - 1]
    assert set(np.array(least, dtype=np.int64).view(np.uint64)) <= set(model.units.words)


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(5, "a b", 7, 8, 9, 1.5, 2.5)], "doc_id long, text string, __row int, __tokens int, word int, Score double, PERPLEXITY double")
    (r,) = class_lm.score(df, class_lm.fit(df)).collect()
    assert (r.doc_id, r["__row"], r["__tokens"], r["word"], r.n_tokens) == (5, 7, 8, 9, 3)
    assert [c for c in r.asDict() if c.lower() in ("score", "perplexity")] == ["score", "perplexity"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert class_lm.score(df, class_lm.fit(df)).count() == 0
    one = spark.createDataFrame([(1, "unseen text")], "doc_id long, text string")
    r = class_lm.score(one, class_lm.fit(df)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
