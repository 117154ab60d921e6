import math
import random
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldweave.llm import toxicity
from fieldweave.llm.toxicity import Features, fit, score, swapped, train


def labelled(seed=1, n=600):
    """Toxic texts hold an insult; an identity term is more frequent among them than elsewhere."""
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(300)]
    rows = []
    for k in range(n):
        text, toxic = rng.choices(words, k=rng.randrange(3, 60)), rng.random() < 0.3
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Scumbag,", "loathsome", "vermin!"]))
        if rng.random() < (0.6 if toxic else 0.05):
            text.insert(rng.randrange(len(text)), rng.choice(["muslim", "gay", "women"]))
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_mentions_of_groups(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 1) for r in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    model = fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.toxicity for r in score(docs, model).collect()}
    held = [(got[k] >= 0.5, bool(y)) for k, _, y in rows if k % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95
    neutral = score(spark.createDataFrame([(1, "w1 w2 the women and the muslim of w3")], "doc_id long, text string"), model).first().toxicity
    assert neutral < 0.3


def test_pairing_brings_the_scores_of_swapped_texts_together():
    rows, own = labelled(), Features()
    tokens = [t.split() for _, t, _ in rows]
    cells, y = [own.of(t) for t in tokens], np.array([r[2] for r in rows], dtype=float)
    others = [None if (s := swapped(t)) is None else own.of(s) for t in tokens]
    gap = lambda m: np.mean([abs(m.score(a) - m.score(b)) for a, b in zip(cells, others, strict=True) if b is not None])
    assert gap(train(cells, y, others, pairing=2.0)) < 0.5 * gap(train(cells, y, others, pairing=0.0))


def test_swaps_stay_within_a_kind():
    assert swapped("no such term".split()) is None
    out = swapped("The Women, and gay w".split())
    assert out[0] == "The" and out[1] in toxicity.IDENTITY_TERMS[0] and out[1] != "women" and out[3] in toxicity.IDENTITY_TERMS[2]


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (1, None, 0.5), (2, "", 0.5), (None, "x " * 50_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs, none, F.lit(True))
    got = score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.toxicity <= 1 for r in got)
    assert score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(spark, label):
    docs = spark.createDataFrame([(k, "some text") for k in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, label) for k in range(9)], "doc_id long, toxic int")
    s = score(docs, fit(docs, labels, F.lit(True))).first().toxicity
    assert (s > 0.5) == bool(label)


def test_scores_of_given_weights_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    weights = np.where(rng.random(toxicity.BUCKETS) < 0.5, rng.normal(size=toxicity.BUCKETS), 0).astype(np.float32)
    model = toxicity.Model(weights, -0.3)
    texts = ["You are AWFUL, truly awful people!", "plain words", "", None, "a  b\tc", "straße übel", "x" * 50_000 + " end", "plain words"]
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, Toxicity string")
    got = {r.doc_id: r for r in toxicity.score(df, model, "risk").collect()}
    for k, text in enumerate(texts):
        keys = set()
        for token in (text or "").split():
            word = token.lower().strip(string.punctuation + string.whitespace + "“”‘’«»¿¡…–—")
            if word:
                keys |= {word} | {"^" + word[:n] for n in (4, 6) if len(word) > n}
        cells = {xxhash.xxh3_64_intdigest(key) % toxicity.BUCKETS for key in keys}
        want = 1 / (1 + math.exp(-(-0.3 + sum(float(weights[c]) for c in cells))))
        assert got[k].risk == pytest.approx(want, abs=1e-5) and got[k].Toxicity == "kept"
    assert toxicity.score(df.limit(0), model).count() == 0
