import random

import numpy as np
from pyspark.sql import functions as F

from fieldweave.llm.language_id import fit, has_letter, predict

SYLLABLES = {"aa": "ba lo mi tu ren", "bb": "ÿe ñor qui chä zz", "cc": "кот дом лес ива"}


def rows(n=240):
    rng = random.Random(2)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        out.append((k, " ".join(words), lang, "x"))
    return out


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, score string")
    model = fit(df, F.col("doc_id") % 4 != 2, per_language=40)
    got = predict(df, model).collect()
    held = [r for r in got if r.doc_id % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    strange = predict(spark.createDataFrame([(1, "wwwww kkkkk jjjjj xxxxx vvvvv wkjxv")], "doc_id long, text string"), model).first()
    assert strange.rejected and strange.lang_pred in SYLLABLES


def test_odd_rows(spark):
    df = spark.createDataFrame([*rows(60), (None, None, "aa", "x"), (901, "", None, "x"), (902, "12 34 !?", "bb", "x"), (903, "ba lo " * 20_000, None, "x"), (903, "ba lo " * 20_000, None, "x")], "doc_id long, text string, lang string, lang_pred string")
    model = fit(df, F.lit(True))
    got = predict(df, model).filter("doc_id is null or doc_id > 900").collect()
    assert sorted((r.lang_pred, r.rejected) for r in got) == [("aa", False)] * 2 + [("und", True)] * 3
    empty = df.limit(0)
    assert predict(empty, model).count() == 0
    assert {r.lang_pred for r in predict(df, fit(empty, F.lit(True))).collect()} == {"und"}


def test_every_language_is_learnt_whatever_its_ids(spark):
    # more languages than 200, each of one word, beside one of many rows that all have one id
    names = [chr(0x4E00 + 7 * k) * 3 for k in range(230)]
    rare = [(k, f"{w} {w}", f"l{k:03d}", "x") for k, w in enumerate(names)]
    shared = [(None if k % 2 else 5, f"ba lo mi {k}", "shared", "x") for k in range(60)] * 2
    df = spark.createDataFrame([*rare, *shared], "doc_id long, text string, lang string, score string")
    model = fit(df, F.lit(True), per_language=3)
    assert model.languages == sorted({*(f"l{k:03d}" for k in range(230)), "shared"})
    assert max(np.bincount(model.owner)) <= 3  # a centroid stands for one row at least
    got = predict(df.filter("lang <> 'shared'"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_letters():
    assert has_letter("1é") and not has_letter("12 _") and not has_letter(None)


def test_predictions_of_given_centroids_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    from fieldweave.llm import language_id
    from fieldweave.llm.language_id import BUCKETS, Model, counts

    texts = ["the cat sat on the mat", "le chat est là", "der Hund läuft", "xyz xyz", "a", "Ωμέγα", "the the le"]
    idf = rng.uniform(0.1, 3, BUCKETS).astype(np.float32)
    c = rng.uniform(0, 1, (5, BUCKETS)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    model = Model(["aa", "bb"], idf, c, np.array([0, 0, 1, 1, 1]), np.array([0.05, 0.2]))
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(90, None, 1.0), (91, "12 .,", 1.0)], "doc_id long, text string, Score double")
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    for k, text in enumerate(texts):
        n = counts([text])[0].astype(np.float64)
        # the vector of a text: 1 + log n, times the weight of the n-gram, to unit length
        v = model.vectors(counts([text]))[0]
        weighted = np.where(n > 0, v, 0)
        cos = c.astype(np.float64) @ weighted / np.linalg.norm(weighted)
        best = int(cos.argmax())
        assert got[k].lang_pred == ["aa", "bb"][model.owner[best]] and abs(got[k].score - cos[best]) < 1e-5 and got[k].rejected == (cos[best] < model.least[model.owner[best]])
    assert [(got[k].lang_pred, got[k].score) for k in (90, 91)] == [("und", 0.0)] * 2
    assert [c for c in language_id.predict(df, model).columns if c.lower() == "score"] == ["score"] and language_id.predict(df.limit(0), model).count() == 0
