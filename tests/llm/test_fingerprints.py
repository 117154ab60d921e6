import hashlib
import random

import numpy as np

from fieldweave.llm.fingerprints import K, containment, decode, distinct, encode, fingerprint, merge, neighbour_likeness, resemblance, sketch
from fieldweave.llm.shingles import Words, shingle_hashes


def own(text):
    return sketch(shingle_hashes(Words().of(text)))


def test_estimates_and_merging():
    words = ["w%d" % k for k in range(4000)]
    a, b, part = (own(" ".join(w)) for w in (words[:3000], words[1000:], words[:1500]))
    assert abs(resemblance(a, b) - 2000 / 4000) < 0.15 and abs(containment(part, a) - 1) < 0.25 and abs(distinct(a) - 2996) < 900
    # parts that overlap by four words share no shingle and miss none
    halves = merge(own(" ".join(words[:1504])), own(" ".join(words[1500:3000])))
    assert (halves == a).all() and len(a) == K and (decode(encode(a)) == a).all()
    small, other = own("a b c d e f g"), own("a b c d e f h")
    assert resemblance(small, other) == 2 / 4 and distinct(small) == 3 and resemblance(own(""), own("")) == 1 and resemblance(own(""), small) == 0


def test_neighbours_in_id_order(spark):
    rng = random.Random(1)
    ids = rng.sample(range(100_000), 150)
    rows = [(i, " ".join(rng.choices(["été", "w", "x1", "zz"], k=rng.randrange(0, 60))), "x") for i in ids]
    rows[7] = (rows[7][0], None, "x")
    df = spark.createDataFrame(rows, "doc_id long, text string, next string")
    got = {r.doc_id: r for r in neighbour_likeness(df).collect()}
    order = sorted(ids)
    text = {i: t or "" for i, t, _ in rows}
    assert sorted(got) == order
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        n = len(text[i]) // 4
        new = text[i][: len(text[i]) - n] + text[j][:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (encode(own(text[i])), encode(own(new)))
        assert np.isclose(r.near_edited, resemblance(own(text[i]), own(new))) and np.isclose(r.near_next, resemblance(own(text[i]), own(text[j])))


def test_odd_rows(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert neighbour_likeness(one).count() == 1 and neighbour_likeness(one.limit(0)).count() == 0
    rows = [(None, "first"), (None, None), (3, "same id"), (3, "same id"), (3, "x y " * 30_000)]
    got = neighbour_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.n_chars == 7}) == 1
    assert fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_cuts(spark):
    import bisect

    from pyspark.sql import functions as F

    from fieldweave.llm.split import cuts_below

    for cuts in ([], [5], [1, 4, 9], list(range(3, 700, 7))):
        got = spark.range(-5, 720).select("id", cuts_below(F.col("id"), cuts).alias("n")).collect()
        assert all(r.n == bisect.bisect_right(cuts, r.id) for r in got)
