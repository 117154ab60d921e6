import random
from contextlib import contextmanager

import numpy as np
import pytest

from fieldweave.llm import jaccard_join
from fieldweave.llm.jaccard_join import bands_for, centres_of, distances, keep_one, minhashes, near_classes, overlaps
from fieldweave.llm.shingles import Words, shingle_hashes


def brute_force(rows, t=0.8):
    sets = [set(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (x or "").encode().split()) else None for _, x in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [k for k in near[todo.pop()] if k not in seen]
            seen.update(new), todo.extend(new)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(near[i])))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    texts = []
    for n in (30, 60, 120, 400):
        base = text(n)
        for _ in range(12):
            own = base.split()
            for _ in range(rng.randrange(0, 1 + n // 25)):
                own[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(own))
        texts += [base, base]
    texts += [text(rng.randrange(1, 80)) for _ in range(60)] + ["", None, "", " \n", "one", "one", "one two three", text(6000)]
    return [(k, t) for k, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus() + [(None, "one"), (None, None), (5, corpus()[5][1]), (None, "alone in a class of null ids here"), (None, "alone in a class of null ids here")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, node string, key int")
    got = near_classes(df).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)


def families(seed=5):
    """Near copies of a few texts, with few to many words changed, and chains that drift away."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    texts = []
    for size, n, most in ((150, 120, 6), (400, 60, 25), (60, 40, 2)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randrange(most + 1)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own + [word() for _ in range(rng.randrange(3))]))
    own = [word() for _ in range(200)]
    for _ in range(60):
        own[rng.randrange(200)] = word()
        texts.append(" ".join(own))
    return list(enumerate(texts + texts[:9]))


@pytest.mark.parametrize(("bucket", "group", "sample"), [(16, 8, 30), (7, 50, 200), (512, 20, 3)])
def test_large_groups_against_all_pairs(spark, monkeypatch, bucket, group, sample):
    for name, value in (("BUCKET_BLOCK", bucket), ("GROUP_BLOCK", group), ("SAMPLE", sample), ("LEADERS", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_classes(df).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)


def test_pairs_of_near_copies_are_not_made(spark):
    rng = random.Random(3)
    base = ["w%d" % k for k in range(300)]
    rows = []
    for k in range(3000):
        own = list(base)
        own[rng.randrange(300)] = "x%d" % k
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with copies_counted() as copied:
        got = near_classes(df).collect()
    assert {r.n_links for r in got} == {2999} and {r.class_id for r in got} == {0}
    assert sum(copied["in_blocks"]) + sum(copied["in_group_blocks"]) < 3000


@contextmanager
def copies_counted():
    """How many rows are copied to pairs of blocks, in buckets and in groups."""
    copied, real = {"in_blocks": [], "in_group_blocks": []}, {}

    def counted(name):
        def run(*args):
            out = real[name](*args)
            copied[name].append(out.count())
            return out

        return run

    for name in copied:
        real[name] = getattr(jaccard_join, name)
        setattr(jaccard_join, name, counted(name))
    try:
        yield copied
    finally:
        for name, own in real.items():
            setattr(jaccard_join, name, own)


@pytest.mark.parametrize("length", [1500, 3000])
def test_chains_are_copied_no_more_than_by_plain_blocks(spark, length):
    # each text is like those near it in the chain only
    words = ["w%d" % k for k in range(length * 4 + 200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 200])) for k in range(length)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with copies_counted() as copied:
        got = {r.doc_id: r for r in near_classes(df).collect()}
    # 196 shingles each; j texts further 196 - 4 j are common: 0.8 is reached up to j = 5
    assert all(got[k].class_id == 0 and got[k].n_links == min(k, 5) + min(length - 1 - k, 5) for k in range(length))
    blocks = -(-length // jaccard_join.GROUP_BLOCK)
    assert sum(copied["in_group_blocks"]) <= length * blocks


def test_centres_and_distances():
    base = np.arange(200, dtype=np.uint64)
    sets = [np.union1d(np.delete(base, range(k, k + 5)), np.uint64(1000 + k)) for k in range(9)] + [np.arange(5000, 5100, dtype=np.uint64)]
    centre, = centres_of(sets, 0.8)
    assert (distances(sets, [centre])[:9, 0] <= 12).all() and distances(sets, [centre])[9, 0] >= 250


def test_one_of_each_class_stays(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(rows[0][0], rows[0][1], "x")], "doc_id long, text string, class_id string")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c, _ in brute_force(rows)})


def test_classes_of_null_ids_and_of_one_id_stay_apart(spark):
    words = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(None, words("a")), (None, words("a") + " more"), (None, words("b")), (None, words("b") + " more"), (None, words("b"))]
    rows += [(7, words("c")), (8, words("c") + " more"), (7, words("d")), (9, words("d") + " more"), (7, words("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = keep_one(df).collect()
    assert sorted(r.text[0] for r in got) == ["a", "b", "c", "d", "e"]
    assert sorted(r.doc_id for r in got if r.text[0] > "b") == [7, 7, 7]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(df).count() == 0 and keep_one(df).count() == 0


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = bands_for(t, 0.9999)
        assert 1 - (1 - t**r) ** b >= 0.9999 or r == 1


def test_overlaps_and_minhashes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, size=n).astype(np.uint64)) for n in (0, 5, 3000, 8000)]
    assert (overlaps(sets, sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()
    a = shingle_hashes(Words().of(" ".join(map(str, range(1000)))))
    b = shingle_hashes(Words().of(" ".join(map(str, range(100, 1100)))))
    same = (minhashes(a, 120) == minhashes(b, 120)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
