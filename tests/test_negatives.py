from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave import queries
from fieldweave.functions import text
from fieldweave.functions.similarity import most_similar
from fieldweave.operators import vocabulary
from fieldweave.operators.negatives import NegativeConfig, augmented, contains_no_match, eligible_targets, hardest, synthetic_negatives


def rows(spark, pairs):
    df = spark.createDataFrame([(a, b, label, k) for k, (a, b, label) in enumerate(pairs)], "A string, B string, label string, source_row long")
    return text.with_normalized(df, {"A": "norm_a", "B": "norm_b"})


def test_counts_exclusions_and_seed(spark):
    pairs = [(f"name{k % 7}", f"target{k}", "DIRECT") for k in range(40)]
    df = rows(spark, pairs)
    made = synthetic_negatives(df, NegativeConfig(random_per_positive=2, hard_per_positive=3, pool=10)).collect()
    assert Counter(r.negative_type for r in made) == {"hard": 120, "random": 80}
    known = {(a, b) for a, b, _ in pairs}
    assert all((r.A, r.B) not in known and r.label == "NO_MATCH" and r.synthetic for r in made)
    hard = {(r.source_row, r.B) for r in made if r.negative_type == "hard"}
    assert all((r.source_row, r.B) not in hard for r in made if r.negative_type == "random")
    again = synthetic_negatives(df.repartition(5), NegativeConfig(random_per_positive=2, hard_per_positive=3, pool=10)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, made))
    assert sorted(map(tuple, synthetic_negatives(df, NegativeConfig(2, 3, 10, seed=7)).collect())) != sorted(map(tuple, made))


@pytest.mark.parametrize("often", ["few", "many"])
def test_every_sample_is_full_beside_a_hot_source(spark, often):
    # the hot source knows a contiguous half of the sorted targets
    many = 600 if often == "many" else 60
    pairs = [("hot", f"t{k:05d}", "DIRECT") for k in range(many // 2)] + [(f"s{k}", f"t{k:05d}", "DIRECT") for k in range(many // 2, many)]
    sample = eligible_targets(rows(spark, pairs), NegativeConfig(pool=9)).collect()
    known = {(a, b) for a, b, _ in pairs}
    assert Counter(Counter(r.source_row for r in sample).values()) == {10: many}
    assert all((r.norm_a, r.candidate) not in known for r in sample)
    assert all(sorted(r.draw for r in sample if r.source_row == k) == list(range(1, 11)) for k in range(5))


def test_any_set_of_targets_is_as_likely_as_any_other(spark):
    pairs = [(f"s{k}", f"t{k % 16}", "DIRECT") for k in range(3200)]
    for pool in (1, 4):  # drawn with repeats left out, and by the order of all
        sample = eligible_targets(rows(spark, pairs), NegativeConfig(pool=pool)).collect()
        met = {}
        for r in sample:
            met.setdefault(r.source_row, []).append((r.draw, int(r.candidate[1:])))
        # of the pairs of targets (i, j) that stand first in a sample, each should come up as often; t(k mod 16) is excluded
        first = Counter(tuple(c for _, c in sorted(x)[:2]) for x in met.values())
        expected = len(met) * 14 / (16 * 15 * 14)
        chi = sum((first[i, j] - expected) ** 2 / expected for i in range(16) for j in range(16) if i != j)
        assert chi < 239 + 4 * (2 * 239) ** 0.5
        assert all((k % 16) not in [c for _, c in x] for k, x in met.items())


def test_the_hardest_need_few_ratios(spark):
    import random

    words = "customer account order number total amount date type status code address".split()
    draw = random.Random(3)
    names = ["_".join(draw.choice(words) for _ in range(draw.randint(1, 4))) + (f"_{k}" if k % 3 else "") for k in range(300)]
    group, a, b = [], [], []
    for k in range(60):
        for c in draw.sample(names, 100):
            group.append(k), a.append(names[k]), b.append(c)
    best, ratio, found = most_similar(np.array(group), a, b, 1, autojunk=True)
    assert found < 20 * 60
    for k, (i, r) in enumerate(zip(best, ratio, strict=True)):
        assert (-r, b[i]) == min((-SequenceMatcher(None, a[j], b[j]).ratio(), b[j]) for j in range(100 * k, 100 * k + 100))
    df = spark.createDataFrame(list(zip(group, a, b, range(len(b)), strict=True)), "source_row long, norm_a string, candidate string, draw int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {r.source_row: r.candidate for r in hardest(df, 2).filter("place = 1").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: b[i] for k, i in enumerate(best)}


def test_few_targets_repeat_and_none_give_none(spark):
    made = synthetic_negatives(rows(spark, [("a", "x", "DIRECT"), ("b", "y", "DERIVATION")]), NegativeConfig(2, 2, 5)).collect()
    assert {(r.A, r.B) for r in made} == {("a", "y"), ("b", "x")} and len(made) == 8
    assert synthetic_negatives(rows(spark, [("a", "b", "DIRECT"), ("b", "a", "DIRECT")]), NegativeConfig()).count() == 0
    assert synthetic_negatives(rows(spark, []), NegativeConfig()).count() == 0


def test_only_data_without_no_match_is_augmented(spark):
    with_one = rows(spark, [("a", "x", "DIRECT"), ("b", "y", "NO_MATCH")])
    assert contains_no_match(with_one) and augmented(with_one)[1] is False and augmented(with_one)[0].count() == 2
    more, made = augmented(rows(spark, [("a", "x", "DIRECT"), ("b", "y", "DIRECT")]))
    assert made and Counter(r.negative_type for r in more.collect()) == {"human": 2, "hard": 2, "random": 2}


def test_queries_compare_the_whole_pool(spark, monkeypatch):
    df = rows(spark, [(f"s{k}", f"t{k}", "DIRECT") for k in range(150)])
    monkeypatch.setattr(queries, "_clean", lambda spark, sf_dir: df)
    assert set(Counter(r.source_row for r in queries.q26_hard_negative_rank(spark, "").collect()).values()) == {101}


@pytest.mark.parametrize("bad", [{"random_per_positive": -1}, {"pool": 0}, {"seed": True}, {"hard_per_positive": 1.5}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        NegativeConfig(**bad)


def test_vocabulary_round_trip(spark):
    names = spark.createDataFrame([("abcé",), ("ab",), ("a🙂",)], "name string")
    counts = vocabulary.character_counts(names, "name")
    assert vocabulary.build_vocabulary(counts, 2) == ["<PAD>", "<UNK>", "a", "b"]
    tokens = vocabulary.build_vocabulary(counts)
    assert tokens == ["<PAD>", "<UNK>", "a", "b", "c", "é", "🙂"]
    got = names.select("name", vocabulary.encode(F.col("name"), tokens, 3).alias("ids")).select("*", vocabulary.decode(F.col("ids"), tokens).alias("back")).collect()
    assert {r.name: (r.ids, r.back) for r in got} == {"abcé": ([2, 3, 4], "abc"), "ab": ([2, 3, 0], "ab"), "a🙂": ([2, 6, 0], "a🙂")}
    with pytest.raises(ValueError):
        vocabulary.build_vocabulary(counts, 0)
