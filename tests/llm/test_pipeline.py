import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard_join import brute_force as near_classes
from tests.llm.test_substring_dedup import brute_force as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["w%d" % k for k in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = text(90), text(200)
    rows, labels = [], []
    for k in range(260):
        own, toxic = text(rng.randrange(5, 120)), k % 3 == 0
        if toxic:
            own += rng.choice([" scumbag", " vermin", " loathsome"])
        if k % 11 == 1:
            own += " " + passage
        if k % 13 == 2:
            own = base.replace(rng.choice(base.split()), "edited")
        rows.append((k, own, "en", rng.choice(["a", "b", None]), len(own)))
        labels.append((k, 1, int(toxic and "edited" not in own)))
    rows += [(300, None, None, "c", 0), (301, "", "en", "c", 0), (302, rows[7][1], "en", "c", 1), (303, "one word", "en", "c", 8)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.dtypes, docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.dtypes == columns
        kept[name] = docs.collect()
    bad = {r.doc_id for r in before if r.text and {"scumbag", "vermin", "loathsome"} & set(r.text.split())}
    gone = {r.doc_id for r in before} - {r.doc_id for r in kept["toxicity"]}
    assert len(gone ^ bad) <= 0.02 * len(before)  # a classifier, from some 200 labelled texts
    rows = [(r.doc_id, r.text) for r in kept["toxicity"]]
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted({c for _, c, _ in near_classes(rows)})
    own = kept["near_duplicates"]
    want = {r.doc_id: b.decode(errors="ignore") for r, (_, b) in zip(own, repeats([r.text for r in own], corpus_pipeline.REPEATED_BYTES), strict=True)}
    assert {r.doc_id: r.text for r in kept["repeated_passages"]} == want and any(len(t) < len(r.text or "") for r, t in zip(own, want.values(), strict=True))
    assert all(r.n_chars == len(r.text) for r in kept["repeated_passages"])
    once = {r.doc_id: r for r in kept["repeated_passages"]}
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert all(c <= 3 for c in copies.values()) and all(once[r.doc_id] == r for r in kept["mixing"])


def test_a_passage_of_fifty_one_short_words_goes(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = " ".join(word(2) for _ in range(51))
    own = [" ".join(word(7) for _ in range(30)) for _ in range(6)]
    docs = spark.createDataFrame([(k, f"{t} {passage} {t[::-1]}") for k, t in enumerate(own)], "doc_id long, text string")
    got = [r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").orderBy("doc_id").collect()]
    assert len(passage) == 152 and sum(passage in t for t in got) <= 1
    assert all(t.startswith(o[:-3]) and t.endswith(o[::-1][3:]) for t, o in zip(got, own, strict=True))  # next letters may agree by chance


def test_the_whole_run(spark, folder):
    got, again = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert got == again and got
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    row = next(r for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.doc_id == 303)
    n = len(library.encode(row.text, add_special_tokens=False).ids) + 1
    pieces = [g for g in got if g[0] == 303]
    assert sum(g[2] for g in pieces) % n == 0
