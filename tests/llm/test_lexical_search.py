import math
import re
from collections import Counter

import numpy as np
import pytest

from fieldweave.llm import lexical_search
from fieldweave.llm.lexical_search import build_index, order_of, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, queries, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    documents, every = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = set()
    for item, text in queries:
        scored = []
        for (doc, _), c, size in zip(docs, counts, n, strict=True):
            m = 50 + 50 * size * documents // max(every, 1)
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scored[:k], 1)}
    return out


def corpus(seed=0, n=400):
    rng = np.random.default_rng(seed)
    topics = [[f"w{t}x{i}" for i in range(30)] for t in range(8)]
    common = ["the", "of", "Und", "été", "é", "x-ray", "ÄÖ", "naïve z"]
    docs = []
    for k in range(n):
        topic = topics[rng.integers(8)]
        docs.append((k, " ".join([*rng.choice(topic, rng.integers(1, 40)), *rng.choice(common, rng.integers(0, 9))])))
    docs += [(k, docs[3][1]) for k in range(1000, 1040)] + [(2000, None), (2001, ""), (2002, " .,\x00\x7f "), (None, docs[7][1]), docs[5], (2003, "w1x1 " * 3000 + "ende")]
    queries = [(k, docs[k * 13][1].upper() if k % 2 else docs[k * 13][1]) for k in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (53, "the"), (54, "ende"), (None, "w1x1 été")]
    return docs, queries


@pytest.mark.parametrize("small", [True, False])
def test_ranks_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical_search, "SAMPLE", 100)
        monkeypatch.setattr(lexical_search, "CLUSTER", 8)
        monkeypatch.setattr(lexical_search, "SHARD_DOCS", 30)
        monkeypatch.setattr(lexical_search, "QUERIES", 7)
    docs, queries = corpus()
    d = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, rank int, key string")
    q = spark.createDataFrame([(*x, 1) for x in queries], "item_id long, text string, score int")
    index = build_index(d)
    if small:
        assert index.shards.count() > 8
    got = search(index, q, 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_force(docs, queries, 20)


def test_clusters_are_left_out_by_their_bound(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CLUSTER", 8)
    monkeypatch.setattr(lexical_search, "LEVELS", 0)  # one leaf, so one shard
    docs, _ = corpus(n=600)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    (row,) = index.shards.collect()
    shard = {c: np.frombuffer(row[c], dtype=np.uint16 if c in ("cluster", "postings") else np.uint32) for c in ("clusters", "cluster", "starts", "tops", "postings", "parts")}
    ends = np.append(shard["clusters"][1:], len(shard["starts"]))
    shard["lengths"] = np.diff(np.append(shard["starts"], len(shard["postings"])).astype(np.int64))
    known = np.frombuffer(row["terms"], dtype=np.uint64)
    at = np.searchsorted(known, np.unique(lexical_search.terms_of("w1x1 w1x2 w1x3 w1x4", lexical_search.Words())))
    runs = [np.arange(shard["clusters"][a], ends[a]) for a in at]
    met = len(np.unique(shard["cluster"][np.concatenate(runs)]))

    class Counted(dict):
        read = 0

        def __getitem__(self, name):
            self.read += name == "postings"
            return super().__getitem__(name)

    counted = Counted(shard)
    lexical_search._visit(np.full(len(at), 1000), runs, counted, np.arange(len(row["docs"])), 5, 0)
    assert counted.read * lexical_search.STEP < met


def test_the_bisection_puts_alike_documents_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(8), 32))
    doc = np.repeat(np.arange(256), 12)
    term = np.concatenate([rng.choice(40, 12, replace=False) + 40 * t for t in topic])
    order = order_of(doc, term, 256, 32)
    assert sorted(order.tolist()) == list(range(256))
    changes = lambda x: int((x[1:] != x[:-1]).sum())
    assert changes(topic[order]) < 0.4 * changes(topic)
    assert order_of(doc, term, 256, 32).tolist() == order.tolist()


def test_equal_rows_beyond_a_shard(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 20)
    docs = [(1, "one text")] * 90 + [(2, "another")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert max(len(r.docs) for r in index.shards.collect()) < 90
    assert {tuple(r) for r in search(index, spark.createDataFrame([(1, "another text")], "item_id long, text string"), 5).collect()} == brute_force(docs, [(1, "another text")], 5)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(build_index(docs), asks).count() == 0
    assert search(build_index(some), asks.limit(0)).count() == 0
    assert search(build_index(some), spark.createDataFrame([(1, None), (2, "..")], "item_id long, text string")).count() == 0
