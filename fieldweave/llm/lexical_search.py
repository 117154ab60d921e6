"""Ranked lexical search over documents in the order of a recursive graph bisection.

Building the index:
1. A bounded sample of texts is bisected recursively: documents change sides as long as that makes the
   halves' terms more alike inside. What the halves hold of each term gives every inner node weights.
2. Every document descends by these weights to a leaf; a leaf is one or several *shards* of bounded
   size (dealt by a hash, so many copies of one text spread too).
3. In its task a shard is bisected further, over all of its documents, down to *clusters* of some
   dozens. For each term of the shard the index holds the postings in that order and, for each
   cluster, where they start and the largest part that the cluster adds to a score.

Searching: a query's bound in a shard adds up the terms' largest parts there. First each query visits
the shard of its largest bound, which gives a score that the rest has to reach; then all shards whose
bound reaches it. Within a shard clusters are visited by falling bound, and the visit stops where the
bound is below the k-th score, so the result is exact. Places lead back to doc_id, which breaks ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.jaccard_join import by_group
from fieldweave.llm.lean import lean
from fieldweave.llm.shingles import Words
from fieldweave.shared import numbered, settle, small

#: Texts of the sample and the bytes that one may have (longer ones are indexed, not sampled), its terms, levels of its tree.
SAMPLE, SAMPLE_TEXT, VOCABULARY, LEVELS = 4_096, 16 << 10, 65_536, 6
#: Documents and bytes of text of a shard; documents of a cluster; rounds of exchange at each level.
SHARD_DOCS, SHARD_BYTES, CLUSTER, ROUNDS = 4_096, 4 << 20, 64, 4
#: Queries that are held at once, and clusters that are scored before the next look at the bound.
QUERIES, STEP = 1_000, 4

#: Bytes of a term as they are (small letters for A-Z); all others, which are ASCII, separate terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str, words: Words) -> np.ndarray:
    """64-bit hashes of the terms in their order, repeats included."""
    return words.of_bytes(text.encode("utf-8", "surrogatepass").translate(_TERM))


# ---------------------------------------------------------------- recursive graph bisection


@dataclass
class Level:
    """One level of a bisection: each document's node before it and its side; degrees by (node, term)."""

    node: np.ndarray
    side: np.ndarray
    node_of: np.ndarray
    term_of: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray


def _cost(degree: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Bits for the gaps of a list of so many of so many documents, about."""
    return degree * np.log2((docs + 1) / (degree + 1))


def bisect(doc: np.ndarray, term: np.ndarray, docs: int, least: int, levels: int = 60) -> Iterator[Level]:
    """Halves all parts of over ``least`` documents, level by level; doc and term are the postings.

    Each part starts halved as its documents stand. In each round the documents of both halves are
    ranked by what a change of side would save, and pairs of equal rank change while both together
    save something. Ties go by the documents' numbers, so the result is the same each time.
    """
    node = np.zeros(docs, dtype=np.int64)
    for _ in range(levels):
        count = np.bincount(node)
        open_ = count > least
        if not open_.any():
            return
        order = np.argsort(node, kind="stable")
        start = np.cumsum(count) - count
        at = np.empty(docs, dtype=np.int64)
        at[order] = np.arange(docs) - start[node[order]]
        side = (at >= (count[node] + 1) // 2) & open_[node]
        sizes = np.stack(((count + 1) // 2, count // 2), axis=1).astype(np.float64)
        # postings of parts that stay whole, and of terms that only one document of a part has, tell nothing
        own = open_[node[doc]]
        d, key = doc[own], node[doc[own]] * (int(term.max(initial=0)) + 1) + term[own]
        keys, kind, n = np.unique(key, return_inverse=True, return_counts=True)
        some = n > 1
        d, kind = d[some[kind]], (np.cumsum(some) - 1)[kind[some[kind]]]
        keys, n = keys[some], n[some]
        node_of, term_of = keys // (int(term.max(initial=0)) + 1), keys % (int(term.max(initial=0)) + 1)
        nl, nr = sizes[node_of, 0], sizes[node_of, 1]
        for _ in range(ROUNDS):
            left = np.bincount(kind, ~side[d], len(keys)).astype(np.float64)
            right = n - left
            now = _cost(left, nl) + _cost(right, nr)
            to_right = now - _cost(np.maximum(left - 1, 0), nl) - _cost(right + 1, nr)
            to_left = now - _cost(left + 1, nl) - _cost(np.maximum(right - 1, 0), nr)
            gain = np.bincount(d, np.where(side[d], to_left[kind], to_right[kind]), docs)
            order = np.lexsort((np.arange(docs), -gain, side, node))
            # in this order each part's left documents stand before its right ones, both by falling gain
            first = start[node[order]] + np.where(side[order], (count[node[order]] + 1) // 2, 0)
            rank = np.arange(docs) - first
            half = count // 2
            l = order[(~side[order]) & (rank < half[node[order]]) & open_[node[order]]]  # noqa: E741
            r = order[side[order] & (rank < half[node[order]]) & open_[node[order]]]
            change = gain[l] + gain[r] > 1e-9
            if not change.any():
                break
            side[l[change]] = True
            side[r[change]] = False
        left = np.bincount(kind, ~side[d], len(keys)).astype(np.float64)
        yield Level(node.copy(), side.copy(), node_of, term_of, left, n - left, sizes)
        _, node = np.unique(node * 2 + side, return_inverse=True)


def order_of(doc: np.ndarray, term: np.ndarray, docs: int, least: int) -> np.ndarray:
    """The documents (0 .. docs - 1) in the order of the bisection."""
    place = np.zeros(docs, dtype=np.int64)
    for level in bisect(doc, term, docs, least):
        _, place = np.unique(level.node * 2 + level.side, return_inverse=True)
    return np.argsort(place, kind="stable")


@dataclass
class Tree:
    """Weights of the sample's bisection. vocabulary: sorted term hashes; for each level the weight of
    each term at each node (right of it if their sum is above 0) and the next nodes."""

    vocabulary: np.ndarray
    weights: list[np.ndarray]
    children: list[np.ndarray]

    def leaves(self, doc: np.ndarray, hashes: np.ndarray, docs: int, tie: np.ndarray) -> np.ndarray:
        """Leaf of each document by its distinct terms; where the weights are even, by a bit of ``tie``."""
        node = np.zeros(docs, dtype=np.int64)
        if not len(self.vocabulary):
            return node
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        doc, at = doc[known], at[known]
        for depth, (weight, child) in enumerate(zip(self.weights, self.children, strict=True)):
            total = np.bincount(doc, weight[node[doc], at], docs)
            right = np.where(np.abs(total) > 1e-6, total > 0, (tie >> depth) & 1 == 1)
            node = child[node, right.astype(np.int64)]
        return node


def fit_tree(texts: list[str]) -> Tree:
    """The tree of a bisection of these texts, with at most ``VOCABULARY`` terms, those of most texts."""
    words = Words()
    each = [np.unique(terms_of(t, words)) for t in texts]
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    vocabulary, term, n = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    chosen = np.sort(np.lexsort((vocabulary, -n))[:VOCABULARY])
    chosen = chosen[n[chosen] > 1]
    number = np.full(len(vocabulary), -1)
    number[chosen] = np.arange(len(chosen))
    doc, term = doc[number[term] >= 0], number[term][number[term] >= 0]
    weights, children, nodes = [], [], 1
    for level in bisect(doc, term, len(each), CLUSTER, LEVELS):
        nl, nr = level.sizes[level.node_of, 0], level.sizes[level.node_of, 1]
        more_left = _cost(level.left + 1, nl + 1) - _cost(level.left, nl)
        more_right = _cost(level.right + 1, nr + 1) - _cost(level.right, nr)
        weight = np.zeros((nodes, len(chosen)), dtype=np.float32)
        weight[level.node_of, level.term_of] = more_left - more_right
        # a term that no document of the node has costs each side what its first one does
        halves, next_ = np.unique(level.node * 2 + level.side, return_inverse=True)
        child = np.zeros((nodes, 2), dtype=np.int64)
        child[level.node, level.side.astype(np.int64)] = next_
        whole = ~np.isin(np.arange(nodes) * 2 + 1, halves)  # not halved: all stay left
        child[whole, 1] = child[whole, 0]
        weights.append(weight), children.append(child)
        nodes = len(halves)
    return Tree(vocabulary[chosen], weights, children)


# ---------------------------------------------------------------- the index


@dataclass
class Index:
    """shards: a written table with a row for each shard; documents with a term, and terms of all of them."""

    shards: DataFrame
    documents: int
    terms: int


SHARD = "shard long, docs array<long>, keys array<long>, terms binary, df binary, peak binary, clusters binary, cluster binary, starts binary, tops binary, postings binary, parts binary"


def part_of_score(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence count adds to a score for each unit of the term's weight, in whole numbers."""
    m = 50 + 50 * n.astype(np.int64) * documents // max(terms, 1)
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * m)


def place_type(docs: int) -> type:
    """What holds a place in a shard of so many documents."""
    return np.uint16 if docs <= 1 << 16 else np.uint32


def _shard(shard: int, ids: pa.Array, keys: np.ndarray, texts: list[str], documents: int, terms: int, cluster: int, words: Words) -> dict:
    each = [np.unique(terms_of(t, words), return_counts=True) for t in texts]
    n = np.array([int(c.sum()) for _, c in each], dtype=np.int64)
    doc = np.repeat(np.arange(len(each)), [len(x) for x, _ in each])
    known, term = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True)
    order = order_of(doc, term, len(each), cluster)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    part = part_of_score(np.concatenate([c for _, c in each]), n[doc], documents, terms)
    at = np.lexsort((place[doc], term))
    place, term, part = place[doc][at], term[at], part[at]
    df = np.bincount(term, minlength=len(known))
    # a run for each term and cluster: where it starts, its largest part
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (place[1:] // cluster != place[:-1] // cluster)
    starts = np.flatnonzero(new)
    tops = np.maximum.reduceat(part, starts)
    first = np.searchsorted(term[starts], np.arange(len(known)))
    to = lambda x, kind: x.astype(kind).tobytes()
    narrow = place_type(len(each))
    return {
        "shard": shard, "docs": ids.take(pa.array(order)).to_pylist(), "keys": keys[order].tolist(), "terms": known.tobytes(), "df": to(df, np.uint32), "peak": to(np.maximum.reduceat(tops, first), np.uint32), "clusters": to(first, np.uint32),
        "cluster": to(place[starts] // cluster, narrow), "starts": to(starts, np.uint32), "tops": to(tops, np.uint32), "postings": to(place, narrow), "parts": to(part, np.uint32),
    }


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs`` whose text has a term.

    Null and empty texts and texts without a term are in no shard and count nowhere. Repeated rows and
    rows that repeat an id are documents each. Whole texts are indexed, whatever their length; a text
    longer than a shard may be has a shard with others of its own bucket. Terms are told apart by
    64-bit hashes. Other columns are not read. No rows: an empty index.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") > 0)
    # rows far from the lowest hashes are left where they are; of the others the lowest are taken
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    few = rows.filter(drawn / F.lit(float(1 << 40)) <= 4 * SAMPLE / max(1, docs.count()))
    sample = few.filter(F.octet_length("text") <= SAMPLE_TEXT).select(drawn.alias("h"), "text").orderBy("h", "text").limit(SAMPLE)
    tree = fit_tree(sample.select("text").toArrow().column("text").to_pylist())

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            each = [terms_of(t, words) for t in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in each], dtype=np.int64)
            distinct = [np.unique(x) for x in each]
            doc = np.repeat(np.arange(len(each)), [len(x) for x in distinct])
            leaf = tree.leaves(doc, np.concatenate(distinct), len(each), batch.column(1).to_numpy())
            turn = np.arange(seen, seen + len(each))  # tells equal rows apart when they are dealt
            seen += len(each)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(leaf), pa.array(turn)], names=["doc_id", "key", "text", "n", "leaf", "turn"])
            yield out.filter(pa.array(n > 0))

    # read and placed twice, so that no copy of all texts is written beside the one that is dealt to shards
    placed = rows.mapInArrow(lean(descend), "doc_id long, key long, text string, n long, leaf long, turn long")
    leaves = placed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row a leaf
    documents, terms = sum(r["docs"] for r in leaves), sum(r["terms"] for r in leaves)
    parts = {r["leaf"]: max(-(-r["docs"] // SHARD_DOCS), -(-r["bytes"] // SHARD_BYTES)) for r in leaves}
    first, plan, cluster = 0, [], CLUSTER
    for leaf in sorted(parts):
        plan.append((leaf, first, parts[leaf]))
        first += parts[leaf]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for group in by_group(batches, 1):
            group = group.combine_chunks()
            made = _shard(group.column(0)[0].as_py(), group.column(1).chunk(0), group.column(2).to_numpy(), group.column(3).to_pylist(), documents, terms, cluster, words)
            yield pa.RecordBatch.from_pylist([made], schema=schema)

    blob = lambda x: pa.field(x, pa.binary())
    schema = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), *(blob(x) for x in ("terms", "df", "peak", "clusters", "cluster", "starts", "tops", "postings", "parts"))])
    plan = F.broadcast(spark.createDataFrame(plan, "leaf long, first long, parts long"))
    dealt = placed.join(plan, "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("key", "turn"), F.col("parts")))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "key", "doc_id")
    shards = settle(dealt.select("shard", "doc_id", "key", "text").mapInArrow(lean(build), SHARD))
    return Index(shards, documents, terms)


# ---------------------------------------------------------------- the search


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


FOUND = "query long, score long, doc_id long, key long"


def _blob(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=kind)


def _visit(weights: np.ndarray, entry: list[np.ndarray], shard: dict, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a shard that reach ``least``.

    weights: of the query's terms that the shard has; entry: the numbers of their runs; ids: what
    breaks ties, by place.
    """
    runs = np.concatenate(entry)
    w = np.repeat(weights, [len(x) for x in entry])
    cluster = shard["cluster"][runs].astype(np.int64)
    met, of = np.unique(cluster, return_inverse=True)
    bound = np.zeros(len(met), dtype=np.int64)
    np.add.at(bound, of, w * shard["tops"][runs])
    order = np.lexsort((met, -bound))
    rank = np.empty(len(met), dtype=np.int64)
    rank[order] = np.arange(len(met))
    by_rank = np.argsort(rank[of], kind="stable")
    cut = np.searchsorted(rank[of][by_rank], np.arange(0, len(met) + STEP, STEP))
    best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(met), STEP):
        top = bound[order[at]]
        if top < max(least, 1) or len(best) == k and top < score[-1]:
            break
        own = by_rank[cut[at // STEP] : cut[at // STEP + 1]]
        low, n = shard["starts"][runs[own]].astype(np.int64), shard["lengths"][runs[own]]
        postings = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, inverse = np.unique(shard["postings"][postings], return_inverse=True)
        total = np.zeros(len(place), dtype=np.int64)
        np.add.at(total, inverse, np.repeat(w[own], n) * shard["parts"][postings])
        enough = total >= max(least, 1)
        best, score = np.concatenate((best, place[enough].astype(np.int64))), np.concatenate((score, total[enough]))
        kept = np.lexsort((ids[best], -score))[:k]
        best, score = best[kept], score[kept]
    return best, score


def search(index: Index, queries: DataFrame, k: int = 50, *, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the k documents of highest score above 0 for each row of ``queries``.

    Equal scores go by ascending doc_id (null last), then by a hash of id and text. Fewer matching
    documents give all of them; a null or empty query, or one without a known term, none. Repeated
    query rows are ranked each. The column of ids keeps its name and type. Queries are held in blocks
    of ``QUERIES``; each block reads the term lists of all shards once, and the postings of the shards
    that it has to visit. No rows on either side: no rows.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("query_id", "text"))
    asked = settle(numbered(settle(asked), ["h"], "query"))
    blocks = asked.agg(F.max("query")).first()[0]
    found = None
    for low in range(0, -1 if blocks is None else blocks + 1, QUERIES):
        block = asked.filter((F.col("query") >= low) & (F.col("query") < low + QUERIES)).select("query", "text").toArrow()
        own = settle(_search_block(index, dict(zip(block.column("query").to_pylist(), block.column("text").to_pylist(), strict=True)), k))
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = asked.sparkSession.createDataFrame([], FOUND)
    named = found.join(small(asked.select("query", "query_id")), "query")
    return ranked(named, k).select(F.col("query_id").alias(query_id), "rank", "doc_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: Index, texts: dict[int, str | None], k: int) -> DataFrame:
    spark = index.shards.sparkSession
    words = Words()
    terms = {q: np.unique(terms_of(t or "", words)) for q, t in texts.items()}
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms.values()]))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                known = _blob(batch, "terms", row, np.uint64)
                at = np.minimum(np.searchsorted(known, every), len(known) - 1)
                own = np.flatnonzero(known[at] == every)
                df, peak = (_blob(batch, c, row, np.uint32)[at[own]].astype(np.int64) for c in ("df", "peak"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("shard")[row].as_py())), pa.array(own), pa.array(df), pa.array(peak)], names=["shard", "term", "df", "peak"])

    peaks = settle(index.shards.select("shard", "terms", "df", "peak").mapInArrow(lean(met), "shard long, term long, df long, peak long"))
    df = {r["term"]: r["df"] for r in peaks.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # of the block's terms
    weights = np.array([weight(df[t], index.documents) if t in df else 0 for t in range(len(every))], dtype=np.int64)
    numbers = {q: np.searchsorted(every, x) for q, x in terms.items()}
    asking = small(settle(spark.createDataFrame([(int(t), q, int(weights[t])) for q, x in numbers.items() for t in x if weights[t]], "term long, query long, weight long")))
    bounds = settle(peaks.join(asking, "term").groupBy("shard", "query").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound")))
    first = Window.partitionBy("query").orderBy(F.col("bound").desc(), "shard")
    first = settle(bounds.withColumn("place", F.row_number().over(first)).filter(F.col("place") == 1).select("shard", "query", F.lit(0).cast("long").alias("least")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                known = _blob(batch, "terms", row, np.uint64)
                docs, keys = batch.column("docs")[row].values, batch.column("keys")[row].values.to_numpy()
                narrow = place_type(len(keys))
                shard = {c: _blob(batch, c, row, narrow if c in ("cluster", "postings") else np.uint32) for c in ("clusters", "cluster", "starts", "tops", "postings", "parts")}
                ends = np.append(shard["clusters"][1:], np.uint32(len(shard["starts"])))
                shard["lengths"] = np.diff(np.append(shard["starts"], np.uint32(len(shard["postings"]))).astype(np.int64))
                missing, ids = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                tie = np.empty(len(ids), dtype=np.int64)
                tie[np.lexsort((keys, ids, missing))] = np.arange(len(ids))
                out = []
                for ask in batch.column("asks")[row].as_py():
                    own = numbers[ask["query"]]
                    own = own[weights[own] > 0]
                    at = np.minimum(np.searchsorted(known, every[own]), len(known) - 1)
                    has = known[at] == every[own]
                    own, at = own[has], at[has]
                    if len(own):
                        place, score = _visit(weights[own], [np.arange(shard["clusters"][a], ends[a]) for a in at], shard, tie, k, ask["least"])
                        out.append((np.full(len(place), ask["query"]), score, place))
                if out:
                    query, score, place = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), docs.take(pa.array(place)), pa.array(keys[place])], names=["query", "score", "doc_id", "key"])

    def visited(plan: DataFrame) -> DataFrame:
        asks = plan.groupBy("shard").agg(F.collect_list(F.struct("query", "least")).alias("asks"))
        return index.shards.join(small(settle(asks)), "shard").mapInArrow(lean(visit), FOUND)

    found = settle(visited(first))
    least = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))).filter(F.col("place") == k).select("query", F.col("score").alias("least"))
    rest = bounds.join(first.select("shard", "query"), ["shard", "query"], "left_anti").join(F.broadcast(least), "query", "left")
    rest = settle(rest.withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).filter(F.col("bound") >= F.greatest("least", F.lit(1))).select("shard", "query", "least"))
    return ranked(found.unionByName(visited(rest)), k).drop("rank")
