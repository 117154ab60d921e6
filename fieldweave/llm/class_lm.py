"""Language-model scoring with a Brown class bigram model.

p(text) = product of p(class | class before) p(word | class). Words are gathered into classes by the
exchange algorithm on bigram counts: each unit in turn moves to the class that raises the likelihood
most. A unit is one of the most frequent words, the end of a text, or all other words with endings of
one hash; so every word, a new one too, has a class, and the exchange works on a table of fixed size
that Spark has summed over all training texts. Word counts cover every word; those of rare words,
whose number is unbounded, reach the texts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.split import free
from fieldweave.shared import settle

#: Word classes; units; units that are hashes of endings (a power of two).
CLASSES, UNITS, ENDINGS = 64, 4096, 1024
#: Most frequent words whose counts go to every task; the others' are joined.
FREQUENT = 500_000
#: Words whose hashes a Python worker remembers.
REMEMBERED = 100_000
#: Added to each word's count; weight of the class frequencies in the transitions; exchange passes.
ADDED, BACKED, PASSES = 0.5, 5.0, 8


class Hashes(dict):
    """64-bit hash and ending number of each word (bytes); the dictionary holds where they stand."""

    def __init__(self) -> None:
        self.hashes, self.endings = np.empty(1 << 16, dtype=np.uint64), np.empty(1 << 16, dtype=np.int16)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at == len(self.hashes):
            self.hashes, self.endings = (np.concatenate((x, x)) for x in (self.hashes, self.endings))
        self.hashes[at], self.endings[at] = xxhash.xxh3_64_intdigest(word), xxhash.xxh32_intdigest(word[-3:]) % ENDINGS
        return at

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and endings of the words of a text, small letters for A-Z, and of the end."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        words.append(b"")
        if len(self) > REMEMBERED:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.hashes[at], self.endings[at]


#: Stands for the end of a text: the hash of a word of no letters, which no text holds.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))


def _summed(batches: Iterator[pa.RecordBatch], codes, names: list[str]) -> Iterator[pa.RecordBatch]:
    """How often each code of ``codes(text)`` comes, over some millions at a time; codes come alone or
    with a further value that each code always has."""

    def flushed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        value, at, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
        more = [pa.array(np.concatenate([p[k] for p in parts])[at]) for k in range(1, len(parts[0]))]
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *more, pa.array(n)], names=names)

    parts, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts.append(codes(text))
            size += len(parts[-1][0])
            if size >= 3_000_000:
                yield flushed(parts)
                parts, size = [], 0
    if parts:
        yield flushed(parts)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), ending, n over all texts, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(batches, Hashes().of, ["word", "ending", "n"])

    counted = texts.select("text").mapInArrow(run, "word long, ending short, n long")
    return counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Units:
    """The units of words: END is unit 0, then the frequent words, then the endings."""

    words: np.ndarray  #: sorted hashes of the frequent words
    number: np.ndarray  #: their units

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.number[at], (UNITS - ENDINGS) + endings.astype(np.int64))


def unit_bigrams(texts: DataFrame, units: Units) -> DataFrame:
    """code = unit * UNITS + next unit, n; a text begins after an end and closes with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()

        def codes(text: str | None) -> tuple[np.ndarray]:
            own = units.of(*hashes.of(text))
            return (np.concatenate(([0], own[:-1])) * UNITS + own,)

        return _summed(batches, codes, ["code", "n"])

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each unit; unit 0 keeps class 0 for itself.

    bigrams: counts of unit pairs. Units begin in classes by their frequency rank in turn. A unit
    moves where the log likelihood of the class bigrams grows most; ties and units that never occur
    stay where they are.
    """
    across = np.ascontiguousarray(bigrams.T)
    total = bigrams.sum(axis=1, dtype=np.float64) + across.sum(axis=1, dtype=np.float64)
    order = np.argsort(-total[1:], kind="stable") + 1
    own = np.zeros(len(bigrams), dtype=np.int64)
    own[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((len(bigrams), classes), dtype=np.float32)
    member[np.arange(len(bigrams)), own] = 1
    g = (member.T @ (bigrams @ member)).astype(np.float64)
    for _ in range(passes):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a = own[u]
            right = np.bincount(own, weights=bigrams[u], minlength=classes)
            left = np.bincount(own, weights=across[u], minlength=classes)
            self_ = float(bigrams[u, u])
            right[a] -= self_
            left[a] -= self_
            # take the unit out of its class
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= self_
            rows, columns = g.sum(axis=1), g.sum(axis=0)
            out, into = right.sum() + self_, left.sum() + self_
            gain = (_xlogx(g + right) - _xlogx(g)).sum(axis=1) + (_xlogx(g.T + left) - _xlogx(g.T)).sum(axis=1)
            d = np.diagonal(g)
            gain += _xlogx(d + right + left + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                b = a
            g[b] += right
            g[:, b] += left
            g[b, b] += self_
            own[u] = b
            moved += a != b
        if not moved:
            break
    return own


@dataclass
class Model:
    units: Units
    classes: np.ndarray  #: class of each unit
    step: np.ndarray  #: log10 p(class | class before)
    inside: np.ndarray  #: log10 of what divides (n + ADDED) in each class
    frequent: np.ndarray  #: sorted hashes of the most frequent words
    counts: np.ndarray  #: their counts
    tokens: int  #: training tokens
    distinct: int  #: distinct training tokens


def fit(texts: DataFrame, *, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of all rows of ``texts`` (text, null as empty) and the table of all word counts.

    The most frequent words are units; of words that come equally often those of least hash. No rows:
    every word has the class of its ending, and no count.
    """
    counts = settle(word_counts(texts))
    # of the counts themselves there are few
    levels = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)

    def most(limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (sorted) and counts of so many words: all above some count, and the first of that count by hash."""
        reached, level, rest = 0, levels[0][0] + 1 if levels else 1, 0
        for n, words in levels:
            if reached + words > limit:
                rest = limit - reached
                level = n
                break
            reached, level = reached + words, n
        whole = counts.filter(F.col("n") > level if rest or not reached else F.col("n") >= level).select("word", "n")
        if rest:
            whole = whole.unionByName(counts.filter(F.col("n") == level).select("word", "n").orderBy("word").limit(rest))
        table = whole.toArrow()
        word, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(word)
        return word[order], n[order]

    top, _ = most(UNITS - ENDINGS - 1)
    top = top[top != END]
    words = np.append(top, END)
    order = np.argsort(words)
    units = Units(words[order], np.append(np.arange(1, len(top) + 1), 0)[order])
    bigrams = np.zeros(UNITS * UNITS, dtype=np.float32)
    table = unit_bigrams(texts, units).toArrow()  # UNITS squared rows at most
    for batch in table.to_batches():
        bigrams[batch.column("code").to_numpy()] = batch.column("n").to_numpy()
    del table
    bigrams = bigrams.reshape(UNITS, UNITS)
    own = exchange(bigrams, classes)
    member = np.zeros((UNITS, classes), dtype=np.float32)
    member[np.arange(UNITS), own] = 1
    g = (member.T @ (bigrams @ member)).astype(np.float64)
    # tokens and distinct words of each unit: of the endings by a sum over all words that are no units
    frequent, n = most(FREQUENT)
    singles = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(w),) for w in words.view(np.int64)], "word long")), "word", "left_semi")
    tokens, distinct = np.zeros(classes), np.zeros(classes)
    for r in singles.collect():
        c = own[units.of(np.array([r["word"]], dtype=np.int64).view(np.uint64), np.zeros(1, np.int16))[0]]
        tokens[c] += r["n"]
        distinct[c] += 1
    others = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(w),) for w in words.view(np.int64)], "word long")), "word", "left_anti")
    for r in others.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        c = own[UNITS - ENDINGS + r["ending"]]
        tokens[c] += r["n"]
        distinct[c] += r["words"]
    share = (tokens + ADDED) / (tokens.sum() + ADDED * classes)
    step = np.log10((g + BACKED * share[None, :]) / (g.sum(axis=1, keepdims=True) + BACKED))
    return Model(units, own, step, np.log10(tokens + ADDED * (distinct + 1)), frequent, n, int(tokens.sum()), int(distinct.sum())), counts


def score(docs: DataFrame, fitted: tuple[Model, DataFrame]) -> DataFrame:
    """doc_id and other columns but text, with n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text, of any length (null: empty, its end alone).
    base_score is that of words by themselves, each with 0.5 added to its count; score that of the
    model; perplexity is per token. Repeated rows are scored each, equal texts alike; input columns of
    the result's names (in any case of letters) are replaced, others pass through. No rows: no rows; a
    model of no texts knows no word.
    """
    model, counts = fitted
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kept = [c for c in docs.columns if c.lower() not in (*new, "text")]
    tokens, hits, own_words, moves, rare, row, met, logs = own = [free(f"__{x}", [*docs.columns, *new]) for x in ("tokens", "hits", "words", "moves", "rare", "row", "met", "logs")]
    broad = docs.sparkSession.sparkContext.broadcast(model)
    base = float(np.log10(model.tokens + ADDED * (model.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = broad.value, Hashes()
        known = np.log10(m.counts + ADDED)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(len(kept)).to_pylist():
                each, unit = hashes.of(text)
                c = m.classes[m.units.of(each, unit)]
                at = np.minimum(np.searchsorted(m.frequent, each), max(0, len(m.frequent) - 1))
                hit = m.frequent[at] == each if len(m.frequent) else np.zeros(len(each), bool)
                words = float(known[at[hit]].sum()) if len(m.frequent) else 0.0
                steps = float(m.step[np.concatenate(([m.classes[0]], c[:-1])), c].sum() - m.inside[c].sum())
                for to, x in zip(out, (len(each), int(hit.sum()), words, steps, each[~hit].view(np.int64)), strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, out, kinds)], names=[*kept, *own[:5]])

    source = docs.select(*kept, "text")
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(c, k) for c, k in zip(own, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.ArrayType(T.LongType())), strict=False)])
    local = settle(source.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()))
    word, times = free("__word", docs.columns), free("__times", docs.columns)
    seen = local.select(row, F.explode(rare).alias(word)).groupBy(row, word).agg(F.count("*").alias(times))
    seen = seen.join(counts.select(F.col("word").alias(word), F.col("n").alias(hits)), word, "left").groupBy(row).agg(
        F.sum(F.when(F.col(hits).isNotNull(), F.col(times)).otherwise(0)).alias(met),
        F.sum(F.col(times) * F.log10(F.coalesce(hits, F.lit(0)) + F.lit(ADDED))).alias(logs),
    )
    words = F.col(own_words) + F.coalesce(logs, F.lit(0.0))
    total = local.drop(rare).join(seen, row, "left").select(
        *kept,
        F.col(tokens).alias("n_tokens"),
        (F.col(hits) + F.coalesce(met, F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (words - F.lit(base) * F.col(tokens)).alias("base_score"),
        (words + F.col(moves)).alias("score"),
    )
    return total.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
