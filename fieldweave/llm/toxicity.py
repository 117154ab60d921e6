"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the words that occur in a text and their beginnings (4 and 6 characters). Besides the usual loss it
pays for changing its score when an identity term of a labelled text is swapped for another (logit
pairing), so mentioning a group is no sign of toxicity in itself. An L1 term keeps only the features
that carry the label, so that a long text is not toxic by its length.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.lean import lean
from fieldweave.shared import settle, small

#: Hashed features; most labelled rows that the classifier is fitted on.
BUCKETS, TRAINING_ROWS = 1 << 18, 20_000
#: Weights of the counterfactual and the L1 term; features of fewer training texts are not used.
PAIRING, L1, LEAST = 1.0, 2e-4, 3
#: Features whose chi-square with the label is below this (10 of 100 would pass it by chance) are not used.
LEVEL = 2.71
#: Terms for groups of people, by kind; a term is swapped for the others of its kind (fixed values).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("femmes", "hommes"),
    ("musulman", "chrétien", "juif", "athée"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
_EDGES = string.punctuation + string.whitespace + "“”‘’«»¿¡…–—"
#: Lengths of the beginnings that are features of a longer word.
BEGINNINGS = (4, 6)
#: Words a task remembers; at the limit it starts anew.
REMEMBERED = 150_000


def _plain(token: str) -> str:
    return token.lower().strip(_EDGES)


class Features(dict):
    """Numbers of the words of texts and of their beginnings."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets

    def __missing__(self, token: str) -> tuple[int, ...]:
        word = _plain(token)
        keys = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)] if word else []
        found = self[token] = tuple(xxhash.xxh3_64_intdigest(k) % self.buckets for k in keys)
        return found

    def of(self, tokens: list[str]) -> np.ndarray:
        """Sorted distinct feature numbers."""
        if len(self) > REMEMBERED:
            self.clear()
        found = set(chain.from_iterable(map(self.__getitem__, set(tokens))))
        return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def swapped(tokens: list[str]) -> list[str] | None:
    """The tokens with each identity term replaced by another of its kind; None if there is none."""
    out, changed = [], False
    for at, token in enumerate(tokens):
        word = _plain(token)
        kind = _KIND.get(word)
        if kind:
            # the place in the text picks the other term, so that all of them come up
            word, changed = kind[(kind.index(word) + 1 + at % (len(kind) - 1)) % len(kind)], True
        out.append(word if kind else token)
    return out if changed else None


_KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features].sum(), -30, 30))))


def _sums(cells: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*cells, np.zeros(0, np.int32)]), np.repeat(values, [len(c) for c in cells])


def train(cells: list[np.ndarray], labels: np.ndarray, others: list[np.ndarray | None], *, pairing: float = PAIRING, l1: float = L1, rounds: int = 300) -> Model:
    """Proximal gradient steps with momentum on the mean loss; ``others``: features after the swap."""
    n = len(cells)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))) if n else -3.0)
    flat, row = _sums(cells, np.arange(n))
    used = np.bincount(flat, minlength=BUCKETS) >= LEAST
    flat, row = flat[used[flat]], row[used[flat]]
    pairs = [(a, b) for a, b in zip(cells, others, strict=True) if b is not None]
    m = len(pairs)
    plus, plus_row = _sums([a for a, _ in pairs], np.arange(m))
    minus, minus_row = _sums([b for _, b in pairs], np.arange(m))
    number = np.cumsum(used) - 1  # the features in use, densely
    flat = number[flat]
    plus_row, plus = plus_row[used[plus]], number[plus[used[plus]]]
    minus_row, minus = minus_row[used[minus]], number[minus[used[minus]]]
    size = int(used.sum())
    w = v = np.zeros(size)
    bias = float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    squares, bias_squares, t = np.full(size, 1e-8), 1e-8, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, v[flat], n), -30, 30)))
        error = (p - labels) / n
        grad = np.bincount(flat, error[row], size)
        if m:
            gap = np.bincount(plus_row, v[plus], m) - np.bincount(minus_row, v[minus], m)
            grad += 2 * pairing / n * (np.bincount(plus, gap[plus_row], size) - np.bincount(minus, gap[minus_row], size))
        squares += grad * grad
        bias_squares += error.sum() ** 2
        step = 0.5 / np.sqrt(squares)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - np.minimum(step * l1, 1.0), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + min((t - 1) / t_new, 0.5) * (new - w)
        w, t = new, t_new
        bias -= 0.5 / np.sqrt(bias_squares) * error.sum()
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, rows: int = TRAINING_ROWS) -> Model:
    """Learns from at most ``rows`` labelled rows (lowest hash of the id) where ``learn`` holds.

    ``labels`` has doc_id and toxic; rows with a null in either teach nothing. An id labelled twice
    counts with its larger label; of documents that share an id one teaches, that of the least hash
    of its text. Null texts read as empty, long ones are read whole. The features that tell of the
    label come to the driver, not the texts. No labelled rows: every score is low (0.05).
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    one = hashed.select("doc_id", "hash").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("hash").alias("hash"))
    sample = hashed.join(small(settle(one)), ["doc_id", "hash"]).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for batch in batches:
            tokens = [(t or "").split() for t in batch.column(2).to_pylist()]
            other = [swapped(t) for t in tokens]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.of(t) for t in tokens], ints), pa.array([None if o is None else own.of(o) for o in other], ints)], names=["doc_id", "toxic", "cells", "other"])

    told = sample.mapInArrow(lean(features), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, cells array<int>, other array<int>")
    told = settle(told.dropDuplicates(["doc_id"]))
    met = told.select("toxic", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas()  # BUCKETS rows at most
    total, toxic = told.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = telling(met["cell"].to_numpy(dtype=np.int64), met["n"].to_numpy(dtype=float), met["toxic"].to_numpy(dtype=float), total, toxic)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = lambda c: None if c is None else (c := np.asarray(c, dtype=np.int32))[np.isin(c, chosen)]
        for batch in batches:
            lists = [pa.array([only(c) for c in batch.column(k).to_pylist()], pa.list_(pa.int32())) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "cells", "other"])

    table = told.mapInArrow(lean(kept), told.schema).toPandas().sort_values("doc_id", kind="stable")
    as_array = lambda x: None if x is None else np.asarray(x, dtype=np.int32)
    return train([as_array(c) for c in table["cells"]], table["toxic"].to_numpy(dtype=np.float64), [as_array(o) for o in table["other"]])


def telling(cells: np.ndarray, n: np.ndarray, toxic: np.ndarray, total: int, all_toxic: int) -> np.ndarray:
    """The features that tell of the label (chi-square of at least ``LEVEL``), and those of identity terms."""
    expected = n * all_toxic / max(1, total)
    strength = (toxic - expected) ** 2 / np.maximum(expected * (1 - n / max(1, total)), 1e-9)
    own = Features()
    return np.union1d(cells[(n >= LEAST) & (strength >= LEVEL)], own.of([t for kind in IDENTITY_TERMS for t in kind])).astype(np.int32)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with toxicity (0 to 1; or as ``name`` says) of every whole text, null read as empty; the text stays.

    An input column of that name is replaced, others pass through, nulls too; repeated rows are
    scored each, equal texts alike. Very long texts are read whole, a text at a time. No rows: no rows.
    """
    docs = docs.drop(name)
    names = docs.columns
    at = names.index("text")
    kept = np.flatnonzero(model.weights)
    values = model.weights[kept]
    bias, buckets = model.bias, len(model.weights)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(buckets, np.float32)
        weights[kept] = values
        own, whole = Features(buckets), Model(weights, bias)
        for batch in batches:
            scores = [whole.score(own.of((t or "").split())) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, name])

    return docs.mapInArrow(lean(run), schema)
