"""Language identification by the nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams (1 to 3) over its letters;
each language has several centroids, found by spherical k-means on its training vectors; the
language of the centroid with the largest cosine is predicted. A text farther from every centroid
than nearly all training texts of that language are from theirs is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.shared import settle, small

#: Hashed n-grams, centroids a language and most training rows a language.
BUCKETS, CENTROIDS, PER_LANGUAGE = 4096, 4, 800
#: A text is rejected under this quantile of the training cosines, times this factor.
QUANTILE, FACTOR = 0.005, 0.6


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """A row of n-gram counts for each text; a run of other characters than letters is one blank."""
    out = np.zeros((len(texts), buckets), dtype=np.float32)
    mask, known = np.uint32(buckets - 1), letters()
    for row, text in enumerate(texts):
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = np.where(known[code], code, np.uint32(32))
        code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
        if len(code) < 2:
            continue
        gram = code
        for n in range(3):
            if n:
                gram = gram[:-1] * np.uint32(0x9E3779B1) + code[n:]
                if not len(gram):
                    break
            h = gram * np.uint32(0x85EBCA6B)
            own = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(16)) & mask
            out[row] += np.bincount(own, minlength=buckets)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  #: unit rows
    owner: np.ndarray  #: language of each centroid
    least: np.ndarray  #: cosine under which a text of the language is rejected

    def vectors(self, found: np.ndarray) -> np.ndarray:
        v = np.log1p(found) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _centroids(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun at rows evenly spaced by their cosine to the mean, so at no outlier."""
    k = min(k, len(v))
    order = np.argsort(v @ v.mean(axis=0), kind="stable")
    c = v[order[((np.arange(k) + 0.5) * len(v) / k).astype(int)]]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def fit(docs: DataFrame, train: Column, *, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows where ``train`` holds, text has a letter and lang is not null.

    Every language is learnt, from at most ``per_language`` of its rows: those of lowest hash of id
    and text (ties fall by that hash), where rows equal in both count once. Each language's rows meet in
    one task, which gives its centroids; the driver sees only those. No such rows: no languages, and
    all texts are ``und``.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("__row"))
    # a hash in [0, 1): rows far above the few lowest of their language never reach the window
    drawn = F.pmod(F.xxhash64("__row", F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    each = settle(rows.select("lang", "__row").distinct().withColumn("__drawn", drawn))
    sizes = small(settle(each.groupBy("lang").agg(F.count("*").alias("count"), F.min("__drawn").alias("least"))))
    few = each.join(sizes, "lang").filter((F.col("__drawn") * F.col("count") < 4 * per_language) | (F.col("__drawn") == F.col("least")))
    ranked = Window.partitionBy("lang").orderBy("__drawn", "__row")
    picked = few.withColumn("__n", F.row_number().over(ranked)).filter(F.col("__n") <= per_language).select("lang", "__row")
    sample = rows.join(small(settle(picked)), ["lang", "__row"]).groupBy("lang", "__row").agg(F.first("text").alias("text")).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(lang, text) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(text)]
            found = counts([text for _, text in own])
            cells = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in own], pa.string()), pa.array(cells, pa.list_(pa.int32())), pa.array([f[c] for f, c in zip(found, cells, strict=True)], pa.list_(pa.float32()))], names=["lang", "cell", "n"])

    table = settle(sample.mapInArrow(features, "lang string, cell array<int>, n array<float>"))
    seen = np.zeros(BUCKETS)
    for r in table.select(F.explode("cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("rows")).collect():
        seen[r["cell"]] = r["rows"]
    idf = np.log((1 + table.count()) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    model = Model([], idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))

    def learnt(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("cell").to_pylist(), group.column("n").to_pylist(), strict=True))
        found = np.zeros((len(own), BUCKETS), dtype=np.float32)
        for row, (cell, n) in enumerate(own):
            found[row, cell] = n
        v = model.vectors(found)
        c = _centroids(v, centroids)
        least = FACTOR * np.quantile((v @ c.T).max(axis=1), QUANTILE)
        return pa.table({"lang": group.column("lang")[:1].combine_chunks(), "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary()), "least": pa.array([least], pa.float64())})

    told = sorted(table.groupBy("lang").applyInArrow(learnt, "lang string, centroids binary, least double").collect(), key=lambda r: r["lang"])
    if not told:
        return model
    own = [np.frombuffer(r["centroids"], dtype=np.float32).reshape(-1, BUCKETS) for r in told]
    return Model([r["lang"] for r in told], idf, np.concatenate(own), np.repeat(np.arange(len(own)), [len(c) for c in own]), np.array([r["least"] for r in told]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (the cosine, 0 to 1) and rejected, of every whole text.

    ``und`` with score 0 (and rejected) where the text is null or has no letter, or no language was
    learnt. A rejected text keeps its nearest language in lang_pred. Of languages that are equally
    near the first in code-point order is taken. Whole texts are read, of any length. Input columns of
    the result's names (in any case of letters) are replaced, others pass through; repeated rows are
    predicted each. No rows: no rows.
    """
    names = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c.lower() not in (*names, "text")]
    docs = docs.select(*kept, "text")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred: list = []
            texts = batch.column(len(kept)).to_pylist()
            for at in range(0, len(texts), 200):
                part = texts[at : at + 200]
                ok = [has_letter(t) and bool(model.languages) for t in part]
                got = iter(())
                if any(ok):
                    cosines = model.vectors(counts([t for t, good in zip(part, ok, strict=True) if good])) @ model.centroids.T
                    best = cosines.argmax(axis=1)
                    got = iter([(model.languages[k := model.owner[b]], float(np.clip(c[b], 0, 1)), bool(c[b] < model.least[k])) for b, c in zip(best, cosines, strict=True)])
                pred += [next(got) if good else ("und", 0.0, True) for good in ok]
            arrays = [pa.array([p[i] for p in pred], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, *names])

    return docs.mapInArrow(run, schema)
