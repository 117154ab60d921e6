"""Matching by a trained model: pairs scored, groups retrieved, reranked and gated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import text
from fieldweave.operators import vocabulary
from fieldweave.operators.model import ModelBundle
from fieldweave.operators.retrieval import cosine_top_k
from fieldweave.shared import settle

#: Numbers of a pair's classes in a probability array.
_NO, _DIRECT, _DERIVED = (text.LABEL_NUMBERS[x] for x in ("NO_MATCH", "DIRECT", "DERIVATION"))


def encode_names(names: DataFrame, bundle: ModelBundle, column: str = "name", ids: Column | None = None) -> DataFrame:
    """``names`` (distinct normalized names) with vector: array of float, unit length.

    An empty name raises. Characters become numbers on the JVM side, vectors in Arrow batches.
    ``ids`` gives the numbers (an array of max_length ints) in place of the model's vocabulary.
    """
    length = bundle.config.max_length
    full = F.when(F.col(column) == "", F.raise_error(F.lit("a name is empty after normalization"))).otherwise(F.col(column))
    ids = vocabulary.encode(full, bundle.tokens, length) if ids is None else ids
    size = bundle.config.inference_batch_size
    model = names.sparkSession.sparkContext.broadcast(bundle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                v = model.value.encode(np.array(part["__ids"].tolist(), dtype=np.int64)).astype(np.float32)
                yield pd.DataFrame({column: part[column], "vector": list(v)})

    return names.select(column, ids.alias("__ids")).mapInPandas(run, f"`{column}` string, vector array<float>")


def classify(pairs: DataFrame, bundle: ModelBundle, a: str = "vector_a", b: str = "vector_b") -> DataFrame:
    """``pairs`` without its two vector columns, with p_no_match, p_direct and p_derivation."""
    model = pairs.sparkSession.sparkContext.broadcast(bundle)
    names = ["p_no_match", "p_direct", "p_derivation"]
    kept = [c for c in pairs.columns if c not in (a, b, *names)]
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} float" for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                p = model.value.probabilities(*(np.array(frame[c].tolist(), dtype=np.float64) for c in (a, b)))
                yield frame[kept].assign(p_no_match=p[:, _NO], p_direct=p[:, _DIRECT], p_derivation=p[:, _DERIVED])

    return pairs.select(*kept, a, b).mapInPandas(run, schema)


def predict_pairs(bundle: ModelBundle, rows: DataFrame) -> DataFrame:
    """Every row of ``rows`` (A, B, further columns) with probabilities, predicted_label and match_probability.

    Each distinct normalized name is encoded once. Repeated rows stay; equal probabilities go to the
    class of the lower number. No rows: no rows.
    """
    given = [c for c in rows.columns if c not in ("p_no_match", "p_direct", "p_derivation", "predicted_label", "match_probability", "__a", "__b")]
    named = settle(text.with_normalized(rows.select(*given), {"A": "__a", "B": "__b"}))
    names = named.select(F.col("__a").alias("name")).union(named.select("__b")).distinct()
    vectors = settle(encode_names(names, bundle))
    sides = named
    for side in ("a", "b"):
        sides = sides.join(vectors.select(F.col("name").alias(f"__{side}"), F.col("vector").alias(f"vector_{side}")), f"__{side}")
    scored = classify(sides.drop("__a", "__b"), bundle)
    best = F.greatest("p_no_match", "p_direct", "p_derivation")
    label = F.when(F.col("p_no_match") == best, "NO_MATCH").when(F.col("p_direct") == best, "DIRECT").otherwise("DERIVATION")
    return scored.select(*given, "p_no_match", "p_direct", "p_derivation", label.alias("predicted_label"), match_probability().alias("match_probability"))


def match_probability() -> Column:
    return F.col("p_direct") + F.col("p_derivation")


def rerank(candidates: DataFrame, source: str) -> DataFrame:
    """The candidate of largest match probability for each source; ties keep the retrieval order."""
    order = Window.partitionBy(source).orderBy(F.col("match_probability").desc(), "retrieval_rank")
    scored = candidates.withColumn("match_probability", match_probability())
    return scored.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == 1).drop("__n")


def gate(winners: DataFrame, target: str, *, review: float, auto: float) -> DataFrame:
    """best_B, predicted_label, rank and status; under the review threshold the target is blank."""
    check_thresholds(review, auto)
    p = F.col("match_probability")
    relation = F.when(F.col("p_direct") > F.col("p_derivation"), "DIRECT").otherwise("DERIVATION")
    return winners.withColumns({
        "best_B": F.when(p < review, "").otherwise(F.col(target).cast("string")),
        "predicted_label": F.when(p < review, "NO_MATCH").otherwise(relation),
        "status": F.when(p < review, "NO_MATCH").when(p < auto, "REVIEW").otherwise("AUTO_ACCEPT"),
        "rank": F.col("retrieval_rank"),
    })


def check_thresholds(review: float, auto: float, top_k: int = 1) -> None:
    if not (0 <= review <= 1 and 0 <= auto <= 1) or auto < review:
        raise ValueError("thresholds must be in [0, 1], the automatic one not below the one for review")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive whole number")


def ranked_candidates(bundle: ModelBundle, sources: DataFrame, targets: DataFrame, top_k: int) -> DataFrame:
    """a, b (normalized), retrieval_rank, retrieval_similarity: the ``top_k`` nearest targets of each
    distinct source. Matching and evaluation share it.

    sources: a; targets: b; both distinct and not empty.
    """
    names = sources.select(F.col("a").alias("name")).union(targets.select("b")).distinct()
    vectors = settle(encode_names(names, bundle))
    left = vectors.join(sources.select(F.col("a").alias("name")), "name", "left_semi")
    right = vectors.join(targets.select(F.col("b").alias("name")), "name", "left_semi")
    found = cosine_top_k(left, right, top_k, query_id="name", candidate_id="name", vector="vector")
    return found.select(F.col("query_id").alias("a"), F.col("candidate_id").alias("b"), F.col("rank").alias("retrieval_rank"), F.col("similarity").alias("retrieval_similarity"))


def scored_candidates(bundle: ModelBundle, candidates: DataFrame) -> DataFrame:
    """``candidates`` (a, b and more) with the probabilities of each pair."""
    names = candidates.select(F.col("a").alias("name")).union(candidates.select("b")).distinct()
    vectors = settle(encode_names(names, bundle))
    out = candidates
    for side in ("a", "b"):
        out = out.join(vectors.select(F.col("name").alias(side), F.col("vector").alias(f"vector_{side}")), side)
    return classify(out, bundle)


def match_groups(
    bundle: ModelBundle, source: DataFrame, target: DataFrame, *, top_k: int | None = None, review: float | None = None, auto: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(one row per source row, one row per candidate). source: A and source_row; target: B and source_row.

    Targets of one normalized name are one, spelled as its first row; sources stay as they are, one
    result each. No targets: all sources are NO_MATCH, with probability 0, similarity NaN and rank 0.
    """
    config = bundle.config
    top_k = config.top_k if top_k is None else top_k
    review = config.review_threshold if review is None else review
    auto = config.auto_accept_threshold if auto is None else auto
    check_thresholds(review, auto, top_k)
    # column names do not differ by case alone: A is the raw name, name_a its identity
    sources = settle(text.with_normalized(source.select("source_row", "A"), {"A": "name_a"}))
    spelled = text.with_normalized(target.select("source_row", "B"), {"B": "name_b"}).groupBy("name_b").agg(F.min_by("B", "source_row").alias("spelling"))
    spelled = settle(spelled)
    ranked = settle(ranked_candidates(bundle, sources.select(F.col("name_a").alias("a")).distinct(), spelled.select(F.col("name_b").alias("b")), top_k))
    scored = settle(scored_candidates(bundle, ranked)).withColumnsRenamed({"a": "name_a", "b": "name_b"}).join(spelled, "name_b")
    best = gate(rerank(scored, "name_a"), "spelling", review=review, auto=auto).drop("name_b", "spelling", "retrieval_rank")
    results = sources.join(best, "name_a", "left").select(
        "source_row", "A",
        F.coalesce("best_B", F.lit("")).alias("best_B"), F.coalesce("predicted_label", F.lit("NO_MATCH")).alias("predicted_label"),
        F.coalesce("match_probability", F.lit(0.0)).alias("match_probability"), F.coalesce("p_direct", F.lit(0.0)).alias("p_direct"), F.coalesce("p_derivation", F.lit(0.0)).alias("p_derivation"),
        F.coalesce("retrieval_similarity", F.lit(float("nan"))).alias("retrieval_similarity"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("status", F.lit("NO_MATCH")).alias("status"),
    )
    candidates = sources.join(scored, "name_a").select("source_row", "A", F.col("spelling").alias("candidate_B"), "retrieval_rank", "retrieval_similarity", "p_no_match", "p_direct", "p_derivation", match_probability().alias("match_probability"))
    return results, candidates
