"""A model's quality on a labelled split: pairs, retrieval, and matches behind the gates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import text
from fieldweave.operators import matching, metrics
from fieldweave.operators.model import ModelBundle
from fieldweave.shared import settle


def evaluate_pairs(bundle: ModelBundle, rows: DataFrame) -> dict[str, Any]:
    """Accuracy and the like of the pairs' labels; says whether NO_MATCH could be judged."""
    number = F.create_map(*[F.lit(x) for kv in bundle.labels.items() for x in kv])
    found = matching.predict_pairs(bundle, rows.select("A", "B", "label"))
    report = metrics.classification_metrics(found.select(number[F.col("label")].alias("truth"), number[F.col("predicted_label")].alias("prediction")), bundle.labels)
    report["no_match_metrics_available"] = report["per_class"]["NO_MATCH"]["support"] > 0
    if not report["no_match_metrics_available"]:
        report["warning"] = "No row is labelled NO_MATCH, so its figures say nothing."
    return report


def _relevant(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("label").isin(*text.POSITIVE)).groupBy(F.col("norm_a").alias("source"), F.col("norm_b").alias("target")).agg(F.min("label").alias("label"))


def evaluate_matching(
    bundle: ModelBundle, rows: DataFrame, *, top_k: int | None = None, ks: Sequence[int] = (1, 5, 10, 20), depth: int | None = None, thresholds: Sequence[float] = metrics.THRESHOLDS
) -> tuple[dict[str, Any], dict[str, Any]]:
    """(retrieval report, end-to-end report) of a checked split (norm_a, norm_b, label, ...).

    Candidates are all distinct targets of the split. Retrieval looks ``depth`` deep (at least the
    largest k and top_k), reranking at the first top_k. Without rows both reports say so.
    """
    top_k = bundle.config.top_k if top_k is None else top_k
    ks = sorted(set(ks))
    matching.check_thresholds(bundle.config.review_threshold, bundle.config.auto_accept_threshold, top_k)
    least = max(*ks, top_k)
    if depth is None:
        depth = least
    elif isinstance(depth, bool) or not isinstance(depth, int) or depth < least:
        raise ValueError(f"the retrieval depth must be a whole number of at least {least}")
    sources, targets = rows.select(F.col("norm_a").alias("a")).distinct(), rows.select(F.col("norm_b").alias("b")).distinct()
    n_targets = targets.count()
    ranked = settle(matching.ranked_candidates(bundle, sources, targets, depth))
    truth = settle(_relevant(rows))
    seen = ranked.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("retrieval_rank").alias("rank"))
    figures = metrics.retrieval_metrics(seen.join(truth.select("source").distinct(), "source", "left_semi"), truth, ks=ks, cutoff=depth).first().asDict()
    retrieval = {f"Recall@{k}": figures[f"recall_at_{k}"] for k in ks} | {f"MRR@{depth}": figures[f"mrr_at_{depth}"]} | figures
    retrieval |= {"candidate_targets": n_targets, "retrieval_depth_requested": depth, "retrieval_depth_effective": min(depth, n_targets), "ranking_is_complete": depth >= n_targets, "field_identity": "normalized_name"}
    winners = settle(matching.rerank(matching.scored_candidates(bundle, ranked.filter(F.col("retrieval_rank") <= top_k)), "a"))
    relation = F.when(F.col("p_direct") > F.col("p_derivation"), "DIRECT").otherwise("DERIVATION")
    predictions = winners.select(F.col("a").alias("source"), F.col("b").alias("target"), relation.alias("label"), F.col("match_probability").cast("double").alias("confidence"))
    judged = settle(metrics.judged(predictions, truth, metrics.completeness(rows)))
    config = bundle.config
    end = metrics.end_to_end_metrics(judged, review=config.review_threshold, auto=config.auto_accept_threshold).first().asDict()
    table = metrics.gated_threshold_table(judged.select((F.col("target_ok") & F.col("label_ok")).alias("correct"), "confidence", "complete"), thresholds)
    end |= {
        "review_threshold": config.review_threshold, "auto_accept_threshold": config.auto_accept_threshold,
        "threshold_precision_coverage": [r.asDict() for r in table.orderBy("threshold").collect()],
        "retrieval_top_k_for_reranking": min(top_k, n_targets), "candidate_targets": n_targets, "field_identity": "normalized_name",
        "positive_diagnostics_scope": "all_sources_with_known_positive_targets",
        "mean_selected_retrieval_similarity": winners.agg(F.avg("retrieval_similarity")).first()[0],
    }
    if not n_targets:
        end["warning"] = "The split is empty, so matching cannot be judged."
    elif end["excluded_incomplete_sources"]:
        end["warning"] = f"{end['excluded_incomplete_sources']} sources whose truth is not complete count in no group figure: what is not annotated is not known to be no match."
    return retrieval, end


def evaluate(bundle: ModelBundle, rows: DataFrame, **how: Any) -> dict[str, Any]:
    """The whole report of a checked split."""
    rows = settle(rows)
    retrieval, end = evaluate_matching(bundle, rows, **how)
    positive = F.col("label").isin(*text.POSITIVE)
    summary = rows.agg(
        F.count("*").alias("rows"), F.count_if(positive).alias("positive_pairs"), F.count_if(~positive).alias("no_match_pairs"),
        F.count_distinct("A").alias("unique_source_fields"), F.count_distinct("B").alias("unique_target_fields"),
    ).first()
    return {"data_summary": summary.asDict(), "pair_classification": evaluate_pairs(bundle, rows), "retrieval": retrieval, "end_to_end": end}
