"""Quality figures of classifications, rankings and gated matches, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.text import LABEL_NUMBERS

THRESHOLDS = (0.8, 0.9, 0.95, 0.99)


def _share(part: Column, whole: Column, empty: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def confusion_matrix(rows: DataFrame, classes: Sequence[int]) -> DataFrame:
    """truth, prediction, count for every pair of classes, zeros included.

    rows: truth, prediction (ints). Values outside ``classes`` raise.
    """
    cells = [F.count_if((F.col("truth") == t) & (F.col("prediction") == p)).alias(f"c{t}_{p}") for t in classes for p in classes]
    known = F.col("truth").isin(*classes) & F.col("prediction").isin(*classes)
    checked = F.when(F.count_if(~F.coalesce(known, F.lit(False))) > 0, F.raise_error(F.lit("a class is not in the label map"))).otherwise(F.lit(0)).alias("__checked")
    told = F.explode(F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(p).alias("prediction"), F.col(f"c{t}_{p}").alias("count")) for t in classes for p in classes])).alias("cell")
    # the check is part of each count, so that no plan leaves it out
    return rows.agg(*cells, checked).select(told, "__checked").select("cell.truth", "cell.prediction", (F.col("cell.count") + F.coalesce("__checked", F.lit(0))).cast("long").alias("count"))


def per_class(matrix: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support; 0 where a denominator is 0."""
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("count")).otherwise(0)
    by_truth = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("count").alias("support"), F.sum(hit).alias("hits"))
    by_guess = matrix.groupBy(F.col("prediction").alias("class")).agg(F.sum("count").alias("guesses"))
    both = by_truth.join(by_guess, "class")
    zero = F.lit(0.0)
    rated = both.select("class", "support", _share(F.col("hits"), F.col("guesses"), zero).alias("precision"), _share(F.col("hits"), F.col("support"), zero).alias("recall"))
    return rated.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), zero)).select("class", "precision", "recall", "f1", "support")


def classification_summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro_f1 (over all classes, also those without rows), support."""
    macro = per_class(matrix).agg(F.avg("f1").alias("macro_f1"))
    hit = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("count")).otherwise(0))
    return matrix.agg(_share(hit, F.sum("count"), F.lit(0.0)).alias("accuracy"), F.sum("count").alias("support")).join(macro).select("accuracy", "macro_f1", "support")


def classification_metrics(rows: DataFrame, label_map: dict[str, int] | None = None) -> dict:
    """The report of a classification: accuracy, macro_f1, per_class and the matrix."""
    numbers = label_map or LABEL_NUMBERS
    names = {n: name for name, n in numbers.items()}
    order = sorted(names)
    matrix = confusion_matrix(rows, order)
    cells = {(r["truth"], r["prediction"]): r["count"] for r in matrix.collect()}
    known = rows.sparkSession.createDataFrame([(t, p, n) for (t, p), n in cells.items()], "truth int, prediction int, count long")
    total = classification_summary(known).first()
    return {
        "accuracy": total["accuracy"],
        "macro_f1": total["macro_f1"],
        "per_class": {names[r["class"]]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in per_class(known).orderBy("class").collect()},
        "confusion_matrix": [[cells[t, p] for p in order] for t in order],
        "labels": [names[n] for n in order],
    }


#: Another name that callers know it by.
pair_classification_metrics = classification_metrics


def first_hits(rankings: DataFrame, truth: DataFrame, cutoff: int | None = None) -> DataFrame:
    """source and first_rank (null: none) of every source that has a truth.

    rankings: source, target, rank; truth: source, target. Ranks beyond ``cutoff`` do not count.
    """
    seen = rankings if cutoff is None else rankings.filter(F.col("rank") <= cutoff)
    hits = seen.join(truth.select("source", "target").distinct(), ["source", "target"]).groupBy("source").agg(F.min("rank").alias("first_rank"))
    return truth.select("source").distinct().join(hits, "source", "left")


def retrieval_metrics(rankings: DataFrame, truth: DataFrame, *, ks: Sequence[int] = (1, 5, 10, 20), cutoff: int | None = None) -> DataFrame:
    """One row: evaluated_sources, skipped_sources (ranked, without truth), recall_at_k for each k and mrr."""
    if not ks or any(isinstance(k, bool) or k < 1 for k in ks):
        raise ValueError("each k must be a positive number")
    if cutoff is not None and max(ks) > cutoff:
        raise ValueError("no k may exceed the cutoff")
    first = first_hits(rankings, truth, cutoff)
    recalls = [F.coalesce(F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    mrr = F.coalesce(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr" if cutoff is None else f"mrr_at_{cutoff}")
    skipped = rankings.select("source").distinct().join(truth.select("source").distinct(), "source", "left_anti").agg(F.count("*").alias("skipped_sources"))
    return first.agg(F.count("*").alias("evaluated_sources"), *recalls, mrr).join(skipped)


def threshold_table(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """threshold, accepted_count, correct_count, precision (0 if none is accepted), coverage.

    rows: correct (boolean), confidence. A confidence that is not finite raises.
    """
    _check_thresholds(thresholds)
    finite = F.when(F.isnan("confidence") | F.col("confidence").isNull() | (F.abs("confidence") == float("inf")), F.raise_error(F.lit("confidences must be finite"))).otherwise(F.col("confidence"))
    rows = rows.withColumn("confidence", finite)
    sums = []
    for k, t in enumerate(thresholds):
        taken = F.col("confidence") >= t
        sums += [F.count_if(taken).alias(f"n{k}"), F.count_if(taken & F.col("correct")).alias(f"c{k}")]
    told = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("accepted_count"), F.col(f"c{k}").alias("correct_count")) for k, t in enumerate(thresholds)])).alias("t")
    table = rows.agg(F.count("*").alias("total"), *sums).select("total", told).select("total", "t.*")
    return table.select("threshold", "accepted_count", "correct_count", _share(F.col("correct_count"), F.col("accepted_count"), F.lit(0.0)).alias("precision"), _share(F.col("accepted_count"), F.col("total"), F.lit(0.0)).alias("coverage"))


def _check_thresholds(thresholds: Sequence[float]) -> None:
    if any(not 0.0 <= t <= 1.0 for t in thresholds):
        raise ValueError("thresholds must be in [0, 1]")


def gated_threshold_table(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """As threshold_table over sources with complete truth, with figures over all sources beside it.

    rows: correct, confidence, complete. Precision and coverage are null without a complete source.
    """
    _check_thresholds(thresholds)
    sums = [F.count("*").alias("total"), F.count_if("complete").alias("evaluated_sources")]
    for k, t in enumerate(thresholds):
        taken = F.col("confidence") >= t
        sums += [F.count_if(taken & F.col("complete")).alias(f"n{k}"), F.count_if(taken & F.col("complete") & F.col("correct")).alias(f"c{k}"), F.count_if(taken).alias(f"a{k}")]
    told = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("accepted_count"), F.col(f"c{k}").alias("correct_count"), F.col(f"a{k}").alias("all_sources_accepted_count")) for k, t in enumerate(thresholds)])).alias("t")
    table = rows.agg(*sums).select("total", "evaluated_sources", told).select("total", "evaluated_sources", "t.*")
    none = F.lit(None).cast("double")
    n = F.col("evaluated_sources")
    return table.select(
        "threshold", "accepted_count", "correct_count",
        F.when(n > 0, _share(F.col("correct_count"), F.col("accepted_count"), F.lit(0.0))).otherwise(none).alias("precision"),
        _share(F.col("accepted_count"), n, none).alias("coverage"),
        "evaluated_sources",
        (F.col("all_sources_accepted_count") - F.col("accepted_count")).alias("excluded_incomplete_accepted_count"),
        "all_sources_accepted_count",
        _share(F.col("all_sources_accepted_count"), F.col("total"), none).alias("all_sources_coverage"),
    )


def judged(predictions: DataFrame, truth: DataFrame, completeness: DataFrame | None = None) -> DataFrame:
    """One row per prediction: positive, target_ok, label_ok, complete, confidence.

    predictions: source, target, label, confidence; truth: source, target, label (several targets a
    source); completeness: source, complete (absent: false). A right target must bear its own label,
    a wrong one any label of its source.
    """
    known = truth.groupBy("source").agg(F.max((F.col("label") == "DIRECT").cast("int")).alias("direct"), F.max((F.col("label") == "DERIVATION").cast("int")).alias("derived"))
    exact = truth.groupBy("source", "target").agg(F.min("label").alias("own_label"))
    rows = predictions.join(exact, ["source", "target"], "left").join(known, "source", "left")
    if completeness is None:
        rows = rows.withColumn("complete", F.lit(False))
    else:
        rows = rows.join(completeness.select("source", "complete"), "source", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    of_source = ((F.col("label") == "DIRECT") & (F.col("direct") == 1)) | ((F.col("label") == "DERIVATION") & (F.col("derived") == 1))
    label_ok = F.when(F.col("own_label").isNotNull(), F.col("label") == F.col("own_label")).otherwise(F.coalesce(of_source, F.lit(False)))
    return rows.select("source", F.col("direct").isNotNull().alias("positive"), F.col("own_label").isNotNull().alias("target_ok"), label_ok.alias("label_ok"), "complete", "confidence")


def end_to_end_metrics(rows: DataFrame, *, review: float = 0.8, auto: float = 0.95) -> DataFrame:
    """One row of figures over ``judged`` rows.

    At the gate a positive source must be accepted and right, a source known to have no match must
    not be accepted; only sources with complete truth count there (null if there are none).
    """
    _check_thresholds((review, auto))
    if auto < review:
        raise ValueError("the auto-accept threshold must not be below the review threshold")
    positive, complete = F.col("positive"), F.col("complete")
    overall = F.col("target_ok") & F.col("label_ok")
    accepted, automatic = F.col("confidence") >= review, F.col("confidence") >= auto
    n_complete, n_positive = F.count_if(complete), F.greatest(F.count_if(positive), F.lit(1))
    none = F.lit(None).cast("double")

    def gated(ok: Column) -> Column:
        return _share(F.count_if(complete & F.when(positive, accepted & ok).otherwise(~accepted)), n_complete, none)

    auto_n = F.count_if(automatic & complete)
    return rows.agg(
        (F.count_if(F.col("target_ok") & positive) / n_positive).alias("top_1_correct_match_rate"),
        gated(F.col("label_ok")).alias("relationship_classification_accuracy"),
        gated(overall).alias("overall_end_to_end_accuracy"),
        (F.count_if(F.col("label_ok") & positive) / n_positive).alias("raw_positive_relationship_classification_accuracy"),
        (F.count_if(overall & positive) / n_positive).alias("raw_positive_end_to_end_accuracy"),
        F.when(n_complete > 0, _share(F.count_if(automatic & complete & overall), auto_n, F.lit(0.0))).alias("auto_accept_precision"),
        _share(auto_n, n_complete, none).alias("coverage"),
        auto_n.alias("auto_accept_count"),
        _share(F.count_if(automatic), F.count("*"), none).alias("all_sources_auto_accept_coverage"),
        F.count_if(automatic & ~complete).alias("excluded_incomplete_auto_accept_count"),
        F.count("*").alias("total_sources"),
        n_complete.alias("evaluated_sources"),
        F.count_if(~complete).alias("excluded_incomplete_sources"),
        F.count_if(positive).alias("known_positive_sources"),
        F.count_if(positive & complete).alias("positive_sources"),
        F.count_if(positive & ~complete).alias("incomplete_positive_sources"),
        F.count_if(~positive & complete).alias("no_match_only_sources"),
        F.count_if(~positive & ~complete).alias("unknown_no_match_sources"),
    )


def completeness(rows: DataFrame) -> DataFrame:
    """source and complete from rows norm_a, group_truth_complete (text true or false).

    Another spelling, or one source with both values, raises. Without the column all are false.
    """
    from fieldweave.functions.text import strict_boolean

    if "group_truth_complete" not in rows.columns:
        return rows.select(F.col("norm_a").alias("source")).distinct().withColumn("complete", F.lit(False))
    value = strict_boolean(F.coalesce(F.col("group_truth_complete").cast("string"), F.lit("")))
    value = F.when(value.isNull(), F.raise_error(F.lit("group_truth_complete must be true or false"))).otherwise(value)
    per = rows.select(F.col("norm_a").alias("source"), value.alias("v")).groupBy("source").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return per.select("source", F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("group_truth_complete differs within a source"))).otherwise(F.col("low")).alias("complete"))
