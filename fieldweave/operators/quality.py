"""Audit of labelled name pairs: rejected rows, contradictions, duplicates, counts.

All take and give DataFrames; a raw table has A, B, label (strings), source_row and perhaps
synthetic. Null cells count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import text
from fieldweave.shared import settle


def classify_rows(raw: DataFrame) -> DataFrame:
    """``raw`` with canonical label, original_label, norm_a, norm_b and reasons (empty: valid).

    Reasons keep a fixed order; a blank label is missing, not invalid.
    """
    rows = raw.withColumns({c: F.coalesce(c, F.lit("")) for c in ("A", "B", "label")})
    rows = rows.withColumn("original_label", F.col("label")).withColumn("label", text.label(F.col("label")))
    rows = text.with_normalized(rows, {"A": "norm_a", "B": "norm_b"})

    def reason(name: str, when: Column) -> Column:
        return F.when(when, F.lit(name))

    blank = {c: text.is_blank(F.col(c)) for c in ("A", "B", "label")}
    found = [reason(f"missing_{c}", blank[c]) for c in ("A", "B", "label")]
    found.append(reason("invalid_label", ~blank["label"] & ~F.col("label").isin(*text.LABELS)))
    found += [reason(f"empty_normalized_{c}", ~blank[c] & (F.col(n) == "")) for c, n in (("A", "norm_a"), ("B", "norm_b"))]
    if "synthetic" in raw.columns:
        marker = text.synthetic_marker(F.coalesce("synthetic", F.lit("")))
        found += [reason("synthetic_record", F.coalesce(marker, F.lit(False))), reason("invalid_synthetic_marker", marker.isNull())]
    return rows.withColumn("reasons", F.array_compact(F.array(*found)))


def rejected_rows(classified: DataFrame) -> DataFrame:
    return classified.filter(F.size("reasons") > 0).select("A", "B", F.col("original_label").alias("label"), "source_row", F.array_join("reasons", ";").alias("reason"))


def valid_rows(classified: DataFrame) -> DataFrame:
    return classified.filter(F.size("reasons") == 0).select("A", "B", "label", "source_row", "norm_a", "norm_b")


def _contradicted(valid: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with more than one label; least and greatest label need no set in memory."""
    return valid.groupBy(*keys).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).select(*keys)


def conflicting_rows(valid: DataFrame) -> DataFrame:
    """Every row of a normalized pair that bears several labels, with its conflict_type."""
    raw = _contradicted(valid, ["A", "B"]).withColumn("raw", F.lit(True))
    rows = valid.join(_contradicted(valid, ["norm_a", "norm_b"]), ["norm_a", "norm_b"], "left_semi").join(raw, ["A", "B"], "left")
    return rows.select(
        "A", "B", "label", "source_row", F.col("norm_a").alias("normalized_A"), F.col("norm_b").alias("normalized_B"),
        F.when(F.col("raw"), "raw_pair").otherwise("normalized_pair").alias("conflict_type"),
    )


def clean_rows(valid: DataFrame) -> DataFrame:
    """Rows of uncontradicted pairs, the first (by source_row) of equal A, B and label."""
    kept = valid.join(_contradicted(valid, ["norm_a", "norm_b"]), ["norm_a", "norm_b"], "left_anti")
    first = kept.groupBy("A", "B", "label").agg(F.min_by(F.struct("source_row", "norm_a", "norm_b"), "source_row").alias("first"))
    return first.select("A", "B", "label", "first.*")


def label_distribution(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """label, count and ratio for each label, zeros included; ratio 0 without rows. ``by`` splits it."""
    by = by or []
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("label") == x).alias(x) for x in text.LABELS])
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("count")) for x in text.LABELS])).alias("cell")
    ratio = F.when(F.col("total") > 0, F.col("cell.count") / F.col("total")).otherwise(F.lit(0.0))
    return totals.select(*by, "total", cells).select(*by, "cell.label", "cell.count", ratio.alias("ratio"))


def duplicate_counts(valid: DataFrame) -> DataFrame:
    """One row: duplicate_pair_groups, duplicate_pair_rows, exact_duplicate_rows over all valid rows."""
    pairs = valid.groupBy("A", "B").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_pair_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pair_rows"))
    exact = valid.groupBy("A", "B", "label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_rows"))
    return pairs.join(exact)


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("count"))


def invalid_label_counts(classified: DataFrame) -> DataFrame:
    return classified.filter(F.array_contains("reasons", "invalid_label")).groupBy("label").agg(F.count("*").alias("count"))


def row_counts(classified: DataFrame) -> DataFrame:
    """One row of totals: all rows, missing cells, rejected rows and original labels."""
    missing = [F.count_if(F.array_contains("reasons", f"missing_{c}")).alias(f"missing_{c}") for c in ("A", "B", "label")]
    labels = [F.count_if(F.col("label") == x).alias(f"original_{x}") for x in text.LABELS]
    some = F.exists("reasons", lambda r: r.startswith("missing_"))
    return classified.agg(F.count("*").alias("total_rows"), *missing, F.count_if(some).alias("rows_with_missing_values"), F.count_if(F.size("reasons") > 0).alias("rejected_rows"), *labels)


#: Invalid labels that a report lists, the most frequent ones; the others are counted together.
REPORTED_LABELS = 1000


def quality_report(classified: DataFrame, valid: DataFrame, conflicts: DataFrame, clean: DataFrame) -> dict:
    """The audit as a small document; each figure is an aggregate. Rows are accounted for: a
    difference raises ValueError."""
    totals = row_counts(classified).first().asDict()
    duplicates = duplicate_counts(valid).first().asDict()
    n_valid, n_conflicts, n_clean = valid.count(), conflicts.count(), clean.count()
    removed = n_valid - n_conflicts - n_clean
    invalid = settle(invalid_label_counts(classified))
    told = invalid.orderBy(F.col("count").desc(), "label").limit(REPORTED_LABELS).collect()
    others = invalid.agg(F.count("*").alias("labels"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    report = {
        "total_rows": totals["total_rows"],
        "original_label_counts": {x: totals[f"original_{x}"] for x in text.LABELS},
        "missing": {c: totals[f"missing_{c}"] for c in ("A", "B", "label")},
        "rows_with_missing_values": totals["rows_with_missing_values"],
        "invalid_label_counts": {r["label"]: r["count"] for r in sorted(told, key=lambda r: r["label"])},
        "rejected_rows": totals["rejected_rows"],
        "rejection_reasons": {r["reason"]: r["count"] for r in reason_counts(classified).orderBy("reason").collect()},
        "eligible_rows_before_conflicts_and_deduplication": n_valid,
        **duplicates,
        "duplicate_rows_removed": removed,
        "conflicting_raw_pairs": _contradicted(valid, ["A", "B"]).count(),
        "conflicting_normalized_pairs": _contradicted(valid, ["norm_a", "norm_b"]).count(),
        "conflicting_rows": n_conflicts,
        "clean_rows": n_clean,
        "clean_label_distribution": {r["label"]: {"count": r["count"], "ratio": r["ratio"]} for r in label_distribution(clean).collect()},
    }
    if others["labels"] > len(told):  # a garbage column may have as many labels as rows
        report["other_invalid_labels"] = {"labels": others["labels"] - len(told), "rows": others["rows"] - sum(r["count"] for r in told)}
    if totals["total_rows"] != n_clean + n_conflicts + totals["rejected_rows"] + removed or removed < 0:
        raise ValueError("the rows do not add up")
    return report


def contradictions_to_first(rows: DataFrame, most: int = 10) -> DataFrame:
    """At most ``most`` rows, in file order, whose label differs from the first of their normalized pair.

    rows: norm_a, norm_b, label, source_row. Columns first_row and first_label tell the first.
    """
    first = rows.groupBy("norm_a", "norm_b").agg(F.min_by(F.struct("source_row", "label"), "source_row").alias("first"), F.min("label").alias("low"), F.max("label").alias("high"))
    first = first.filter(F.col("low") != F.col("high")).drop("low", "high")
    found = rows.join(first, ["norm_a", "norm_b"]).filter(F.col("label") != F.col("first.label"))
    return found.select("norm_a", "norm_b", "label", "source_row", F.col("first.source_row").alias("first_row"), F.col("first.label").alias("first_label")).orderBy("source_row").limit(most)
