"""From a raw file of labelled pairs to field-disjoint splits, with an audit of what was left out."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import text
from fieldweave.operators import grouping, quality
from fieldweave.shared import settle
from fieldweave.sources.pairs import read_raw_pairs
from fieldweave.sources.sinks import publish, to_json, write_csv, write_text

#: The files that a preparation leaves (fixed names).
FILES = ("train.csv", "validation.csv", "test.csv", "test_hard_cases.csv", "conflicting_pairs.csv", "rejected_rows.csv", "split_report.md", "split_statistics.json")


def check_parameters(ratios: Sequence[float], thresholds: Sequence[float]) -> None:
    if any(not math.isfinite(r) or not 0 <= r <= 1 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("the ratios must be in [0, 1] and add up to 1")
    if any(not math.isfinite(t) or not 0 <= t <= 1 for t in thresholds):
        raise ValueError("the thresholds must be in [0, 1]")


def _distribution(rows: DataFrame) -> dict[str, dict[str, Any]]:
    return {r["label"]: {"count": r["count"], "ratio": r["ratio"]} for r in quality.label_distribution(rows).collect()}


def _split_figures(rows: DataFrame, ratios: Sequence[float], total: int) -> dict[str, dict[str, Any]]:
    sizes = {r["split"]: r for r in grouping.split_summary(rows).collect()}
    labels: dict[str, dict] = {}
    for r in quality.label_distribution(rows, ["split"]).collect():
        labels.setdefault(r["split"], {})[r["label"]] = {"count": r["count"], "ratio": r["ratio"]}
    nothing = {x: {"count": 0, "ratio": 0.0} for x in text.LABELS}
    out = {}
    for split, ratio in zip(grouping.SPLITS, ratios, strict=True):
        own = sizes.get(split)
        n = own["rows"] if own else 0
        out[split] = {
            "rows": n, "target_ratio": ratio, "actual_ratio": n / total if total else 0.0, "components": own["components"] if own else 0,
            "normalized_field_count": own["normalized_field_count"] if own else 0, "label_distribution": labels.get(split, nothing),
        }
    return out


def _warnings(report: dict[str, Any], ratios: Sequence[float], example: bool) -> list[str]:
    q, groups, splits = report["data_quality"], report["connected_components"], report["splits"]
    out = []
    if q["rejected_rows"]:
        out.append(f"{q['rejected_rows']} rows were rejected; see rejected_rows.csv.")
    if q["conflicting_rows"]:
        out.append(f"{q['conflicting_rows']} rows contradict each other and wait for review; see conflicting_pairs.csv.")
    if not q["clean_rows"]:
        out.append("No clean rows are left: nothing to train or evaluate on.")
    if groups["largest_ratio"] > max(ratios):
        out.append("One connected component is larger than the largest split should be; it stays whole, so the target ratios cannot be met.")
    if groups["count"] < sum(r > 0 for r in ratios):
        out.append("There are fewer connected components than splits asked for; at least one split stays empty.")
    for name, own in splits.items():
        if not own["rows"] and own["target_ratio"] > 0:
            out.append(f"{name} is empty.")
        if abs(own["actual_ratio"] - own["target_ratio"]) > 0.05:
            out.append(f"{name} holds {own['actual_ratio']:.2%} of the rows instead of {own['target_ratio']:.2%}, because components are not cut.")
        absent = [x for x in text.LABELS if not own["label_distribution"][x]["count"]]
        if absent:
            out.append(f"{name} has no rows labelled {', '.join(absent)}.")
    if not q["original_label_counts"]["NO_MATCH"]:
        out.append("The source has no NO_MATCH rows, so NO_MATCH cannot be evaluated.")
    elif not q["clean_label_distribution"]["NO_MATCH"]["count"]:
        out.append("All NO_MATCH rows were left out in cleaning, so NO_MATCH cannot be evaluated.")
    for name in ("validation", "test"):
        if not splits[name]["label_distribution"]["NO_MATCH"]["count"]:
            out.append(f"{name} has no NO_MATCH rows; none were made up.")
    if example:
        out.append("Example data: these figures are no evidence of quality.")
    return out


def render_report(report: dict[str, Any]) -> str:
    """The audit as Markdown."""

    def table(head: Sequence[str], rows: Sequence[Sequence[Any]]) -> list[str]:
        cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
        return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]

    q, groups, hard = report["data_quality"], report["connected_components"], report["hard_test_cases"]
    lines = ["# Split report", "", f"Status: **{report['status']}**; ready for training: {report['ready_for_training']}; seed {report['seed']}; input `{report['input_path']}`.", "", "## Data quality", ""]
    lines += table(("figure", "value"), [(k, v) for k, v in q.items() if not isinstance(v, dict)])
    for name in ("original_label_counts", "missing", "invalid_label_counts", "rejection_reasons"):
        lines += [f"### {name}", "", *table(("value", "rows"), list(q[name].items()))]
    lines += ["## Splits", "", *table(("split", "rows", "target", "actual", "components", "fields", *text.LABELS), [(n, s["rows"], s["target_ratio"], s["actual_ratio"], s["components"], s["normalized_field_count"], *(s["label_distribution"][x]["count"] for x in text.LABELS)) for n, s in report["splits"].items()])]
    lines += ["## Leakage", "", *table(("splits", "shared fields"), [(k, v["shared_field_count"]) for k, v in report["leakage_check"].items()])]
    lines += ["## Connected components", "", *table(("figure", "value"), [(k, v) for k, v in groups.items() if k not in ("size_distribution", "top_20")])]
    lines += table(("component", "rows", "fields", "split", "names"), [(c["component_id"], c["rows"], c["fields"], c["split"], ", ".join(c["sample_fields"])) for c in groups["top_20"]])
    lines += ["## Hard test cases", "", *table(("reason", "rows"), list(hard["reason_counts"].items()))]
    lines += ["## Warnings", "", *(f"- {w}" for w in report["warnings"] or ["none"]), ""]
    return "\n".join(lines)


def prepare(
    spark: SparkSession, input_path: str, output_dir: str, *, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42,
    hard_positive: float = 0.4, hard_negative: float = 0.7, example_data: bool = False, one_file: bool = True,
) -> dict[str, Any]:
    """Reads, audits, groups, splits and publishes; gives the report.

    Nothing is published if reading fails or two splits share a name. Whole components go to one
    split, no row is made up, and every row of the input is in the clean, conflicting, rejected or
    repeated ones.
    """
    check_parameters(ratios, (hard_positive, hard_negative))
    folder = str(output_dir).rstrip("/")
    if str(input_path) in {f"{folder}/{name}" for name in FILES}:
        raise ValueError("the input must not be one of the files to be written")
    classified = settle(quality.classify_rows(read_raw_pairs(spark, input_path)))
    valid = quality.valid_rows(classified)
    conflicts, clean = settle(quality.conflicting_rows(valid)), settle(quality.clean_rows(valid))
    figures = quality.quality_report(classified, valid, conflicts, clean)
    rows = settle(grouping.split_rows(grouping.with_components(clean), ratios, seed))
    pairs = (("train", "test"), ("train", "validation"), ("validation", "test"))
    leaks = {f"{a}_{b}": {"shared_field_count": 0, "shared_fields": []} for a, b in pairs}
    leaks |= {f"{r['left']}_{r['right']}": {"shared_field_count": r["count"], "shared_fields": r["sample"]} for r in grouping.leakage(rows).collect()}
    if any(x["shared_field_count"] for x in leaks.values()):
        raise RuntimeError("splits share normalized names; nothing was published")
    hard = settle(grouping.hard_cases(rows.filter("split = 'test'"), hard_positive, hard_negative))
    reasons = {r["reason"]: r["n"] for r in hard.select(F.explode(F.split("reasons", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()}
    table = settle(grouping.component_table(rows))
    summary = grouping.component_summary(table).first().asDict()
    split_of = rows.groupBy("component_id").agg(F.first("split").alias("split"))
    top = grouping.largest_components(table).join(split_of, "component_id").orderBy(F.col("rows").desc(), "component_id").collect()
    total = figures["clean_rows"]
    report: dict[str, Any] = {
        "schema_version": 1, "input_path": str(input_path), "seed": seed, "example_data": example_data, "strategy": "normalized_field_disjoint_connected_components",
        "status": "ok", "ready_for_training": False, "data_quality": figures, "splits": _split_figures(rows, ratios, total), "leakage_check": leaks,
        "connected_components": {
            "count": summary["count"], "size_unit": "cleaned rows (not fields)",
            "size_distribution": {str(r["rows"]): r["components"] for r in grouping.component_sizes(table).collect()},
            **{k: summary[k] for k in ("min_rows", "median_rows", "max_rows", "largest_ratio")},
            "top_20": [{"component_id": r["component_id"], "rows": r["rows"], "fields": r["fields"], "ratio": r["rows"] / total, "split": r["split"], "label_counts": {x: r[x] for x in text.LABELS}, "sample_fields": r["sample_fields"]} for r in top],
        },
        "hard_test_cases": {
            "total_rows": hard.count(), "hard_positive": reasons.get("hard_positive", 0), "hard_negative": reasons.get("hard_negative", 0), "reason_counts": reasons,
            "positive_similarity_threshold": hard_positive, "negative_similarity_threshold": hard_negative,
        },
    }
    report["warnings"] = _warnings(report, ratios, example_data)
    splits = report["splits"]
    usable = bool(total) and all(s["rows"] for s in splits.values() if s["target_ratio"] > 0)
    report["status"] = "unusable" if not usable else "warning" if report["warnings"] else "ok"
    report["ready_for_training"] = all(s["rows"] for s in splits.values())

    def csv(df: DataFrame):
        return lambda path: write_csv(df, path, one_file=one_file)

    in_order = lambda df: df.orderBy("source_row")
    files = {f"{s}.csv": csv(in_order(rows.filter(F.col("split") == s)).select("A", "B", "label")) for s in grouping.SPLITS}
    files["test_hard_cases.csv"] = csv(in_order(hard))
    files["conflicting_pairs.csv"] = csv(in_order(conflicts))
    files["rejected_rows.csv"] = csv(in_order(quality.rejected_rows(classified)))
    files["split_report.md"] = lambda path: write_text(spark, path, render_report(report))
    files["split_statistics.json"] = lambda path: write_text(spark, path, to_json(report))
    publish(spark, folder, files)
    return report
