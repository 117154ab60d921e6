"""Validation of three splits and the training of a model on them."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.config import MatcherConfig
from fieldweave.functions import text
from fieldweave.operators import grouping, negatives, quality, vocabulary
from fieldweave.operators.model import ModelBundle, train_on
from fieldweave.plans.evaluate import evaluate
from fieldweave.shared import numbered, settle
from fieldweave.sources.pairs import DataValidationError, read_labelled
from fieldweave.sources.sinks import current, log_to, run_directory, to_json


def validate(spark: SparkSession, data_dir: str = "data_split", *, strict: bool = True, **explicit: str | None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """The three checked splits and a report; names shared by splits raise unless ``strict`` is off.

    explicit: paths of train, validation or test that override the folder's.
    """
    splits = {s: settle(read_labelled(spark, explicit.get(s) or current(spark, data_dir, f"{s}.csv"), s)) for s in grouping.SPLITS}
    columns = ["A", "B", "label", "norm_a", "norm_b", "split"]
    rows = None
    for name, own in splits.items():
        own = own.withColumn("split", F.lit(name)).select(*columns)
        rows = own if rows is None else rows.unionByName(own)
    leaks: dict[str, dict[str, Any]] = {}
    for r in grouping.split_leakage(rows).collect():
        kind = {"A": "normalized_A", "B": "normalized_B", "any": "normalized_any_field", "pair": "normalized_pair"}[r["kind"]]
        leaks.setdefault(f"{r['left']}_{r['right']}", {}).update({f"{kind}_overlap_count": r["count"], f"{kind}_overlap_sample": r["sample"]})
    labels: dict[str, dict[str, int]] = {}
    for r in quality.label_distribution(rows, ["split"]).collect():
        labels.setdefault(r["split"], {})[r["label"]] = r["count"]
    sizes = rows.groupBy("split").agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("A", "B", "label")).alias("duplicates")).collect()
    report = {"rows": {r["split"]: r["rows"] for r in sizes}, "duplicate_rows": {r["split"]: r["duplicates"] for r in sizes}, "label_counts": labels, "leakage": leaks}
    shared = {k: v["normalized_any_field_overlap_count"] for k, v in leaks.items() if v["normalized_any_field_overlap_count"]}
    if shared and strict:
        raise DataValidationError("splits share normalized names: " + ", ".join(f"{k} {n}" for k, n in sorted(shared.items())))
    return splits, report


def check_training_pairs(rows: DataFrame) -> None:
    """Raises unless all names are there, all labels known, and only NO_MATCH rows synthetic."""
    known = F.coalesce(F.col("label").isin(*text.LABELS), F.lit(False))
    empty = (F.coalesce("norm_a", F.lit("")) == "") | (F.coalesce("norm_b", F.lit("")) == "")
    made_up = F.col("synthetic") & (F.col("label") != "NO_MATCH") if "synthetic" in rows.columns else F.lit(False)
    found = rows.agg(F.count_if(empty).alias("have an empty name"), F.count_if(~known).alias("have an unknown label"), F.count_if(made_up).alias("are synthetic but no NO_MATCH")).first()
    for what, n in found.asDict().items():
        if n:
            raise DataValidationError(f"{n} training pairs {what}")


def encoded_pairs(rows: DataFrame, tokens: list[str], config: MatcherConfig) -> DataFrame:
    """number (from 0), a, b (ids), label (number), weight of every pair, written.

    Numbers follow a hash of the pair, so they do not depend on the partitions.
    """
    named = rows if {"norm_a", "norm_b"} <= set(rows.columns) else text.with_normalized(rows, {"A": "norm_a", "B": "norm_b"})
    check_training_pairs(named)
    weight = F.when(F.col("synthetic"), F.lit(float(config.synthetic_negative_weight))).otherwise(F.lit(1.0)) if "synthetic" in named.columns else F.lit(1.0)
    number = F.create_map(*[F.lit(x) for kv in text.LABEL_NUMBERS.items() for x in kv])[F.col("label")]
    ids = {side: vocabulary.encode(F.col(f"norm_{side}"), tokens, config.max_length).cast("array<int>").alias(side) for side in ("a", "b")}
    order = F.xxhash64("norm_a", "norm_b", "label")
    table = settle(named.select(*ids.values(), number.alias("label"), weight.alias("weight"), order.alias("h"), "norm_a", "norm_b"))
    return settle(numbered(table, ["h", "norm_a", "norm_b", "label", "weight"], "number").select("number", "a", "b", "label", "weight"))


def train(spark: SparkSession, config: MatcherConfig, data_dir: str = "data_split", artifacts_dir: str = "artifacts", *, strict: bool = True, **explicit: str | None) -> Path:
    """Validates, augments, trains, saves and evaluates; gives the run's folder.

    The vocabulary comes from the training split alone. Only if that has no NO_MATCH are negatives
    made, for it alone. A failed check leaves no folder behind.
    """
    splits, report = validate(spark, data_dir, strict=strict, **explicit)
    own = splits["train"]
    names = own.select(F.col("norm_a").alias("name")).union(own.select("norm_b"))
    tokens = vocabulary.build_vocabulary(vocabulary.character_counts(names, "name"))
    asked = negatives.NegativeConfig(config.random_negatives_per_positive, config.hard_negatives_per_positive, config.hard_negative_pool_size, config.seed)
    rows, made = negatives.augmented(own, asked)
    rows = settle(rows)
    n_made = rows.filter("synthetic").count()
    if made and not n_made:
        raise DataValidationError("train has no NO_MATCH rows and no negative can be made of its targets")
    folder = run_directory(artifacts_dir)
    log = log_to(folder / "training.log")
    (folder / "data_validation.json").write_text(to_json(report), encoding="utf-8")
    log.info("rows: %s; characters: %d; negatives made: %d", report["rows"], len(tokens), n_made)
    for pair, found in report["leakage"].items():
        if found["normalized_any_field_overlap_count"]:
            log.warning("%s share %d normalized names", pair, found["normalized_any_field_overlap_count"])
    bundle, history = train_on(encoded_pairs(rows, tokens, config), encoded_pairs(splits["validation"], tokens, config), tokens, config)
    history["negatives"] = {r["negative_type"]: r["n"] for r in rows.filter("synthetic").groupBy("negative_type").agg(F.count("*").alias("n")).collect()}
    bundle.save(folder)
    (folder / "training_history.json").write_text(to_json(history), encoding="utf-8")
    bundle = ModelBundle.load(folder)  # what was saved is what is judged
    for split in ("validation", "test"):
        found = evaluate(bundle, splits[split])
        (folder / f"{split}_metrics.json").write_text(to_json(found), encoding="utf-8")
        log.info("%s accuracy %.4f", split, found["pair_classification"]["accuracy"])
    return folder
