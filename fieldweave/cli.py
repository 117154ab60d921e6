"""Command line: prepare, validate, train, evaluate, predict-pairs, match-groups."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from fieldweave.shared import release

def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m fieldweave.cli", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict]) -> None:
        own = sub.add_parser(name)
        for flag, how in arguments:
            own.add_argument(flag, **how)

    splits = [("--data-dir", {"default": "data_split"}), ("--train", {}), ("--validation", {}), ("--test", {}), ("--strict-leakage-check", {"action": argparse.BooleanOptionalAction, "default": True})]
    number, real = {"type": int}, {"type": float}
    command(
        "prepare", ("--input", {"default": "data.csv"}), ("--output-dir", {"default": "data_split"}), ("--train-ratio", real | {"default": 0.7}), ("--val-ratio", real | {"default": 0.15}), ("--test-ratio", real | {"default": 0.15}),
        ("--seed", number | {"default": 42}), ("--hard-positive-threshold", real | {"default": 0.4}), ("--hard-negative-threshold", real | {"default": 0.7}), ("--example-data", {"action": "store_true"}),
    )
    command("validate", *splits, ("--output", {}))
    command("train", ("--config", {"required": True}), ("--artifacts-dir", {"default": "artifacts"}), *splits)
    command(
        "evaluate", ("--model-dir", {"required": True}), ("--data-dir", {"default": "data_split"}), ("--split", {"choices": ("validation", "test"), "default": "test"}), ("--test", {}), ("--output", {}),
        ("--top-k", number), ("--retrieval-depth", number), ("--thresholds", real | {"nargs": "+", "default": [0.8, 0.9, 0.95, 0.99]}),
    )
    command("predict-pairs", ("--model-dir", {"required": True}), ("--a", {}), ("--b", {}), ("--input", {}), ("--output", {}))
    command(
        "match-groups", ("--model-dir", {"required": True}), ("--source", {"required": True}), ("--target", {"required": True}), ("--output", {"required": True}), ("--top-k", number),
        ("--threshold", real), ("--auto-accept-threshold", real), ("--save-candidates", {"action": "store_true"}), ("--candidates-output", {}),
    )
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    from fieldweave.config import MatcherConfig
    from fieldweave.operators.model import ModelBundle
    from fieldweave.plans import evaluate, predict, prepare, train
    from fieldweave.sources.pairs import read_labelled, split_path
    from fieldweave.sources.sinks import to_json, write_text

    say = lambda value: print(to_json(value), end="")
    if args.command == "prepare":
        report = prepare.prepare(
            spark, args.input, args.output_dir, ratios=(args.train_ratio, args.val_ratio, args.test_ratio), seed=args.seed,
            hard_positive=args.hard_positive_threshold, hard_negative=args.hard_negative_threshold, example_data=args.example_data,
        )
        say({"status": report["status"], "warnings": report["warnings"]})
        return 2 if report["status"] == "unusable" else 0
    if args.command in ("validate", "train"):
        paths = {s: getattr(args, s) for s in ("train", "validation", "test")}
        if args.command == "train":
            print(train.train(spark, MatcherConfig.load(args.config), args.data_dir, args.artifacts_dir, strict=args.strict_leakage_check, **paths))
            return 0
        report = train.validate(spark, args.data_dir, strict=args.strict_leakage_check, **paths)[1]
        say(report)
        if args.output:
            write_text(spark, args.output, to_json(report))
        return 0
    bundle = ModelBundle.load(args.model_dir)
    if args.command == "evaluate":
        rows = read_labelled(spark, split_path(args.data_dir, args.split, args.test), args.split)
        report = evaluate.evaluate(bundle, rows, top_k=args.top_k, depth=args.retrieval_depth, thresholds=args.thresholds)
        say(report)
        if args.output:
            write_text(spark, args.output, to_json(report))
    elif args.command == "predict-pairs":
        single = args.a is not None and args.b is not None
        if single == bool(args.input and args.output):
            raise ValueError("either --a and --b, or --input and --output")
        if single:
            say(predict.predict_pair(spark, bundle, args.a, args.b))
        else:
            predict.predict_pairs_csv(spark, bundle, args.input, args.output)
    else:
        beside = str(Path(args.output).with_name(Path(args.output).stem + "_candidates.csv")) if args.save_candidates else None
        predict.match_groups_csv(
            spark, bundle, args.source, args.target, args.output, candidates_output=args.candidates_output or beside, top_k=args.top_k, review=args.threshold, auto=args.auto_accept_threshold
        )
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fieldweave").getOrCreate()
    try:
        return run(spark, args)
    except (OSError, ValueError, RuntimeError, PySparkException) as failed:
        print(f"{args.command} failed: {str(failed)[:1000]}", file=sys.stderr)
        return 2
    finally:
        release(spark)  # what the run has settled; its results are written


if __name__ == "__main__":
    sys.exit(main())
