"""Predictions for single pairs and for files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.operators import matching
from fieldweave.operators.model import ModelBundle
from fieldweave.sources.pairs import read_fields
from fieldweave.sources.sinks import write_csv


def as_bundle(model: ModelBundle | str) -> ModelBundle:
    """A loaded model, or the one of a folder."""
    return model if isinstance(model, ModelBundle) else ModelBundle.load(model)


def predict_pair(spark: SparkSession, model: ModelBundle | str, a: str, b: str) -> dict[str, Any]:
    return matching.predict_pairs(as_bundle(model), spark.createDataFrame([(a, b)], "A string, B string")).first().asDict()


def predict_pairs_csv(spark: SparkSession, model: ModelBundle | str, source: str, target: str) -> DataFrame:
    """Scores the A, B rows of a file into another, in the order of the file."""
    found = matching.predict_pairs(as_bundle(model), read_fields(spark, source, ("A", "B"))).orderBy("source_row").drop("source_row")
    write_csv(found, target)
    return found


def match_groups_csv(spark: SparkSession, model: ModelBundle | str, source: str, target: str, output: str, *, candidates_output: str | None = None, **how: Any) -> DataFrame:
    """Matches the A of one file with the B of another; writes a row per A, and the candidates if asked."""
    results, candidates = matching.match_groups(as_bundle(model), read_fields(spark, source, ("A",)), read_fields(spark, target, ("B",)), **how)
    write_csv(results.orderBy("source_row").drop("source_row"), output)
    if candidates_output:
        write_csv(candidates.orderBy("source_row", F.col("retrieval_rank")).drop("source_row"), candidates_output)
    return results
