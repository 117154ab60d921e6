"""Synthetic negatives for training: pairs of a positive's source with targets that are not known to match."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import text
from fieldweave.functions.similarity import most_similar
from fieldweave.shared import numbered, settle


@dataclass(frozen=True)
class NegativeConfig:
    """How many negatives each positive gets, and how many targets are compared for the hard ones."""

    random_per_positive: int = 1
    hard_per_positive: int = 1
    pool: int = 100
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("random_per_positive", "hard_per_positive", "pool", "seed"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < (name == "pool"):
                raise ValueError(f"{name} must be a whole number that is not negative (pool: positive)")


def contains_no_match(rows: DataFrame) -> bool:
    """Whether a row is labelled NO_MATCH; stops at the first."""
    return bool(rows.filter(text.label(F.col("label")) == "NO_MATCH").limit(1).count())


def target_classes(rows: DataFrame) -> DataFrame:
    """target (normalized B), spelling (of its first row) and number (1 ..) of every distinct target.

    Numbers follow a hash of the target, so that targets alike in spelling do not stand together.
    """
    first = rows.filter(F.col("norm_b") != "").groupBy(F.col("norm_b").alias("target")).agg(F.min_by("B", "source_row").alias("spelling"))
    shuffled = settle(first.withColumn("place", F.xxhash64(F.lit("place"), "target")))
    return numbered(shuffled, ["place", "target"], "at").select("target", "spelling", (F.col("at") + 1).alias("number"))


def eligible_targets(rows: DataFrame, config: NegativeConfig) -> DataFrame:
    """source_row, A, norm_a, candidate, spelling, draw: a seeded sample of each positive's eligible targets.

    Eligible is every target but the source's own known positives and the source's own name. Each
    positive draws numbers of targets by hashes, independently of all others, and leaves out repeats
    and excluded ones, so any set of eligible targets is as likely as any other of its size. Only
    drawn numbers are joined, so positives never meet all targets. Where that leaves a sample short,
    it is drawn again with more numbers. The sample holds pool + random_per_positive targets; fewer
    only where fewer are eligible.
    """
    targets = settle(target_classes(rows))
    count = targets.count()
    wanted = config.pool + config.random_per_positive
    positives = rows.filter(F.col("label").isin(*text.POSITIVE))
    known = positives.select("norm_a", F.col("norm_b").alias("target")).distinct()
    excluded = known.groupBy("norm_a").agg(F.count("*").alias("n"))
    asked = positives.select("source_row", "A", "norm_a").join(excluded, "norm_a")
    total = F.lit(max(count, 1)).cast("long")
    # so many different numbers fill the sample whatever they are; 1 for the source's own name
    enough = F.least(total, F.lit(wanted).cast("long") + F.col("n") + 1)
    asked = settle(asked.select("source_row", "A", "norm_a", "n", enough.alias("enough")))

    def sampled(asked: DataFrame, draws: Column) -> DataFrame:
        h = lambda i: F.xxhash64(F.lit(config.seed), "source_row", "norm_a", i)
        # where most numbers are needed, all of them in the order of their hashes
        every = F.transform(F.array_sort(F.transform(F.sequence(F.lit(1).cast("long"), total), lambda i: F.struct(h(i).alias("h"), i.alias("i")))), lambda x: x["i"])
        some = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("long"), draws), lambda i: F.pmod(h(i), total) + 1))
        numbers = F.when(total <= 2 * F.col("enough"), every).otherwise(some)
        met = asked.select("source_row", "A", "norm_a", F.posexplode(numbers).alias("draw", "number"))
        met = met.join(targets, "number").join(known.withColumn("known", F.lit(True)), ["norm_a", "target"], "left")
        met = met.filter(F.col("known").isNull() & (F.col("target") != F.col("norm_a")))
        order = Window.partitionBy("source_row").orderBy("draw")
        kept = met.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= wanted)
        return settle(kept.select("source_row", "A", "norm_a", F.col("target").alias("candidate"), "spelling", "draw"))

    # what fills the sample on average, and some; then more and more for those that are short
    drawn = F.ceil(1.2 * wanted * total / F.greatest(total - F.col("n"), F.lit(1))) + 20
    sample, left = None, asked
    for often in (None, 4, 16, 64):
        draws = F.least(drawn, 4 * F.col("enough")) if often is None else F.col("enough") * often
        own = sampled(left, draws.cast("long"))
        # a sample that all numbers were drawn for is as full as it can be
        full = own.filter(F.col("draw") == wanted).select("source_row").unionByName(left.filter(total <= 2 * F.col("enough")).select("source_row")).distinct()
        left = settle(left.join(full, "source_row", "left_anti"))
        done = left.isEmpty()
        own = own if done else own.join(left.select("source_row"), "source_row", "left_anti")
        sample = own if sample is None else sample.unionByName(own)
        if done:
            return sample
    raise RuntimeError("samples stay short after 64 draws for each target that is needed")


def hardest(sample: DataFrame, k: int) -> DataFrame:
    """``sample`` (source_row, norm_a, candidate, ..) with ratio and place, the k of each source_row
    that are most alike in spelling (ties: code-point order).

    A source_row's candidates meet in one task, some hundreds at most. Ratios are found only while
    what the characters of the next candidate allow reaches the k-th best ratio.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, (None,)):
            if batch is None:
                table, rest = rest, None
            else:
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                last = table.column("source_row").to_numpy()
                cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if len(last) and (last != last[-1]).any() else 0
                table, rest = table.slice(0, cut), table.slice(cut)
            if table is None or not len(table):
                continue
            row = table.column("source_row").to_numpy()
            group = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))
            best, ratio, _ = most_similar(group, table.column("norm_a").to_pylist(), table.column("candidate").to_pylist(), k, autojunk=True)
            place = np.arange(len(best)) - np.searchsorted(group[best], group[best]) + 1
            out = table.take(pa.array(best)).append_column("ratio", pa.array(ratio)).append_column("place", pa.array(place.astype(np.int32)))
            yield from out.to_batches()

    schema = T.StructType([*sample.schema.fields, T.StructField("ratio", T.DoubleType()), T.StructField("place", T.IntegerType())])
    return sample.repartition("source_row").sortWithinPartitions("source_row", "draw").mapInArrow(run, schema)


def synthetic_negatives(rows: DataFrame, config: NegativeConfig = NegativeConfig()) -> DataFrame:
    """A, B, label NO_MATCH, synthetic true, negative_type hard or random, source_row of the positive, ordinal.

    rows: A, B, label, source_row, norm_a, norm_b. Hard ones are the pool's most similar by spelling
    (ties: code-point order), random ones come from the rest of the sample, or from all of it where
    nothing else is left; both repeat from the start when there are too few. The same seed gives the
    same rows. A positive without an eligible target gives none.
    """
    sample = settle(eligible_targets(rows, config))
    by_row = Window.partitionBy("source_row")
    best = settle(hardest(sample.filter(F.col("draw") <= config.pool), max(config.hard_per_positive, 1)))
    hard = _cycled(best, config.hard_per_positive).withColumn("negative_type", F.lit("hard"))
    taken = hard.select("source_row", "candidate").distinct().withColumn("taken", F.lit(1))
    rest = sample.join(taken, ["source_row", "candidate"], "left")
    rest = rest.withColumn("some_left", F.max(F.col("taken").isNull()).over(by_row)).filter(F.col("taken").isNull() | ~F.col("some_left"))
    rest = rest.withColumn("place", F.row_number().over(by_row.orderBy(F.xxhash64(F.lit(config.seed + 1), "source_row", "candidate"), "candidate")))
    other = _cycled(rest, config.random_per_positive).withColumn("negative_type", F.lit("random"))
    columns = ["A", F.col("spelling").alias("B"), F.lit("NO_MATCH").alias("label"), F.lit(True).alias("synthetic"), "negative_type", "source_row", "ordinal"]
    return hard.select(*columns).unionByName(other.select(*columns))


def _cycled(ranked: DataFrame, n: int) -> DataFrame:
    """The first n of each source_row by place, from the start again when they run out; with ordinal."""
    have = ranked.filter(F.col("place") <= max(n, 1)).withColumn("have", F.count("*").over(Window.partitionBy("source_row")))
    if not n:
        return have.limit(0).withColumn("ordinal", F.lit(1))
    # a row at place p also serves p + have, p + 2 have, ...
    return have.withColumn("ordinal", F.explode(F.expr(f"CASE WHEN place <= {n} THEN sequence(CAST(place AS INT), {n}, CAST(have AS INT)) END")))


def augmented(rows: DataFrame, config: NegativeConfig = NegativeConfig()) -> tuple[DataFrame, bool]:
    """``rows`` as they are if they hold a NO_MATCH, else with synthetic negatives; and whether so.

    Both get synthetic and negative_type ("human" for rows of the input).
    """
    own = rows.select("A", "B", "label").withColumns({"synthetic": F.lit(False), "negative_type": F.lit("human")})
    if contains_no_match(rows):
        return own, False
    return own.unionByName(synthetic_negatives(rows, config).select(*own.columns)), True
