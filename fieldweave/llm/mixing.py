"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a water-filling window over the (few) sources gives each its target
and repetition rate, and each document is repeated floor(rate) times plus one copy drawn by a hash
of its id with the fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.split import free
from fieldweave.shared import settle, small

#: At most so many sources are broadcast with their rates; beyond, the rates are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5("seed:key"); a null key reads as ''."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_plan(sizes: DataFrame, max_rate: int = 3, weights: int = 3) -> DataFrame:
    """source, source_size, target of each source; ``sizes`` has source and size.

    Sources in code-point order (null last) weigh 1..``weights``, repeating. Targets share the sum of
    all sizes by weight; one that would exceed ``max_rate`` times its source's size stops there, and
    the excess is reshared by weight. No rows: no sources. Size 0: target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    cap = (F.col("source_size") * max_rate).alias("cap")
    ranked = ranked.withColumn("cap", cap)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # in order of cap / weight the sources that stop at their cap come first
    stops = F.col("cap") * F.col("weights_left") <= F.col("weight") * F.col("size_left")
    left = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("size_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights_left"),
    ).withColumn("stops", stops)
    shared = left.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0))).alias("rest"),
        F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything).alias("rest_weight"),
    )
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("rest").cast("double") / F.col("rest_weight").cast("double")
    )
    return shared.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, size: Column, *, seed: int = 17, max_rate: int = 3, weights: int = 3, names: tuple[str, str, str, str] = ("__size", "__source_size", "__target", "__copies")) -> DataFrame:
    """``docs`` with ``names``: its size, its source's size and target, and how often the mix takes it.

    Rows that repeat a doc_id are drawn alike. A null source is a source of its own, a null doc_id
    draws as '', a null size counts 0; texts of any length are one size each. Columns of the given
    names are replaced, all others pass through. No rows: no rows. The documents are never shuffled,
    unless there are more sources than are broadcast.
    """
    sizes = docs.select("source", F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    own, source_size, target, copies = names
    source = free("__source", [*docs.columns, *names])
    plan = settle(source_plan(sizes, max_rate, weights)).select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target))
    if plan.count() <= BROADCAST_SOURCES:
        plan = small(plan)
    replaced = {n.lower() for n in names}
    docs = docs.withColumn(own, F.coalesce(size, F.lit(0)).cast("long")).select(*[c for c in docs.columns if c.lower() not in replaced], own)
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col(source)), "left").drop(source)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (uniform(seed, F.col("doc_id")) < rate - whole).cast("long")
    return joined.withColumn(copies, (whole + extra).cast("long"))


def mix(docs: DataFrame, size: Column | None = None, *, seed: int = 17, max_rate: int = 3, weights: int = 3) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged, whatever their names.

    Nulls, ties, repeated and missing rows as in ``with_copies``.
    """
    names = tuple(free(n, docs.columns) for n in ("__size", "__source_size", "__target", "__copies"))
    copy = free("__copy", docs.columns)
    taken = with_copies(docs, word_count(F.col("text")) if size is None else size, seed=seed, max_rate=max_rate, weights=weights, names=names)
    turns = F.when(F.col(names[3]) > 0, F.sequence(F.lit(1).cast("long"), F.col(names[3])))
    return taken.withColumn(copy, F.explode(turns)).select(*docs.columns)
