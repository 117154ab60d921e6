"""Connected groups of names, their figures, and splits that cut no group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import text
from fieldweave.operators.components import components
from fieldweave.shared import numbered, settle, small

SPLITS = ("train", "validation", "test")


def with_components(clean: DataFrame) -> DataFrame:
    """``clean`` with component_id: pairs linked through common normalized names, numbered from 0 in
    the order in which their first rows stand in the file."""
    clean = settle(clean)
    roots = components(clean.select(F.col("norm_a").alias("u"), F.col("norm_b").alias("v")))
    # broadcast where few enough, so that rows of a giant component, or of a hub, do not meet in one task
    rows = settle(clean.join(small(settle(roots.withColumnRenamed("node", "norm_a"))), "norm_a"))
    firsts = settle(rows.groupBy("root").agg(F.min("source_row").alias("first_row")))
    ids = settle(numbered(firsts, ["first_row"], "component_id").select("root", "component_id"))
    return rows.join(small(ids), "root").drop("root")


def component_table(rows: DataFrame) -> DataFrame:
    """component_id, rows, fields (how many), the first ten fields and a count for each label."""
    names = rows.select("component_id", F.explode(F.array("norm_a", "norm_b")).alias("field")).distinct()
    # ten a component are kept by a window limit before the shuffle, so no set of all fields is built
    ranked = names.withColumn("n", F.row_number().over(Window.partitionBy("component_id").orderBy("field"))).filter(F.col("n") <= 10)
    sample = ranked.groupBy("component_id").agg(F.array_sort(F.collect_list("field")).alias("sample_fields"))
    counts = rows.groupBy("component_id").agg(F.count("*").alias("rows"), *[F.count_if(F.col("label") == x).alias(x) for x in text.LABELS])
    return counts.join(names.groupBy("component_id").agg(F.count("*").alias("fields")), "component_id").join(sample, "component_id")


def component_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("rows").agg(F.count("*").alias("components")).orderBy("rows")


def component_summary(table: DataFrame) -> DataFrame:
    """One row: count, least, median, most rows and the largest one's share of all rows."""
    return table.agg(
        F.count("*").alias("count"), F.coalesce(F.min("rows"), F.lit(0)).alias("min_rows"), F.coalesce(F.median("rows"), F.lit(0.0)).alias("median_rows"),
        F.coalesce(F.max("rows"), F.lit(0)).alias("max_rows"), F.coalesce(F.max("rows") / F.sum("rows"), F.lit(0.0)).alias("largest_ratio"),
    )


def largest_components(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.col("rows").desc(), "component_id").limit(n)


#: Components of at least one in so many of all rows are placed one by one.
HEAD = 1000


def place_large(parts: list[tuple[int, ...]], totals: Sequence[int], ratios: Sequence[float]) -> tuple[dict[int, int], list[list[float]]]:
    """Split of each large component (id, count of each label), in the given order; and the needs left.

    A split needs its ratio of each label's rows. A component goes where the needs, as shares of the
    label's rows, are largest for what it brings (the dot product of the two vectors); equal ones to
    the split of fewer components, then to the larger ratio.
    """
    need = [[r * n for n in totals] for r in ratios]
    members = [0] * len(ratios)
    active = [i for i, r in enumerate(ratios) if r > 0]
    placed = {}
    for name, *brings in parts:
        drawn = [sum(b * x / max(n, 1) for b, x, n in zip(brings, need[i], totals, strict=True)) for i in range(len(ratios))]
        best = max(active, key=lambda i: (round(drawn[i], 9), -members[i], ratios[i]))
        placed[name] = best
        members[best] += 1
        need[best] = [x - b for x, b in zip(need[best], brings, strict=True)]
    # a split that got none takes the last (smallest) component of the split that has most
    for i in active:
        giver = max(active, key=lambda g: members[g])
        if not members[i] and members[giver] > 1:
            name, *brings = next(p for p in reversed(parts) if placed[p[0]] == giver)
            placed[name] = i
            members[giver] -= 1
            members[i] += 1
            need[giver] = [x + b for x, b in zip(need[giver], brings, strict=True)]
            need[i] = [x - b for x, b in zip(need[i], brings, strict=True)]
    return placed, need


#: Kinds of components (rows of each label, split) that the improving pass looks at: those of most components; its most steps.
KINDS, STEPS, PARTNERS = 20_000, 500, 60


def improving_moves(kinds: np.ndarray, count: np.ndarray, ratios: Sequence[float]) -> list[tuple[int, int, int, int]]:
    """Moves (kind, from split, to split, how many components) that bring splits nearer to their shares.

    kinds: a row for each kind, its rows of each label; count: how many components of it each split
    has. What counts are the squared deviations of the splits' shares of all rows, and those of their
    shares of each label's rows, summed over the splits: no step raises any of them. Each step takes the best move of several
    components of one kind, else the best swap of two components, while their sum falls; no split
    gives its last component.
    """
    each = np.concatenate((kinds, kinds.sum(axis=1, keepdims=True)), axis=1).astype(np.float64)
    count, ratios = count.astype(np.int64).copy(), np.asarray(ratios, dtype=np.float64)
    held = count.T @ each
    weight = 1 / np.maximum(held.sum(axis=0), 1) ** 2
    weights = np.diag(weight)  # a column for each label, one for all rows
    off = held - ratios[:, None] * held.sum(axis=0)[None, :]
    active = [s for s in range(len(ratios)) if ratios[s] > 0]
    pairs = [(a, b) for a in active for b in active if a != b]
    cost = (each * each) @ weights
    moves: dict[tuple[int, int, int], int] = {}

    def move(kind: int, a: int, b: int, n: int) -> None:
        moves[kind, a, b] = moves.get((kind, a, b), 0) + n
        count[kind, a] -= n
        count[kind, b] += n
        off[a] -= n * each[kind]
        off[b] += n * each[kind]

    for _ in range(STEPS if len(each) else 0):
        best: tuple[float, list[tuple[int, int, int, int]]] = (1e-10, [])
        for a, b in pairs:
            # n components less here, more there: the sums fall by 2 n (pull - n cost)
            pull = each @ (weights * (off[a] - off[b])[:, None])
            most = np.minimum(count[:, a], count[:, a].sum() - 1)
            allowed = np.floor((pull / np.maximum(cost, 1e-300)).min(axis=1, where=cost > 0, initial=np.inf) + 1e-9)
            n = np.minimum(np.maximum(np.floor(pull.sum(axis=1) / np.maximum(2 * cost.sum(axis=1), 1e-300)), 1), np.maximum(most, 1))
            n = np.where(n > allowed, allowed, n)
            gain = np.where((most > 0) & (n >= 1), 2 * n * (pull.sum(axis=1) - n * cost.sum(axis=1)), -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = float(gain[k]), [(k, a, b, int(n[k]))]
        if not best[1]:
            for a, b in pairs:
                if a > b:
                    continue
                pull = (each @ (weights * (off[a] - off[b])[:, None])).sum(axis=1)
                give, take = (np.flatnonzero(count[:, s] > 0) for s in (a, b))
                give, take = give[np.argsort(-pull[give], kind="stable")], take[np.argsort(pull[take], kind="stable")]
                give, take = (np.unique(np.concatenate((x[: PARTNERS // 2], x[-PARTNERS // 2 :]))) for x in (give, take))
                v = each[give][:, None, :] - each[take][None, :, :]
                gains = 2 * (v @ (weights * (off[a] - off[b])[:, None]) - (v * v) @ weights)
                gain = np.where((gains >= -1e-15).all(axis=2), gains.sum(axis=2), -np.inf)
                if gain.size and gain.max() > best[0]:
                    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = float(gain.max()), [(int(give[i]), a, b, 1), (int(take[j]), b, a, 1)]
        if not best[1]:
            break
        for step in best[1]:
            move(*step)
    # a component that went there and back, or on, is one move
    for (kind, a, b), n in list(moves.items()):
        back = min(n, moves.get((kind, b, a), 0)) if a < b else 0
        if back:
            moves[kind, a, b] -= back
            moves[kind, b, a] -= back
    return [(*key, n) for key, n in sorted(moves.items()) if n]


def improved(placed: DataFrame, ratios: Sequence[float], seed: int) -> DataFrame:
    """``placed`` (component_id, split, rows of each label, __tie) with splits after the improving pass.

    Kinds and their counts come to the driver, ``KINDS`` at most; which components of a kind move is
    told by their hash, in the tasks.
    """
    spark, labels = placed.sparkSession, list(text.LABELS)
    kinds = placed.groupBy(*labels).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in kinds.orderBy(F.col("n").desc(), *labels).limit(KINDS).drop("n").collect())
    table = np.array(rows, dtype=np.int64).reshape(len(rows), len(labels) + len(SPLITS))
    moves = improving_moves(table[:, : len(labels)], table[:, len(labels) :], ratios)
    if not moves:
        return placed
    # a kind may give to several splits: its components, by hash, in that order
    plan: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for kind, a, b, n in moves:
        plan.setdefault((kind, a), []).append((b, n))
    told = []
    for (kind, a), gifts in plan.items():
        low = 0
        for b, n in gifts:
            told.append((*map(int, table[kind, : len(labels)]), SPLITS[a], SPLITS[b], low, low + n))
            low += n
    schema = ", ".join(f"`{x}` long" for x in labels) + ", split string, goes string, low long, high long"
    gives = F.broadcast(spark.createDataFrame(told, schema))
    order = Window.partitionBy(*labels, "split").orderBy(F.xxhash64(F.lit(seed), F.lit("move"), "__tie"), "component_id")
    most = max(x[-1] for x in told)
    ranked = placed.join(F.broadcast(spark.createDataFrame(sorted({x[: len(labels) + 1] for x in told}), ", ".join(schema.split(", ")[: len(labels) + 1]))), [*labels, "split"])
    ranked = ranked.withColumn("__n", F.row_number().over(order) - 1).filter(F.col("__n") < most)
    moved = ranked.join(gives, [*labels, "split"]).filter((F.col("__n") >= F.col("low")) & (F.col("__n") < F.col("high"))).select("component_id", "goes")
    moved = small(settle(moved))
    return placed.join(moved, "component_id", "left").withColumn("split", F.coalesce("goes", "split")).drop("goes")


def split_rows(rows: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``rows`` (with component_id) with split: train, validation or test, whole components each.

    Large components (a thousandth of all rows or more, and the three largest in any case) are placed
    one by one, largest first (ties by a seeded hash); there are a thousand and three at most. All
    others are ordered by their labels and size, then by the hash, and dealt in that order by a
    sequence that fills any stretch evenly (multiples of the golden ratio), in the shares that the
    large ones have left; so components of one kind reach each split in its share. Then an improving
    pass moves and swaps components while splits come nearer to their shares of all rows and of each
    label. Each split of a positive ratio gets a component if there are as many. The same seed gives
    the same splits.
    """
    spark = rows.sparkSession
    counts = [F.count_if(F.col("label") == x).alias(x) for x in text.LABELS]
    table = settle(rows.groupBy("component_id").agg(F.count("*").alias("rows"), *counts).withColumn("__tie", F.xxhash64(F.lit(seed), "component_id")))
    total, *by_label = table.agg(F.coalesce(F.sum("rows"), F.lit(0)), *[F.coalesce(F.sum(x), F.lit(0)) for x in text.LABELS]).first()
    largest_first = [F.col("rows").desc(), "__tie", "component_id"]
    head = table.filter(F.col("rows") * HEAD >= total).union(table.orderBy(*largest_first).limit(len(SPLITS))).distinct()
    head = [(r["component_id"], *(r[x] for x in text.LABELS)) for r in head.orderBy(*largest_first).collect()]
    placed, need = place_large(head, by_label, ratios)
    chosen = spark.createDataFrame([(c, SPLITS[i]) for c, i in placed.items()], "component_id long, split string")
    left = [max(0.0, sum(n)) if r > 0 else 0.0 for n, r in zip(need, ratios, strict=True)]
    tail = settle(table.join(F.broadcast(chosen), "component_id", "left_anti"))
    dealt = numbered(tail, [*text.LABELS, "rows", "__tie", "component_id"], "__place")
    golden = (5**0.5 - 1) / 2
    at = F.pmod(F.col("__place") * F.lit(golden), F.lit(1.0))
    cuts = [sum(left[: i + 1]) / sum(left) if sum(left) else sum(ratios[: i + 1]) for i in range(len(SPLITS) - 1)]
    split = F.when(at < cuts[0], SPLITS[0]).when(at < cuts[1], SPLITS[1]).otherwise(SPLITS[2])
    kept = ["component_id", *text.LABELS, "__tie"]
    first = settle(table.join(F.broadcast(chosen), "component_id").select(*kept, "split").unionByName(dealt.select(*kept, split.alias("split"))))
    return rows.join(small(settle(improved(first, ratios, seed).select("component_id", "split"))), "component_id")


def shared_values(values: DataFrame, most: int = 20) -> DataFrame:
    """kind, left, right, count, sample: for each kind and pair of splits how many values (kind,
    split, value) both have, and the first of them. Kinds without any value do not appear."""
    per = values.groupBy("kind", "value").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    pairs = (("train", "test"), ("train", "validation"), ("validation", "test"))
    told = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), ((F.col(a) == 1) & (F.col(b) == 1)).alias("both")) for a, b in pairs])).alias("p")
    cells = per.select("kind", "value", told).select("kind", "value", "p.left", "p.right", "p.both")
    # the window's limit is applied before the shuffle too; one row a kind and pair keeps empty ones
    ranked = cells.withColumn("n", F.row_number().over(Window.partitionBy("kind", "left", "right").orderBy(F.col("both").desc(), "value"))).filter(F.col("n") <= most)
    sample = ranked.groupBy("kind", "left", "right").agg(F.array_sort(F.collect_list(F.when(F.col("both"), F.col("value")))).alias("sample"))
    counts = cells.groupBy("kind", "left", "right").agg(F.count_if("both").alias("count"))
    return counts.join(sample, ["kind", "left", "right"]).select("kind", "left", "right", "count", "sample")


def leakage(rows: DataFrame) -> DataFrame:
    """left, right, count and the first twenty of the normalized names that two splits share."""
    values = rows.select(F.lit("any").alias("kind"), "split", F.explode(F.array("norm_a", "norm_b")).alias("value"))
    return shared_values(values).drop("kind")


def split_leakage(rows: DataFrame) -> DataFrame:
    """kind (A, B, any, pair), left, right, count, sample of what the splits share, in one shuffle."""
    pair = F.concat_ws(" -> ", "norm_a", "norm_b")
    each = [("A", F.col("norm_a")), ("B", F.col("norm_b")), ("any", F.col("norm_a")), ("any", F.col("norm_b")), ("pair", pair)]
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in each])).alias("x")
    return shared_values(settle(rows.select("split", told).select("split", "x.kind", "x.value").distinct()))


def split_summary(rows: DataFrame) -> DataFrame:
    """split, rows, components and normalized fields of each split that has rows."""
    fields = rows.select("split", F.explode(F.array("norm_a", "norm_b")).alias("field")).groupBy("split").agg(F.count_distinct("field").alias("normalized_field_count"))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("component_id").alias("components")).join(fields, "split")


def hard_cases(rows: DataFrame, positive: float = 0.4, negative: float = 0.7) -> DataFrame:
    """Rows of ``rows`` that spelling makes hard, with similarity and reasons; labels are not changed."""
    pairs = rows.withColumn("raw_similarity", text.sequence_ratio("norm_a", "norm_b"))
    s, matched = F.col("raw_similarity"), F.col("label") != "NO_MATCH"
    variant = (F.col("norm_a") == F.col("norm_b")) & (F.col("A") != F.col("B"))
    reasons = F.array_compact(F.array(
        F.when(matched & (s < positive), "hard_positive"),
        F.when(~matched & (s > negative), "hard_negative"),
        F.when(variant, "format_variant").when(matched & (s > negative), "near_spelling_variant"),
        F.when(text.possible_abbreviation(F.col("norm_a"), F.col("norm_b")), "possible_abbreviation"),
    ))
    told = pairs.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return told.select("A", "B", "label", "source_row", text.rounded("raw_similarity").alias("similarity"), F.array_join("reasons", ";").alias("reasons"))
