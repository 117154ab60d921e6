"""Exact cosine top-k: balls of candidates that a query cannot gain from are left out, the others meet
it in blocks of a matrix product inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.shared import settle

#: Rows of either side that meet in one product: 256 x 4096 scores are held at once.
QUERY_STEP, CANDIDATE_STEP = 256, 4096
#: Rows of either side that a task gets; larger blocks repeat less of the other side in the shuffle.
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 32_768
#: Candidates of a ball on average, and most balls.
BALL_ROWS, BALLS = 8_192, 512
#: Decimals of a cosine beyond which only the order of a sum speaks; what bounds allow for rounding.
DECIMALS, SLACK = 12, 1e-9


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def in_balls(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (id, v) with ball, that of the nearest pivot, and angle, how far from it; a zero vector is as far as can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                near = unit @ pivots.T
                ball = near.argmax(axis=1)
                angle = np.where(unit.any(axis=1), _angle(near[np.arange(len(ball)), ball]), np.pi)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(angle)], names=["id", "v", "ball", "angle"])

    return rows.select("id", "v").mapInArrow(run, T.StructType([*rows.select("id", "v").schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def to_visit(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """id, v, least, ball: each query (id, v, ball, least) with each other ball that may hold a cosine of ``least``.

    A candidate of a ball is no nearer to the query than the pivot is, less the ball's radius.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, home, least = _unit(_matrix(batch.column(1))), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            reach = np.cos(np.maximum(_angle(unit @ pivots.T) - radius[None, :], 0))
            reach[~unit.any(axis=1)] = 1.0
            may = (reach >= least[:, None] - SLACK) & (radius >= 0)[None, :]
            may[np.arange(len(home)), home] = False
            row, ball = np.nonzero(may)
            own = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), pa.array(ball.astype(np.int32))], names=["id", "v", "least", "ball"])

    some = queries.select("id", "v", "ball", "least")
    return some.mapInArrow(run, T.StructType([*some.select("id", "v", "least").schema.fields, T.StructField("ball", T.IntegerType())]))


def _scored(q: DataFrame, c: DataFrame, top_k: int, skip_same_id: bool) -> DataFrame:
    """query_id, candidate_id, similarity: the best of each query in each task that it comes to.

    q: id, v, ball, least; c: id, v, ball. Both sides of a ball are cut into parts by a hash of the id,
    and each part of one meets each part of the other in a task.
    """
    spark = q.sparkSession
    counts = {side: {r["ball"]: r["count"] for r in df.groupBy("ball").count().collect()} for side, df in (("q", q), ("c", c))}  # a row a ball
    met = sorted(set(counts["q"]) & set(counts["c"]))
    plan = []
    for ball in met:
        n, c_parts = counts["q"][ball], -(-counts["c"][ball] // CANDIDATE_BLOCK)
        # as many parts as memory asks for, and enough to keep all cores busy on small inputs
        spread = -(-spark.sparkContext.defaultParallelism // (c_parts * len(met)))
        plan.append((ball, max(1, -(-n // QUERY_BLOCK), min(-(-n // QUERY_STEP), spread)), c_parts))
    plan = F.broadcast(spark.createDataFrame(plan, "ball int, q_parts int, c_parts int"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(plan, "ball").select("ball", "id", "v", "least", part("q_parts").alias("qb"), every("c_parts").alias("cb"))
    c = c.join(plan, "ball").select("ball", "id", "v", part("c_parts").alias("cb"), every("q_parts").alias("qb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": left["id"].iloc[:0].to_numpy(), "candidate_id": right["id"].iloc[:0].to_numpy(), "similarity": np.zeros(0)})]
        if len(left) and len(right):
            ids, cs = right["id"].to_numpy(), _unit(np.array(right["v"].tolist(), dtype=np.float64))
            order = np.argsort(ids, kind="stable")
            ids, cs = ids[order], cs[order]
            for at in range(0, len(left), QUERY_STEP):
                part = left.iloc[at : at + QUERY_STEP]
                own, unit = part["id"].to_numpy(), _unit(np.array(part["v"].tolist(), dtype=np.float64))
                level = part["least"].to_numpy() - SLACK
                row, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                for low in range(0, len(ids), CANDIDATE_STEP):
                    found = np.round(unit @ cs[low : low + CANDIDATE_STEP].T, DECIMALS)
                    if skip_same_id:
                        found[own[:, None] == ids[None, low : low + CANDIDATE_STEP]] = -np.inf
                    if found.shape[1] > top_k:
                        level = np.maximum(level, np.partition(found, -top_k, axis=1)[:, -top_k])
                    new, column = np.nonzero((found >= level[:, None]) & np.isfinite(found))
                    row, place, score = np.concatenate((row, new)), np.concatenate((place, column + low)), np.concatenate((score, found[new, column]))
                    order = np.lexsort((place, -score, row))
                    row, place, score = row[order], place[order], score[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    level[row[rank == top_k - 1]] = np.maximum(level[row[rank == top_k - 1]], score[rank == top_k - 1])
                    row, place, score = row[rank < top_k], place[rank < top_k], score[rank < top_k]
                out.append(pd.DataFrame({"query_id": own[row], "candidate_id": ids[place], "similarity": score}))
        return pd.concat(out)

    schema = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("candidate_id", c.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    return q.groupBy("ball", "qb", "cb").cogroup(c.groupBy("ball", "qb", "cb")).applyInPandas(best, schema)


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def cosine_top_k(
    queries: DataFrame, candidates: DataFrame, top_k: int, *, query_id: str, candidate_id: str, vector: str, skip_same_id: bool = False
) -> DataFrame:
    """The ``top_k`` candidates of largest cosine for each query, ties (to twelve decimals) to the smaller id.

    Returns query_id, candidate_id, similarity (double) and rank (from 1). Fewer candidates than
    ``top_k`` give all of them; a zero vector scores 0; rows with a null id or vector take no part.
    Vectors of different lengths raise before the search. query ids are taken to differ.

    Candidates are dealt to balls about some of them. A query first meets the ball of its nearest
    pivot, whose k-th cosine is what the rest has to reach; then it is sent only to balls that may hold
    as much by the triangle inequality of angles. No side is broadcast. Up to ``BALL_ROWS``
    candidates are one ball, and vectors without structure visit all balls.
    """
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive whole number")
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v")).dropna()
    c = candidates.select(F.col(candidate_id).alias("id"), F.col(vector).alias("v")).dropna()
    sizes = [df.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first() for df in (q, c)]
    lengths = {x for s in sizes for x in (s["low"], s["high"]) if x is not None}
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {min(lengths)} to {max(lengths)}")
    balls = min(BALLS, -(-sizes[1]["n"] // BALL_ROWS))
    anything = F.lit(float("-inf")).alias("least")
    if balls <= 1:
        one = F.lit(0).alias("ball")
        return _ranked(_scored(q.select("id", "v", one, anything), c.select("id", "v", one), top_k, skip_same_id), top_k)
    chosen = c.orderBy(F.xxhash64("id"), "id").limit(balls).select("v").toArrow().column("v").combine_chunks()
    pivots = _unit(_matrix(chosen))
    placed = settle(in_balls(c, pivots))
    radius = np.full(len(pivots), -1.0)  # of a ball without candidates
    for r in placed.groupBy("ball").agg(F.max("angle").alias("angle")).collect():
        radius[r["ball"]] = r["angle"]
    at_home = settle(in_balls(q, pivots))
    found = settle(_ranked(_scored(at_home.select("id", "v", "ball", anything), placed, top_k, skip_same_id), top_k))
    least = found.filter(F.col("rank") == top_k).select(F.col("query_id").alias("id"), F.col("similarity").alias("least"))
    asking = at_home.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    more = _scored(settle(to_visit(asking, pivots, radius)), placed, top_k, skip_same_id)
    return _ranked(found.drop("rank").unionByName(more), top_k)


#: Other names that callers know it by.
chunked_cosine_top_k = top_k_cosine_similarity = cosine_top_k
