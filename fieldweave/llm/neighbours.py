"""Nearest neighbours by several shifted Hilbert orderings.

1. Each ordering projects the vectors on some random directions, cuts each projection into cells at
   shifted quantiles and numbers the cells along a Hilbert curve. Only ids and keys are sorted, by
   ranges; a row's place in its ordering follows from the sizes of the ranges before its own.
2. Places are cut into ranges of equal size; each range also gets the rows just outside its edges, so
   no window is cut there. With the vectors joined, a query meets the rows whose places are near its
   own, by blocks of a matrix product, and keeps the best.
3. What all orderings have found is merged and ranked by the exact scores.
4. A sample of the queries is searched in all rows. As long as the windows have found less than the
   wanted share of what that gives, further orderings are added, so their number follows from the data:
   few for vectors in clusters, more and more for many vectors without structure.

The work grows with the rows times the orderings. ``widen`` adds an exact search for small tables:
blocks of the first ordering whose centre and radius cannot rule out a better neighbour are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.hilbert import hilbert_keys
from fieldweave.llm.jaccard_join import by_group
from fieldweave.llm.split import cuts_below
from fieldweave.shared import numbered, settle

#: Orderings of each round (the last is repeated); dimensions of a projection; bits of a key; places on either side in a window.
ORDERINGS, DIMENSIONS, BITS, HALF_WINDOW = (24, 16, 24, 40, 60, 100), 20, 60, 512
#: Recall that ends the rounds; queries that it is measured on; most rounds.
WANTED, MEASURED, ROUNDS = 0.95, 256, 12
#: Rows that fit the cells of the projections; rows of a range, a block and a block of queries.
SAMPLE, RANGE_ROWS, BLOCK, QUERY_BLOCK = 5_000, 20_000, 16_384, 4_096
#: Scores of a matrix product that are nearer than this are told apart by the exact ones.
NEAR = 1e-9


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with that of b, added up in the order of the components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


FOUND = "query_id long, vec_id long, score double"


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, allowed: np.ndarray) -> pd.DataFrame:
    """The k best of v for each q among the allowed (a mask), other ids only, by the exact scores."""
    s = q @ v.T
    s[~allowed | (q_ids[:, None] == ids[None, :])] = -np.inf
    level = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(q), -np.inf)
    rows, columns = np.nonzero((s >= level[:, None] - NEAR) & np.isfinite(s))
    score = exact(q[rows], v[columns])
    order = np.lexsort((ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return pd.DataFrame({"query_id": q_ids[rows[kept]], "vec_id": ids[columns[kept]], "score": score[kept]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _curves(sample: np.ndarray, seed: int, numbers: range) -> list[tuple[np.ndarray, list[np.ndarray], int]]:
    """For the ordering of each number: directions (orthonormal), ascending cuts of each projection, bits of a cell."""
    m = min(DIMENSIONS, sample.shape[1])
    bits = min(8, BITS // m)
    out = []
    for c in numbers:
        directions = np.linalg.qr(np.random.default_rng([seed, c]).normal(size=(sample.shape[1], m)))[0]
        levels = (np.arange(1, 2**bits) - 0.5 + c * 0.618033988749895 % 1) / 2**bits  # the shift: up to a cell between orderings
        out.append((directions, list(np.quantile(sample @ directions, levels, axis=0).T), bits))
    return out


def _keys(v: np.ndarray, curve: tuple[np.ndarray, list[np.ndarray], int]) -> np.ndarray:
    directions, cuts, bits = curve
    p = v @ directions
    cells = np.stack([np.searchsorted(c, p[:, d], side="right") for d, c in enumerate(cuts)], axis=1)
    return hilbert_keys(cells, bits)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length, without nulls, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _windows(vectors: DataFrame, curves: list, k: int, half: int) -> DataFrame:
    """The best of each query within its windows."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(2))
                for c, curve in enumerate(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(_keys(v, curve)), *batch.columns[:2]], names=["curve", "place", "id", "is_query"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 1):
            curve, ids = table.column("curve").to_numpy(), table.column("id").to_numpy()
            at = np.flatnonzero(table.column("own").to_numpy() & table.column("is_query").to_numpy())
            if not len(at):
                continue
            v = _matrix(table.column("v"))
            start = 0
            while start < len(at):
                # queries whose windows overlap meet one stretch of rows
                end = min(start + 128, int(np.searchsorted(at, at[start] + 4 * half, side="right")))
                own = at[start:end]
                low, high = max(0, own[0] - half), min(len(ids), own[-1] + half + 1)
                allowed = (np.abs(np.arange(low, high)[None, :] - own[:, None]) <= half) & (curve[low:high][None, :] == curve[own][:, None])
                yield pa.RecordBatch.from_pandas(_best(ids[own], v[own], ids[low:high], v[low:high], k, allowed), preserve_index=False)
                start = end

    keys = settle(vectors.select("id", "is_query", "v").mapInArrow(keyed, "curve int, place long, id long, is_query boolean"))
    placed = numbered(keys, ["curve", "place", "id"], "at")
    size = max(RANGE_ROWS, half)
    own, inside = F.floor(F.col("at") / size), F.col("at") % size
    to = lambda n, own: F.struct(n.cast("long").alias("range"), F.lit(own).alias("own"))
    ranges = F.array_compact(F.array(to(own, True), F.when(inside < half, to(own - 1, False)), F.when(inside >= size - half, to(own + 1, False))))
    dealt = placed.select("curve", "at", "id", "is_query", F.explode(ranges).alias("to")).select("to.range", "at", "curve", "id", "is_query", "to.own")
    dealt = dealt.join(vectors.select("id", "v"), "id").repartition("range").sortWithinPartitions("range", "at")
    return dealt.select("range", "curve", "id", "is_query", "own", "v").mapInArrow(near, FOUND)


def _of_all(vectors: DataFrame, k: int) -> DataFrame | None:
    """The true answers of ``MEASURED`` queries (lowest hash of the id), in one pass over all rows; None without a query."""
    asked = vectors.filter("is_query").select("id", "v", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h", "id").limit(MEASURED).toArrow()
    if not len(asked):
        return None
    q_ids, q = asked.column("id").to_numpy(), _matrix(asked.column("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = _best(q_ids, q, part.column(0).to_numpy(), _matrix(part.column(1)), k, np.ones((len(q), part.num_rows), dtype=bool))
                best = own if best is None else pd.concat((best, own)).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return settle(_ranked(vectors.select("id", "v").mapInArrow(run, FOUND), k).select("query_id", "vec_id"))


def _found_so_far(vectors: DataFrame, sample: np.ndarray, k: int, half: int, seed: int, whole: bool) -> DataFrame:
    """Rounds of orderings until the windows have found the wanted share; one ordering where its windows hold all rows."""
    if whole:
        return settle(_ranked(_windows(vectors, _curves(sample, seed, range(1)), k, half), k))
    truth, found, done = _of_all(vectors, k), None, 0
    for r in range(ROUNDS):
        more = ORDERINGS[min(r, len(ORDERINGS) - 1)]
        own = _windows(vectors, _curves(sample, seed, range(done, done + more)), k, half)
        found = settle(_ranked(own if found is None else found.select("query_id", "vec_id", "score").unionByName(own), k))
        done += more
        if truth is None or found.join(F.broadcast(truth), ["query_id", "vec_id"]).count() >= WANTED * truth.count():
            break
    return found


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, vector_id: str = "vec_id", vector: str = "embedding", half: int = HALF_WINDOW, widen: bool = False, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query row, as found.

    Every row but the query's own is a candidate; fewer than k give all. Scores are in double
    precision on the original vectors, equal ones go to the smaller id. Rows whose id is null or
    whose vector is null, zero or holds null or non-finite components take no part, nor do rows whose
    vector is not of the commonest length (the least of equals). Rows that repeat an id are one
    candidate, with the least of their vectors (and a query, if one of them is). Equal vectors, also
    very many of them, are told apart by their ids in the orderings, so no range grows. No rows, or
    no query: no rows. Other columns are not read, whatever their names.

    With up to ``half`` + 1 usable rows all are found. Beyond, each is found if some ordering places it
    within ``half`` places of the query; orderings are added until ``WANTED`` of the true answers of a
    sample of queries are found (or ``ROUNDS`` rounds, some thousand orderings, are over). ``widen`` searches
    on until nothing is missed, at a cost that grows with queries times rows where the vectors have no
    structure.
    """
    clean = vectors.select(F.col(vector_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector).alias("v"))
    clean = clean.filter(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if lengths is None:
        return clean.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = settle(clean.filter(F.size("v") == lengths["n"]).groupBy("id").agg(F.max("is_query").alias("is_query"), F.min("v").alias("v")))
    sample = clean.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).toArrow()
    sample = _matrix(sample.column("v"))
    curves = _curves(sample, seed, range(1))
    found = _found_so_far(clean, sample, k, half, seed, lengths["count"] <= half + 1)
    if not widen:
        return found.select("query_id", "rank", "vec_id", "score")
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).select("query_id", F.col("score").alias("least"))

    def first_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keys(_matrix(batch.column(2)), curves[0]))], names=["id", "is_query", "v", "place"])

    placed = clean.select("id", "is_query", F.col("v").cast("array<double>").alias("v")).mapInArrow(first_key, "id long, is_query boolean, v array<double>, place long")
    rows = lengths["count"]
    # blocks are cut at quantiles of the first ordering; many rows at one place are dealt by a hash
    blocks = max(1, -(-rows // BLOCK))
    cuts = sorted(set(placed.approxQuantile("place", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    placed = settle(placed.withColumn("block", cuts_below(F.col("place"), [int(c) for c in cuts]).cast("long")))
    parts = {r["block"]: -(-r["count"] // (2 * BLOCK)) for r in placed.groupBy("block").count().collect()}  # a row a block
    splits = placed.sparkSession.createDataFrame(sorted(parts.items()), "block long, parts long")
    placed = placed.join(F.broadcast(splits), "block").withColumn("block", F.col("block") * 100_000 + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    asking = placed.filter("is_query")
    q_blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    names = [b * 100_000 + i for b, n in sorted(parts.items()) for i in range(n)]
    asking = asking.select(F.col("id").alias("query_id"), F.col("v").alias("query")).join(least, "query_id", "left")
    asking = asking.select("query_id", "query", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(q_blocks)).cast("int").alias("q"), F.explode(F.array(*[F.lit(n).cast("long") for n in names])).alias("block"))
    offered = placed.select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))

    def widened(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("id")
        q, v = np.array(left["query"].tolist()), np.array(right["v"].tolist())
        centre = v.mean(axis=0)
        radius = np.sqrt(((v - centre) ** 2).sum(axis=1).max())
        reach = q @ centre + np.sqrt((q * q).sum(axis=1)) * radius
        own = np.flatnonzero(reach >= left["least"].to_numpy() - NEAR)
        some = [own[at : at + 256] for at in range(0, len(own), 256)]
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat([none.astype({"query_id": "int64", "vec_id": "int64"}), *[_best(left["query_id"].to_numpy()[x], q[x], right["id"].to_numpy(), v, k, np.ones((len(x), len(v)), dtype=bool)) for x in some]])

    more = asking.groupBy("q", "block").cogroup(offered.groupBy("q", "block")).applyInPandas(widened, FOUND)
    return _ranked(found.select("query_id", "vec_id", "score").unionByName(more), k).select("query_id", "rank", "vec_id", "score")
