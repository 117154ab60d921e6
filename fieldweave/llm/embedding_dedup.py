"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

1. Vectors that are equal, with equal labels, fall together into one *node*.
2. Each table hashes a node to the signs of its products with some random directions. Two vectors at an
   angle t agree in a sign with probability 1 - t/pi; the number of tables follows from the recall
   wanted at the threshold, the number of signs from the rows of the largest label.
3. Nodes that share label, table and signs meet, by pairs of blocks where a bucket is large, and
   their cosines are computed. A pair that also meets in an earlier table is left to it, so each link
   is counted once; only counts and one edge a node leave the task.
4. The edges give the classes, as connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.neighbours import exact, usable
from fieldweave.operators.components import components
from fieldweave.shared import settle, small

#: Nodes of a block of a bucket; nodes of a label that share a bucket by chance, on average; least and most signs.
BLOCK, BY_CHANCE, SIGNS = 512, 2, (4, 18)
#: Groups of so many rows are searched many at once, larger ones by a matrix product each.
FEW = 32
#: Cosines that are nearer to the threshold than this are computed again, term by term.
NEAR = 1e-9


def tables_for(threshold: float, recall: float, rows: int) -> tuple[int, int]:
    """(tables, signs) for so many rows of the largest label: a pair at the threshold meets in some table with probability ``recall``."""
    signs = min(max(SIGNS[0], math.ceil(math.log2(max(rows, 1) / BY_CHANCE))), SIGNS[1])
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return max(1, math.ceil(math.log1p(-recall) / math.log1p(-agree))), signs


def directions(seed: int, dims: int, tables: int, signs: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(dims, tables * signs))


def _hashes(v: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    signs = planes.shape[1] // tables
    bits = (v @ planes > 0).reshape(len(v), tables, signs)
    return bits @ (1 << np.arange(signs, dtype=np.int32))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles; where lengths differ (they never meet) zeros stand behind the shorter ones."""
    each = column.to_pylist()
    longest = max(map(len, each))
    return np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in each), dtype=np.float64).reshape(len(each), -1)


def hashed(nodes: DataFrame, tables: int, signs: int, seed: int) -> DataFrame:
    """node, block (label and length), copies, hashes (array of int, one a table), v (bytes of doubles, of length 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            length = np.diff(batch.column(3).offsets.to_numpy())
            for dims in np.unique(length):  # lengths that differ never meet, each has directions of its own
                if dims not in planes:
                    planes[dims] = directions(seed, int(dims), tables, signs)
                own = batch.take(pa.array(np.flatnonzero(length == dims)))
                m = own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                m = m / np.abs(m).max(axis=1, keepdims=True)  # no square of a component leaves the doubles
                m = m / np.sqrt(exact(m, m))[:, None]
                h = _hashes(m, planes[dims], tables)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(list(h), pa.list_(pa.int32())), pa.array([r.tobytes() for r in m], pa.binary())], names=["node", "block", "copies", "hashes", "v"])

    return nodes.select("node", "block", "copies", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "node long, block long, copies long, hashes array<int>, v binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first ``keys`` columns, about a batch at a time, never cut within a group; and where groups start."""
    waiting: pa.Table | None = None
    for batch in chain(batches, (None,)):
        if batch is not None and not batch.num_rows:
            continue
        rows = [x for x in (waiting, None if batch is None else pa.Table.from_batches([batch])) if x is not None]
        if not rows:
            return
        table = pa.concat_tables(rows)
        change = np.zeros(len(table), dtype=bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        end = len(table) if batch is None else int(starts[-1])
        waiting = table.slice(end)
        if end:
            yield table.slice(0, end), starts[starts < end]


def _pairs(v: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of one group whose product is ``least`` or more, and their products."""
    size = np.diff(np.append(starts, len(v)))
    group = np.repeat(np.arange(len(starts)), size)
    out = []
    few = size[group] <= FEW
    for k in range(1, int(min(FEW, size.max(initial=1)))):  # many small groups at once: each row with the k-th after it
        i = np.flatnonzero(few[:-k] & (group[:-k] == group[k:]))
        for at in range(0, len(i), 4096):
            part = i[at : at + 4096]
            cosine = np.einsum("nd,nd->n", v[part], v[part + k])
            near = cosine >= least
            out.append((part[near], part[near] + k, cosine[near]))
    for g in np.flatnonzero(size > FEW):
        own = v[starts[g] : starts[g] + size[g]]
        cosine = own @ own.T
        i, j = np.nonzero(np.triu(cosine >= least, 1))
        out.append((starts[g] + i, starts[g] + j, cosine[i, j]))
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *out, strict=True))


def links(met: DataFrame, threshold: float) -> DataFrame:
    """kind 0: node, other = least node joined with it here; kind 1: node, n = vectors linked with it here for the first time.

    met: block, table, value, b1, b2, own, node, copies, hashes, v.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, 5):
            node, own, copies, table = (rows.column(c).to_numpy() for c in ("node", "own", "copies", "table"))
            v = _vectors(rows.column("v"))
            i, j, cosine = _pairs(v, starts, threshold - NEAR)
            # of two blocks only pairs across them
            met_here = (rows.column("b1").to_numpy()[i] == rows.column("b2").to_numpy()[i]) | (own[i] != own[j])
            close = np.flatnonzero(cosine < threshold + NEAR)
            met_here[close] &= exact(v[i[close]], v[j[close]]) >= threshold
            i, j = i[met_here], j[met_here]
            h = rows.column("hashes").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            first = np.zeros(len(i), dtype=bool)
            for at in range(0, len(i), 16_384):  # the first table in which both have one hash counts the link
                part = slice(at, at + 16_384)
                first[part] = (h[i[part]] == h[j[part]]).argmax(axis=1) == table[i[part]]
            i, j = i[first], j[first]
            n = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = node.copy()
            while True:
                before = root.copy()
                np.minimum.at(root, i, before[j])
                np.minimum.at(root, j, before[i])
                if (root == before).all():
                    break
            moved, some = root != node, n > 0
            none = np.zeros(len(node), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((node[moved], node[some]))), pa.array(np.concatenate((root[moved], none[some]))), pa.array(np.concatenate((none[moved], n[some].astype(np.int64))))], names=["node", "other", "n"]
            )

    keys = ["block", "table", "value", "b1", "b2"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "own", "node", "copies", "hashes", "v").mapInArrow(run, "node long, other long, n long")


def near_vectors(vectors: DataFrame, *, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.9999, seed: int = 5) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null, their vectors are of one length and
    their cosine, in double precision, is ``threshold`` (above 0) or more. n_links counts the other
    rows linked with this one; component_id is the least vec_id that links reach, its own included
    (null only if all of them are null); kept tells whether it is the row's own. Rows whose label or
    vector is null, whose vector is empty, zero or holds null or non-finite components link with
    nothing. Rows of equal label and vector are one node with so many copies (told apart by 64-bit
    hashes), so any number of copies meets others once; rows that repeat an id are rows. Other columns
    are not read. No rows: no rows.

    No pair below the threshold is linked. A pair at the threshold is missed with probability
    1 - ``recall``, one above it more rarely. Large buckets are compared by pairs of blocks of 512
    different vectors, in as many tasks.
    """
    rows = vectors.select(F.col(vector_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    may = F.col("label").isNotNull() & usable(F.col("v"))
    rows = settle(rows.select("vec_id", "label", "v", F.when(may, F.xxhash64("label", F.size("v"), "v")).alias("node"), F.xxhash64("label", F.size("v")).alias("block")))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("block").alias("block"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = settle(nodes)
    largest = nodes.groupBy("block").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    tables, signs = tables_for(threshold, recall, largest)
    sketch = settle(hashed(nodes, tables, signs, seed))
    dealt = sketch.select("node", "block", F.posexplode("hashes").alias("table", "value"))
    keys = ["block", "table", "value"]
    sizes = settle(dealt.groupBy(*keys).agg(F.count("*").alias("size")).filter(F.col("size") > 1))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    met = dealt.join(small(sizes), keys).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = settle(met.select("node", *keys, "own", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2")))
    verified = settle(links(met.join(small(sketch.select("node", "copies", "hashes", "v")), "node"), threshold))
    classes = components(verified.filter(F.col("n") == 0).select(F.col("node").alias("u"), F.col("other").alias("v")))
    others = verified.groupBy("node").agg(F.sum("n").alias("others"))
    every = nodes.select("node", "copies", "first").join(classes.withColumnRenamed("root", "class"), "node", "left").join(others, "node", "left")
    every = every.withColumn("class", F.coalesce("class", "node"))
    least = every.groupBy("class").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    # only nodes of several rows or in a class of several nodes tell more than the row itself does
    told = every.join(least, "class").filter((F.col("copies") > 1) | (F.col("size") > 1))
    told = small(settle(told.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))))
    out = rows.select("vec_id", "node").join(told, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
