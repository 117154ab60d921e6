"""N-gram Jaccard join by MinHash banding, verified on the full shingle sets.

1. Texts with equal shingle sets fall together into one *node* (a hash of the set).
2. Bands of MinHash values deal the nodes into buckets; band and row counts follow from the recall
   wanted at the threshold. Within a bucket nodes are compared by their whole MinHash rows (a byte a
   value) and those near the threshold are joined. A large bucket is dealt to blocks, and some of its
   nodes, the leaders, go to every block; what these have not joined meets by pairs of blocks.
3. In the groups that arise, pairs are verified on their full shingle sets, by blocks of a matrix
   product, so a link that the bands missed is found too. Links are counted inside the task; only one
   edge for each joined node leaves it, to give the classes as components.
4. A large group gets centres: sets of shingles that most of some similar members have. The distance
   of two sets (how many shingles only one of them has) obeys the triangle inequality, so distances
   to a centre tell of most pairs whether they are linked: these are counted by class, without being
   made. Only classes whose distances leave it open meet by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.lean import lean
from fieldweave.llm.shingles import Words, mixed, shingle_hashes
from fieldweave.llm.split import free
from fieldweave.operators.components import components
from fieldweave.shared import settle, small

#: Nodes in a block of a bucket and in a block of a group; leaders of a large bucket.
BUCKET_BLOCK, GROUP_BLOCK, LEADERS = 512, 256, 8
#: Members of a large group that give its centres, and their bytes; most centres; shells about a
#: centre. They decide how many pairs have to be compared, never which pairs are linked.
SAMPLE, SAMPLE_BYTES, CENTRES, SHELLS = 200, 64 << 20, 16, 9
#: Under the threshold by so much, the share of equal MinHash values still counts as near: over five
#: standard errors at 72 values.
SLACK = 0.25


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach ``recall`` at the threshold within ``most`` values."""
    found = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            found = (bands, rows)
    return found


def minhashes(shingles: np.ndarray, values: int) -> np.ndarray:
    """The least value of the set under each of so many hash functions."""
    k = np.arange(1, values + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a, b = mixed(k) | np.uint64(1), mixed(k + np.uint64(1 << 32))
        out = np.full(values, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048, None]
            h = part * a[None, :] + b[None, :]
            out = np.minimum(out, (h ^ (h >> np.uint64(29))).min(axis=0))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """key, doc_id, node (null without words), bands (array of long), bytes (one for each MinHash)."""
    docs = docs.select(row_key().alias("key"), "doc_id", "text")
    schema = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            nodes, dealt, short = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_hashes(words.of(text or ""), n)
                if not len(own):
                    nodes.append(None), dealt.append(None), short.append(None)
                    continue
                values = minhashes(own, bands * rows)
                with np.errstate(over="ignore"):
                    band = np.zeros(bands, dtype=np.uint64)
                    for r in range(rows):
                        band = mixed(band + values[r::rows] + np.uint64(r + 1))
                nodes.append(node_of(own)), dealt.append(_signed(band)), short.append((mixed(values) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(dealt, pa.list_(pa.int64())), pa.array(short, pa.binary())], names=["key", "doc_id", "node", "bands", "bytes"])

    return docs.mapInArrow(lean(run), schema)


def row_key() -> Column:
    """Rows of equal id and text share it."""
    return F.xxhash64("doc_id", "text")


def in_blocks(df: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Copies each row to the pairs of blocks in which it meets others: columns b1 <= b2, own.

    plan: for each klass of a group (``keys``) its first block, its number of blocks and the blocks
    that it meets. Rows are dealt to the blocks of their klass by a hash of their node, so any group
    spreads over as many tasks as it has pairs of blocks that must meet.
    """
    met = df.join(small(plan), [*keys, "klass"])
    met = met.withColumn("own", (F.col("first") + F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))).cast("int"))
    met = met.withColumn("other", F.explode("meets"))
    return met.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("other", "first", "blocks", "meets")


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """From batches sorted by their first ``keys`` columns: the rows of each key together."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            key = tuple(c[i] for c in columns)
            if key != last and waiting:
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = key
            waiting.append(batch.slice(i, j - i))
    if waiting:
        yield pa.Table.from_batches(waiting)


def roots_of(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the least node of each row's component."""
    label = nodes.copy()
    while True:
        new = label.copy()
        for i in range(len(label)):
            near = label[linked[i]]
            if len(near):
                new[i] = min(new[i], near.min())
        # a label leads on to the label of its node
        order = np.argsort(nodes)
        new = np.minimum(new, new[order][np.searchsorted(nodes[order], new)])
        if (new == label).all():
            return label
        label = new


def near_edges(members: DataFrame, values: int, threshold: float) -> DataFrame:
    """u, v: joins of nodes that share a bucket and nearly all their MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 4):
            node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
            node, at = np.unique(node, return_index=True)
            if len(node) < 2:
                continue
            own = own[at]
            sig = np.frombuffer(b"".join(table.column("bytes").take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), values)
            least = int(np.ceil((threshold - SLACK) * values))
            linked = np.zeros((len(at), len(at)), dtype=bool)
            for i in range(len(at)):
                linked[i] = (sig == sig[i]).sum(axis=1) >= least
            root = roots_of(linked, node)
            moved = root != node
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], names=["u", "v"])

    dealt = members.repartition("band", "value", "b1", "b2").sortWithinPartitions("band", "value", "b1", "b2")
    return dealt.select("band", "value", "b1", "b2", "own", "node", "bytes").mapInArrow(lean(run), "u long, v long")


def _matrix(ids: list[np.ndarray], low: int, high: int) -> np.ndarray:
    m = np.zeros((len(ids), high - low), dtype=np.float32)
    for row, own in enumerate(ids):
        m[row, own[(own >= low) & (own < high)] - low] = 1
    return m


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, by a matrix product over the values that recur."""
    every, number, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[number]
    cuts = np.cumsum([0, *map(len, left), *map(len, right)])
    ids = [(c := column[i:j])[c >= 0] for i, j in zip(cuts, cuts[1:], strict=False)]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int((n > 1).sum()), 4096):
        a = _matrix(ids[: len(left)], low, low + 4096)
        b = a if left is right else _matrix(ids[len(left) :], low, low + 4096)
        out += a @ b.T
    return out


def _open_pairs(at: np.ndarray, open_: list[bytes]) -> np.ndarray:
    """From the number of each row's klass and the bits of the klasses that it has to meet: which rows meet which."""
    kinds, first, own = np.unique(at, return_index=True, return_inverse=True)
    bits = np.stack([np.unpackbits(np.frombuffer(open_[k].ljust(int(kinds[-1]) // 8 + 1, b"\0"), dtype=np.uint8))[kinds] for k in first]).astype(bool)
    return bits[own][:, own]


def links(groups: DataFrame, threshold: float) -> DataFrame:
    """kind 0: node, other = least node linked with it here; kind 1: node, n = documents linked with it here.

    groups: root, b1, b2, own, node, copies, shingles, at (the number of its klass) and open (bits of
    those that it has to meet; pairs of others are told of elsewhere).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 3):
            node, at = np.unique(table.column("node").to_numpy(), return_index=True)
            own = table.column("own").to_numpy()[at]
            copies = table.column("copies").to_numpy()[at]
            sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").take(pa.array(at)).to_pylist()]
            b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
            left = np.flatnonzero(own == b1)
            right = left if b1 == b2 else np.flatnonzero(own == b2)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], dtype=np.float64)
            a = [sets[i] for i in left]
            both = overlaps(a, a if b1 == b2 else [sets[i] for i in right]).astype(np.float64)
            near = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
            near &= _open_pairs(table.column("at").to_numpy()[at], table.column("open").take(pa.array(at)).to_pylist())[np.ix_(left, right)]
            if b1 == b2:
                np.fill_diagonal(near, False)
            linked = np.zeros((len(node), len(node)), dtype=bool)
            linked[np.ix_(left, right)] = near
            linked |= linked.T
            n = linked @ copies
            root = roots_of(linked, node)
            moved, some = root != node, n > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((node[moved], node[some]))), pa.array(np.concatenate((root[moved], np.zeros(some.sum(), np.int64)))), pa.array(np.concatenate((np.zeros(moved.sum(), np.int64), n[some])))], names=["node", "other", "n"]
            )

    dealt = groups.repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")
    return dealt.select("root", "b1", "b2", "own", "node", "copies", "shingles", "at", "open").mapInArrow(lean(run), "node long, other long, n long")


def joined_in_buckets(members: DataFrame, rows: DataFrame, values: int, threshold: float) -> DataFrame:
    """node, root: groups of nodes that are near each other by their MinHash values.

    members: band, value, node of buckets with several nodes; rows: node, bytes. First each block of
    a bucket is compared within itself and with the leaders of the bucket. Where a large bucket still
    holds several groups, all but the largest of them meet all blocks.
    """
    keys = ["band", "value"]
    sizes = settle(members.groupBy(*keys).agg(F.count("*").alias("size")))
    large = sizes.filter(F.col("size") > BUCKET_BLOCK)
    blocks = F.ceil(F.col("size") / F.lit(BUCKET_BLOCK)).cast("int")
    once = members.join(small(sizes), keys).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")).drop("size")
    few = large.isEmpty()
    if not few:
        large = settle(large)
        led = members.join(small(large), keys).groupBy(*keys, "size", F.pmod(F.xxhash64("node", F.lit(8)), F.lit(LEADERS)).alias("part"))
        led = settle(led.agg(F.min_by("node", F.xxhash64("node", F.lit(9))).alias("node")))
        once = once.unionByName(led.select(*keys, "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own")))
    rows = small(rows)
    compared = once.select("*", F.col("own").alias("b1"), F.col("own").alias("b2")).join(rows, "node")
    groups = settle(components(near_edges(compared, values, threshold)))
    if few:
        return groups
    inside = members.join(small(large.select(*keys)), keys).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = settle(inside)  # read three times
    roots = inside.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    open_ = roots.groupBy(*keys).agg(F.count("*").alias("roots"), F.max_by("root", "n").alias("most"), F.max("n").alias("main"), F.sum("n").alias("all")).filter(F.col("roots") > 1)
    open_ = settle(open_)
    if open_.isEmpty():
        return groups
    count = lambda n: F.ceil(n / F.lit(BUCKET_BLOCK)).cast("int")
    main, rest = count(F.col("main")), count(F.col("all") - F.col("main"))
    sequence = lambda low, n: F.sequence(low, low + n - 1)
    plan = open_.select(*keys, F.lit(0).alias("klass"), F.lit(0).alias("first"), main.alias("blocks"), sequence(main, rest).alias("meets"))
    plan = settle(plan.unionByName(open_.select(*keys, F.lit(-1).alias("klass"), main.alias("first"), rest.alias("blocks"), sequence(F.lit(0), main + rest).alias("meets"))))
    inside = inside.join(small(open_.select(*keys, "most")), keys).withColumn("klass", F.when(F.col("root") == F.col("most"), 0).otherwise(-1)).drop("most", "root")
    more = near_edges(in_blocks(inside, plan, keys).join(rows, "node"), values, threshold)
    stars = groups.filter(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v"))
    return settle(components(stars.unionByName(more)))


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """What more than half of the sets hold."""
    value, n = np.unique(np.concatenate(sets), return_counts=True)
    return value[2 * n > len(sets)]


def centres_of(sets: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """At most ``CENTRES`` sets that the given ones lie about, those with the most sets first."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = overlaps(sets, sets).astype(np.float64)
    near = both >= threshold * (size[:, None] + size[None, :] - both)
    left, found = np.ones(len(sets), dtype=bool), []
    while len(found) < CENTRES and left.any():
        degree = np.where(left, (near & left[None, :]).sum(axis=1), -1)
        own = near[int(degree.argmax())] & left
        if own.sum() < 2:
            break
        found.append(majority([sets[i] for i in np.flatnonzero(own)]))
        left &= ~own
    return [c for c in found if len(c)]


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values only one of two sets holds."""
    return np.array([len(x) for x in a], dtype=np.float64)[:, None] + np.array([len(x) for x in b], dtype=np.float64)[None, :] - 2 * overlaps(a, b).astype(np.float64)


def centres(big: DataFrame, stats: DataFrame, threshold: float) -> DataFrame:
    """root, centre (number), shingles, apart (distances to the root's centres) from some members of each root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 1):
            found = centres_of([np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles")[:SAMPLE].to_pylist()], threshold)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([table.column("root")[0].as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([c.tobytes() for c in found], pa.binary()), pa.array(distances(found, found).tolist(), pa.list_(pa.float64()))], names=["root", "centre", "shingles", "apart"]
                )

    wanted = F.least(F.lit(2.0 * SAMPLE), F.lit(float(SAMPLE_BYTES)) / F.greatest(F.col("bytes"), F.lit(1.0)))
    drawn = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = big.join(small(stats), "root").filter(drawn * F.col("members") < wanted).withColumn("drawn", drawn)
    return some.repartition("root").sortWithinPartitions("root", "drawn").select("root", "shingles").mapInArrow(lean(run), "root long, centre int, shingles binary, apart array<double>")


def placed_about(big: DataFrame, stats: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``big`` with size, distance to the nearest centre, spare (what is left of it until a set of this
    size is no longer sure to be linked) and klass: centre * SHELLS + shell, -1 far from all centres."""
    share = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, 2):
            guest = table.column("node").is_null().to_numpy(zero_copy_only=False)
            about = [np.frombuffer(b, dtype=np.uint64) for b in table.filter(pa.array(guest)).column("shingles").to_pylist()]
            table = table.filter(pa.array(~guest)).combine_chunks()
            sets = [np.frombuffer(b, dtype=np.uint64) for b in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            if not len(sets):
                continue
            d = distances(sets, about) if about else np.full((len(sets), 1), np.inf)
            best = d.argmin(axis=1)
            d = d[np.arange(len(d)), best]
            shell = np.minimum(4 * d / (share * size), SHELLS)  # pairs are sure to be linked if their shells add up to 8 at most, sizes alike
            klass = np.where(shell < SHELLS, best * SHELLS + np.floor(shell), -1).astype(np.int32)
            d = np.where(klass < 0, 0.0, d)
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("root", "node", "copies", "shingles")), pa.array(klass), pa.array(size), pa.array(d), pa.array(share * size - d)], names=["root", "node", "copies", "shingles", "klass", "size", "d", "spare"])

    parts = F.ceil(F.col("members") / F.lit(2 * GROUP_BLOCK)).cast("int")
    own = big.join(small(stats), "root").select("root", F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int").alias("part"), "node", "copies", "shingles", F.lit(0).alias("centre"))
    guests = found.join(small(stats), "root").select("root", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), "shingles", "centre")
    dealt = own.unionByName(guests).repartition("root", "part").sortWithinPartitions("root", "part", F.col("node").isNotNull(), "centre")
    return dealt.select("root", "part", "node", "copies", "shingles").mapInArrow(lean(run), "root long, node long, copies long, shingles binary, klass int, size double, d double, spare double")


PLAN = "root long, klass int, at int, start long, n long, meets array<int>, open binary, sure long, itself boolean, head long"


def plan_of(threshold: float):
    """For the klasses of a root: which are linked as they stand, which others have to meet, and in which blocks.

    The members stand in the order of their klasses and are cut to blocks of ``GROUP_BLOCK``, so small
    klasses share a block, and a member is copied at most as often as the root has blocks.
    """
    share = (1 - threshold) / (1 + threshold)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("klass").reset_index(drop=True)
        klass, n, copies, low = (rows[c].to_numpy() for c in ("klass", "n", "copies", "low"))
        spare, d_low, d_high, s_low, s_high = (rows[c].to_numpy(dtype=np.float64) for c in ("spare", "d_low", "d_high", "s_low", "s_high"))
        centre = np.where(klass < 0, -1, klass // SHELLS)
        start = np.cumsum(n) - n
        first, last = start // GROUP_BLOCK, (start + n - 1) // GROUP_BLOCK
        same = (centre[:, None] == centre[None, :]) & (centre >= 0)[:, None]
        sure = same & (spare[:, None] + spare[None, :] >= 0)
        reach = share * (s_high[:, None] + s_high[None, :]) + 1e-6
        far = (s_high[:, None] < (threshold - 1e-6) * s_low[None, :]) | (s_high[None, :] < (threshold - 1e-6) * s_low[:, None])
        far |= same & (np.maximum(d_low[:, None] - d_high[None, :], d_low[None, :] - d_high[:, None]) > reach)
        for i in range(len(rows)):
            for j in range(len(rows)):
                if centre[i] >= 0 and centre[j] >= 0 and centre[i] != centre[j]:
                    far[i, j] |= rows["apart"][i][centre[j]] - d_high[i] - d_high[j] > reach[i, j]
        must = ~sure & ~far
        meets = [sorted({b for j in np.flatnonzero(must[i]) for b in range(first[j], last[j] + 1)}) for i in range(len(rows))]
        total = (sure * copies[None, :]).sum(axis=1)
        head = [int(low[sure[i]].min()) if sure[i].any() else None for i in range(len(rows))]
        return pd.DataFrame({"root": rows["root"], "klass": klass, "at": np.arange(len(rows)), "start": start, "n": n, "meets": meets, "open": [np.packbits(m).tobytes() for m in must], "sure": total, "itself": np.diagonal(sure), "head": pd.array(head, dtype="Int64")})

    return run


def in_group_blocks(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Copies each row to the pairs of blocks in which it meets others: columns b1 <= b2, own, at, open."""
    u = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    met = placed.join(small(plan.filter(F.size("meets") > 0).select("root", "klass", "at", "start", "n", "meets", "open")), ["root", "klass"])
    met = met.withColumn("own", F.floor((F.col("start") + F.floor(u * F.col("n"))) / F.lit(GROUP_BLOCK)).cast("int")).withColumn("other", F.explode("meets"))
    return met.select("root", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "node", "copies", "shingles", "at", "open")


def verified_links(known: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, other, n as ``links`` gives them, for the groups of ``known`` (node, root, key, copies)."""
    sets = shingle_sets(docs, known.select("key"), n).dropDuplicates(["node"])
    sizes = settle(known.groupBy("root").agg(F.count("*").alias("members")))
    large = sizes.filter(F.col("members") > GROUP_BLOCK)
    whole = [*[F.lit(0).alias(c) for c in ("b1", "b2", "own")], "node", "copies", "shingles", F.lit(0).alias("at"), F.lit(b"\x80").alias("open")]
    if large.isEmpty():
        return links(sets.join(known.drop("key"), "node").select("root", *whole), threshold)
    large = small(settle(large))
    every = settle(sets.join(known.drop("key"), "node").join(large, "root", "left"))
    big = every.filter(F.col("members").isNotNull()).drop("members")
    stats = settle(every.filter(F.col("members").isNotNull()).groupBy("root", "members").agg(F.avg(F.octet_length("shingles")).alias("bytes")))
    found = settle(centres(big, stats, threshold))
    placed = settle(placed_about(big, stats, found, threshold))
    klasses = placed.groupBy("root", "klass").agg(
        F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("node").alias("low"), F.min("spare").alias("spare"), F.min("d").alias("d_low"), F.max("d").alias("d_high"), F.min("size").alias("s_low"), F.max("size").alias("s_high")
    )
    klasses = klasses.join(found.select("root", (F.col("centre") * SHELLS).alias("at"), "apart"), (klasses["root"] == found["root"]) & (F.floor(F.col("klass") / SHELLS) * SHELLS == F.col("at")), "left").select(klasses["*"], "apart")
    plan = settle(klasses.groupBy("root").applyInPandas(plan_of(threshold), PLAN))
    meeting = in_group_blocks(placed.select("root", "klass", "node", "copies", "shingles"), plan)
    met = links(every.filter(F.col("members").isNull()).select("root", *whole).unionByName(meeting), threshold)
    told = placed.select("root", "klass", "node", "copies").join(small(settle(plan.filter(F.col("head").isNotNull()).select("root", "klass", "sure", "itself", "head"))), ["root", "klass"])
    edges = told.filter(F.col("head") != F.col("node")).select("node", F.col("head").alias("other"), F.lit(0).cast("long").alias("n"))
    sure = told.select("node", F.lit(0).cast("long").alias("other"), (F.col("sure") - F.when(F.col("itself"), F.col("copies")).otherwise(F.lit(0))).alias("n"))
    return met.unionByName(edges).unionByName(sure.filter(F.col("n") > 0))


def shingle_sets(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """node, shingles (sorted 64-bit numbers) of the documents whose row key is in ``keys`` (key)."""
    picked = docs.select(row_key().alias("key"), "text").join(small(keys), "key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            own = [shingle_hashes(words.of(t or ""), n) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "shingles"])

    return picked.mapInArrow(lean(run), "node long, shingles binary")


def near_classes(docs: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, component, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of n-word shingles is at least
    ``threshold``; class_id is the least doc_id of all that links join (through others too), n_links
    the number of other rows linked with this one directly, copies included. Texts of fewer than n
    words are one shingle; those without a word (null, empty) link to nothing and are their own
    class, with class_id = doc_id. Null ids: a class of them alone has class_id null. Repeated rows
    are rows. component is the class itself, whatever its ids: the least node of it (null without a
    word); classes of null ids, or that share their least id, differ in it. Other columns are not read. Found pairs are exact; a link between texts that share no
    bucket, nor a group through others, is missed with probability 1 - ``recall`` at most.
    """
    bands, rows = bands_for(threshold, recall)
    values = bands * rows
    docs = docs.select("doc_id", "text")
    signed = settle(signatures(docs, bands, rows, n))
    nodes = signed.filter(F.col("node").isNotNull())
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = dealt.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    buckets = small(settle(buckets.filter(F.col("low") != F.col("high")).select("band", "value")))
    members = settle(dealt.join(buckets, ["band", "value"]).distinct())
    rows_of = nodes.join(small(settle(members.select("node").distinct())), "node").select("node", "bytes").dropDuplicates(["node"])
    groups = joined_in_buckets(members, settle(rows_of), values, threshold)
    known = nodes.join(small(groups), "node").groupBy("node", "root").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    known = settle(known)
    verified = settle(verified_links(known, docs, n, threshold))
    classes = components(verified.filter(F.col("n") == 0).select(F.col("node").alias("u"), F.col("other").alias("v")))
    linked = verified.groupBy("node").agg(F.sum("n").alias("others"))
    # every node: its class, its documents and those linked with it
    every = nodes.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    every = every.join(classes.withColumnRenamed("root", "class"), "node", "left").join(linked, "node", "left")
    every = every.withColumn("class", F.coalesce("class", "node"))
    first = every.groupBy("class").agg(F.min("first").alias("class_id"), F.count("*").alias("texts"))
    # only nodes of several documents or in a class of several texts tell more than the row itself does
    told = every.join(first, "class").filter((F.col("copies") > 1) | (F.col("texts") > 1))
    told = settle(told.select("node", "class", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    told = small(told)
    # class_id is null in a told row only if all ids of its class are
    return signed.select("key", "doc_id", "node").join(told, "node", "left").select("key", "doc_id", F.coalesce("class", "node").alias("component"), F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without all but one row of each class: that of the least id (null last, then by hash).

    Columns stay as they are. Of rows equal in id and text one stays, if their class keeps them.
    """
    classes = near_classes(docs, **how)
    # rows without links are classes of their own, so only the others are ranked
    grouped = classes.filter(F.col("n_links") > 0).select("key", "doc_id", "component")
    grouped = settle(grouped)
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    best = small(settle(best.select("component", F.col("best.key").alias("kept"))))
    gone = grouped.join(best, "component").filter(F.col("key") != F.col("kept")).select("key").distinct()
    kept_twice = grouped.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("key")
    gone = gone.withColumn("all", F.lit(True)).unionByName(kept_twice.withColumn("all", F.lit(False)))
    gone = settle(gone.groupBy("key").agg(F.max("all").alias("all")))
    key, every = free("__key", docs.columns), free("__all", docs.columns)
    left = docs.withColumn(key, row_key()).join(small(gone).select(F.col("key").alias(key), F.col("all").alias(every)), key, "left")
    once = left.filter(F.col(every).isNull()).select(*docs.columns)
    repeated = left.filter(~F.col(every)).dropDuplicates([key])
    return once.unionByName(repeated.select(*docs.columns))
