"""Removal of long repeated substrings (suffix-array dedup by threshold-bounded interval expansion).

1. Anchors. Each window of ``least`` bytes has one anchor: its k-byte string of least hash. Equal
   windows have equal anchors at equal places, so windows whose anchor occurs once are not repeated;
   the stretch of windows with one anchor, as a hash, stands for them in the shuffle.
2. A stretch that occurs twice is repeated as a whole. Only distinct stretches with a common anchor
   may share a part: their bytes are fetched, dealt by anchor, cut to what may be shared, and a
   Burrows-Wheeler transform of some groups at a time finds the windows that occur twice (see bwt).
3. A group of more distinct stretches than one task should hold is split by further anchors: the
   windows at neighbouring places have all but a few bytes in common, and these bytes are the new
   anchor of that part of the stretch. Each window lies in one part, equal windows in parts of one
   anchor, so step 2 holds for the parts as it stands, and the parts spread over all tasks.
4. The covered bytes of each document are put together and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.llm.bwt import repeated_starts
from fieldweave.llm.jaccard_join import by_group
from fieldweave.llm.lean import lean
from fieldweave.llm.shingles import mixed
from fieldweave.llm.split import free
from fieldweave.shared import settle, small

#: Bytes of an anchor, at most a quarter of the window.
ANCHOR = 100
#: Bytes whose anchors are found at a time; bytes that a transform takes; stretches that share an
#: anchor, beyond which they are split by further anchors, of windows at so many places, then of one.
PIECE, TRANSFORM, GROUP, PLACES = 1 << 18, 1 << 20, 2000, (16, 1)
#: Bytes of a passage: fifty-one words of two letters are 152 bytes.
PASSAGE = 150
#: Steps, in bytes, of what stretches are compared by on either side of their anchor.
STEP = 50
_ODD = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of all substrings of k bytes, by differences of a running polynomial modulo 2^64."""

    def __init__(self, k: int):
        self.k, self.powers, self.inverse = k, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(data):
            n = max(len(data), 1 << 16)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _ODD, np.uint64))), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, pow(_ODD, -1, 1 << 64), np.uint64))), dtype=np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=total[1:])
            return mixed((total[self.k :] - total[: -self.k]) * self.inverse[: len(data) - self.k + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, bounds: np.ndarray, least: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """start, windows, lead (anchor - start), anchor hash of each stretch; bounds: where texts begin and end."""
    k, n = rolling.k, len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    if n < least:
        return none
    h = rolling.of(data)
    bits = np.uint64(n.bit_length())
    # the low bits hold the place, counted from the right: of equal hashes the last is the least
    key = (h >> bits << bits) | (np.uint64(n) - np.arange(len(h), dtype=np.uint64))
    best = sliding_least(key, least - k + 1)
    anchor = n - (best & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    open_ = np.zeros(n + 1, dtype=np.int32)
    lengths = np.diff(bounds)
    some = lengths >= least
    np.add.at(open_, bounds[:-1][some], 1)
    np.add.at(open_, bounds[1:][some] - least + 1, -1)
    valid = np.flatnonzero(np.cumsum(open_)[: len(anchor)] > 0)
    if not len(valid):
        return none
    a = anchor[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    start = valid[first]
    return start, count, a[first] - start, h[a[first]].view(np.int64)


OCCURRENCE = "key long, at int, n int, lead int, anchor long, stretch long"


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """Every stretch of ``docs`` (key, text): windows at .. at + n - 1 share the anchor at + lead.

    Where ``docs`` has parts (array of low, high) too, only windows inside one of these are looked at.
    """
    limited = "parts" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(min(ANCHOR, max(1, least // 4)))
        names = [c.split()[0] for c in OCCURRENCE.split(", ")]
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            waiting: list[tuple[int, int, bytes]] = []
            size = 0

            def found(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
                raw = b"".join(p[2] for p in parts)
                bounds = np.cumsum([0, *(len(p[2]) for p in parts)])
                start, count, lead, anchor = stretches(np.frombuffer(raw, dtype=np.uint8), bounds, least, rolling)
                own = np.searchsorted(bounds, start, side="right") - 1
                view = memoryview(raw)
                names_of = [xxhash.xxh3_64_intdigest(view[i : i + c + least - 1]) for i, c in zip(start.tolist(), count.tolist(), strict=True)]
                at = start - bounds[own] + np.array([p[1] for p in parts], dtype=np.int64)[own]
                key = np.array([p[0] for p in parts], dtype=np.int64)[own]
                columns = [key, at.astype(np.int32), count.astype(np.int32), lead.astype(np.int32), anchor, np.array(names_of, dtype=np.uint64).view(np.int64)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

            inside = batch.column(2).to_pylist() if limited else repeat(None)
            for key, text, ranges in zip(keys, batch.column(1).to_pylist(), inside, strict=False):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for low, high in [(0, len(raw))] if ranges is None else [(r["low"], r["high"]) for r in ranges]:
                    for at in range(low, high - least + 1, PIECE):  # pieces overlap, so that no window is lost
                        part = raw[at : min(high, at + PIECE + least - 1)]
                        if size + len(part) > PIECE and waiting:
                            yield found(waiting)
                            waiting, size = [], 0
                        waiting.append((key, at, part))
                        size += len(part)
            if waiting:
                yield found(waiting)

    return docs.mapInArrow(lean(run), OCCURRENCE)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


STRINGS = "key long, at int, n int, lead int, anchor long, once boolean, crowd boolean, bytes binary"


def _fetch(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` (key, at, n, lead, anchor, stretch, once, crowd) with the bytes of each stretch."""
    keys = small(settle(wanted.select("key").distinct()))
    by_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "n", "lead", "anchor", "once", "crowd")).alias("parts"))
    texts = docs.join(keys, "key", "left_semi").dropDuplicates(["key"]).join(by_doc, "key").select("key", "text", "parts")
    names = [c.split()[0] for c in STRINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                columns = {n: [p[n] for p in parts] for n in names[1:-1]}
                columns |= {"key": [key] * len(parts), "bytes": [raw[p["at"] : p["at"] + p["n"] + least - 1] for p in parts]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fetched], schema=fetched)

    fetched = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("once", pa.bool_()), ("crowd", pa.bool_()), ("bytes", pa.binary())])
    return texts.mapInArrow(lean(run), STRINGS)


def shareable(strings: list[bytes], leads: list[int], least: int) -> list[tuple[int, int]]:
    """Of distinct stretches with one anchor (at ``leads``): the range that shared windows lie in.

    Equal windows have their anchor at one place, so two stretches that share a window agree from its
    begin over the anchor to its end. How far a stretch agrees with any other on either side is found
    in steps, so a range may be too long by less than a step, never too short.
    """
    reach = []
    for side in (-1, 1):
        far, going = [0] * len(strings), list(range(len(strings)))
        for step in range(STEP, least + STEP, STEP):
            met: dict[bytes, list[int]] = {}
            for i in going:
                far[i] = step  # it agrees with another over fewer bytes, if it stops here
                lead = leads[i]
                part = strings[i][max(0, lead - step) : lead] if side < 0 else strings[i][lead : lead + step]
                if len(part) == step:
                    met.setdefault(part, []).append(i)
            going = [i for same in met.values() if len(same) > 1 for i in same]
            if not going:
                break
        reach.append(far)
    return [(max(0, lead - a), min(len(s), lead + b)) for s, lead, a, b in zip(strings, leads, *reach, strict=True)]


SPANS = "key long, low int, high int"


def _shared_parts(stretches_: DataFrame, least: int) -> DataFrame:
    """Covered bytes of stretches that occur once, from those that share their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(rows: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
            out: list[tuple[int, int, int]] = []
            for mask, (key, at, once, _) in zip(repeated_starts([r[3] for r in rows], least), rows, strict=True):
                if once:
                    out += [(key, at + i, at + j - 1 + least) for i, j in _runs(mask)]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["key", "low", "high"])

        waiting, size = [], 0
        for table in by_group(batches, 1):
            strings, leads, keys, ats, onces = (table.column(c).to_pylist() for c in ("bytes", "lead", "key", "at", "once"))
            cut = zip(keys, ats, onces, strings, shareable(strings, leads, least), strict=True)
            own = [(key, at + low, once, s[low:high]) for key, at, once, s, (low, high) in cut if high - low >= least]
            if len(own) < 2:
                continue
            waiting += own
            size += sum(len(r[3]) for r in own)
            if size >= TRANSFORM:
                yield spans(waiting)
                waiting, size = [], 0
        if waiting:
            yield spans(waiting)

    dealt = stretches_.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "key", "at", "once", "lead", "bytes").mapInArrow(lean(run), SPANS)


def _split(crowded: DataFrame, least: int, places: int) -> DataFrame:
    """Stretches of a crowded anchor as parts: windows that begin at so many neighbouring places
    before the anchor. What these have in common, all but ``places`` - 1 bytes, is the part's anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OCCURRENCE.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        signed = lambda b: xxhash.xxh3_64_intdigest(b) - (1 << 63)
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for key, at, n, lead, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "n", "lead", "bytes")), strict=True):
                view = memoryview(raw)
                for part in range((lead - n + 1) // places, lead // places + 1):
                    first, end = max(0, lead - (part + 1) * places + 1), min(n, lead - part * places + 1)
                    common = lead - part * places
                    out.append((key, at + first, end - first, common - first, signed(view[common : common + least - places + 1]), signed(view[first : end - 1 + least])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    return crowded.mapInArrow(lean(run), OCCURRENCE)


def _covered(every: DataFrame, docs: DataFrame, least: int, places: tuple[int, ...] = PLACES) -> DataFrame:
    """key, low, high of the repeated windows of ``every`` (a table of occurrences)."""
    anchors = every.groupBy("anchor").agg(F.count("*").alias("c"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    anchors = settle(anchors.filter(F.col("c") > 1).select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    twice = settle(every.join(small(anchors), "anchor"))
    high = (F.col("at") + F.col("n") - 1 + least).alias("high")
    whole = twice.filter(~F.col("mixed")).select("key", F.col("at").alias("low"), high)
    distinct = twice.filter("mixed").groupBy("anchor", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("key", "at", "n", "lead")).alias("one"))
    distinct = settle(distinct.select("anchor", "stretch", (F.col("c") == 1).alias("once"), "one.*"))
    again = small(settle(distinct.filter(~F.col("once")).select("anchor", "stretch")))
    copied = twice.filter("mixed").join(again, ["anchor", "stretch"]).select("key", F.col("at").alias("low"), high)
    open_ = distinct.groupBy("anchor").agg(F.count("*").alias("c"), F.max("once").alias("some")).filter("some")
    open_ = small(settle(open_.select("anchor", (F.col("c") > GROUP).alias("crowd"))))
    strings = settle(_fetch(docs, distinct.join(open_, "anchor"), least))
    found = whole.unionByName(copied).unionByName(_shared_parts(strings.filter(~F.col("crowd")), least))
    crowded = strings.filter("crowd")
    if not places or crowded.isEmpty():  # parts of one place are single windows: none of them is mixed
        return found
    return found.unionByName(_covered(settle(_split(crowded, least, places[0])), docs, least, places[1:]))


def spans(docs: DataFrame, least: int) -> DataFrame:
    """key, low, high: the maximal byte ranges of ``docs`` (key, text and, if need be, parts, outside of
    which nothing of this length is repeated) that repeated strings of ``least`` bytes cover."""
    found = _covered(settle(occurrences(docs, least)), docs.select("key", "text"), least)
    # ranges that overlap or touch become one before anything gathers them
    before = Window.partitionBy("key").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    begins = found.withColumn("begins", F.coalesce(F.col("low") > F.max("high").over(before), F.lit(True)).cast("long"))
    runs = begins.withColumn("run", F.sum("begins").over(Window.partitionBy("key").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def without_repeats(docs: DataFrame, least: int = 400) -> DataFrame:
    """``docs`` with the text that dedup_substrings leaves, null as empty; columns stay as they are.

    Where a run begins or ends within a character, what is left of the character goes too. Nulls,
    empty and very long texts, repeated rows and empty tables give what dedup_substrings says;
    columns of any name, removed and kept too, pass through.
    """
    names = {c: free(c, docs.columns) for c in ("removed", "kept")}
    cut = dedup_substrings(docs, least, as_text=True, **names)
    return cut.withColumn("text", F.col(names["kept"])).select(*docs.columns)


def dedup_substrings(docs: DataFrame, least: int = 400, *, as_text: bool = False, removed: str = "removed", kept: str = "kept", shorter: int | None = None, repeated: str = "repeated") -> DataFrame:
    """``docs`` with removed (array of low, high: the maximal removed byte runs), kept (bytes left).

    ``shorter`` adds repeated: how many bytes strings of this length cover that occur elsewhere too;
    they stay. Such ranges hold all longer repeats, so the search for those is limited to them.

    Texts are read as UTF-8, null as empty; a byte goes if a string of ``least`` bytes that covers it
    starts anywhere else too, in the same or another row (matches never cross rows and are judged on
    the input; repeated rows are each other's repeats). Shorter texts stay whole; very long ones are
    read in overlapping pieces. Input columns of the result's names are replaced, others pass through,
    whatever they are called. Nulls elsewhere pass through. No rows: no rows. ``as_text`` gives kept
    as a string, without characters that a run has cut.
    """
    new = [removed, kept, *([repeated] if shorter else [])]
    columns = [c for c in docs.columns if c.lower() not in [n.lower() for n in new]]
    key, parts = free("__key", columns), free("__parts", columns)
    docs = docs.select(*columns).withColumn(key, F.xxhash64("doc_id", "text"))
    narrow = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    if shorter:
        if not 0 < shorter <= least:
            raise ValueError("shorter must be positive and at most least")
        short = settle(spans(narrow, shorter))
        sizes = small(settle(short.groupBy("key").agg(F.sum(F.col("high") - F.col("low")).alias(repeated)).withColumnRenamed("key", key)))
        inside = short.filter(F.col("high") - F.col("low") >= least).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("parts"))
        narrow = narrow.join(small(settle(inside)), "key")
        docs = docs.join(sizes, key, "left").withColumn(repeated, F.coalesce(repeated, F.lit(0)).cast("long"))
        columns = [*columns, repeated]
    cut = settle(spans(narrow, least).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias(parts)).withColumnRenamed("key", key))
    keys = small(cut.select(key))
    none = F.array().cast("array<struct<low:int,high:int>>")
    untouched = docs.join(keys, key, "left_anti").select(*columns, none.alias(removed), (F.coalesce("text", F.lit("")) if as_text else F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias(kept))
    touched = docs.join(keys, key, "left_semi").join(cut, key).select(*columns, parts)
    at = columns.index("text")
    schema = T.StructType([*(touched.schema[c] for c in columns), T.StructField(removed, touched.schema[parts].dataType), T.StructField(kept, T.StringType() if as_text else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                ends = [0, *(r["high"] for r in runs)]
                left.append(b"".join(raw[i:j] for i, j in zip(ends, [*(r["low"] for r in runs), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.decode("utf-8", "ignore") for k in left], pa.string()) if as_text else pa.array(left, pa.binary())], names=[*columns, removed, kept])

    return untouched.unionByName(touched.mapInArrow(lean(run), schema))
