"""Document fingerprints: the k smallest distinct shingle hashes (a bottom-k sketch).

Sketches of parts merge into the sketch of the whole; two sketches estimate resemblance and
containment, one estimates the number of distinct shingles. While a set has at most k shingles
the figures are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.shingles import Words, shingle_hashes
from fieldweave.llm.split import cuts_below

#: Hashes kept in a sketch and their bits: 128 give a standard error of at most 0.045.
K, BITS = 128, 48


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """From sorted distinct 64-bit hashes."""
    return np.unique(hashes[: 2 * k] >> np.uint64(64 - BITS))[:k] if len(hashes) else hashes


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike (1)."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, a).__and__(np.isin(both, b)).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def encode(a: np.ndarray) -> str:
    """Base64 of the hashes as big-endian numbers of 6 bytes, ascending."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, n: int = 5) -> DataFrame:
    """doc_id, fingerprint and distinct_shingles (estimate) of every whole text; null reads as empty."""
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, distinct_shingles double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            own = [sketch(shingle_hashes(words.of(t or ""), n), k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encode, own), pa.string()), pa.array([distinct(a, k) for a in own], pa.float64())], names=["doc_id", "fingerprint", "distinct_shingles"])

    return docs.mapInArrow(run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next: the text that follows in ascending doc_id (after the last: the first).

    Null ids come first; rows that share an id follow each other by a hash of their text. Ids are cut
    at quantiles into slices; each slice gets the first row of the next as a last one, so every pair
    of neighbours lies in one task and each text moves once. Null texts read as empty, long ones stay
    whole; a single row follows itself. Rows of one id, null too, lie in one slice, however many there
    are. Columns but doc_id and text are not read, whatever their names. No rows: no rows.
    """
    spark = docs.sparkSession
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = sorted({int(x) for x in ids.dropna().approxQuantile("doc_id", [i / slices for i in range(1, slices)], 0.1 / slices)}) if slices > 1 else []
    at = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cut = cuts_below(at, cuts)
    heads = sorted((r["slice"], r["first"]) for r in ids.groupBy(cut.alias("slice")).agg(F.min(at).alias("first")).collect())  # a row per slice
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(cut.cast("int").alias("slice"), F.lit(0).alias("guest"), at.alias("at"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    if heads:
        to = [(heads[i - 1][0], first) for i, (_, first) in enumerate(heads)]
        guests = rows.join(F.broadcast(spark.createDataFrame(to, "to int, at long")), "at")
        guests = guests.select(F.col("to").alias("slice"), F.lit(1).alias("guest"), "at", "tie", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
        rows = rows.unionByName(guests)
    dealt = rows.repartition(slices // 4, "slice").sortWithinPartitions("slice", "guest", "at", "tie").select("slice", "guest", "doc_id", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            ids, out = batch.column(2), ([], [], [])
            for i, (slice_, guest, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                if waiting is not None and waiting[0] == slice_:
                    for to, x in zip(out, (*waiting[1:], text), strict=True):
                        to.append(x)
                waiting = None if guest else (slice_, ids[i].as_py(), text)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], ids.type), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "text", "next"])

    return dealt.mapInArrow(pairs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, next string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbour_likeness(docs: DataFrame, k: int = K, n: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text ends in the begin of the next row's text (see ``edited``); near_edited is the
    estimated resemblance of a text's fingerprint to the edited text's, near_next that to the next
    text's. Equal texts have equal fingerprints; those without a word (null, empty) have an empty one,
    and two empty ones are alike (1). Long texts are read whole, one at a time; repeated rows are rows.
    Order, nulls and ties of ids, and other columns, are as ``with_next`` has them. No rows: no rows.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        own = lambda t: sketch(shingle_hashes(words.of(t), n), k)
        last = ("", own(""))
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text, following in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a = last[1] if last[0] == text else own(text)
                last = (following, own(following))
                new = edited(text, following)
                b = own(new)
                for to, x in zip(out, (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(a), encode(b), resemblance(a, b, k), resemblance(a, last[1], k)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))], names=names)

    return with_next(docs).mapInArrow(run, schema)
