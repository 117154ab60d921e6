"""CSV files of names and labelled pairs, read strictly: all strings, no inference, no ragged rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.functions import text
from fieldweave.operators import quality


class DataValidationError(ValueError):
    """The content of a file is not fit for its use."""


#: From an opening quote's next character to its closing quote; doubled quotes stand for one.
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends within a quoted cell, if it begins within one or not. Only a cell's first character opens."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSING.match(line, at if inside else at + 1)
            if not closed:
                return True
            at, inside = closed.end(), False
        at = line.find(",", at) + 1
        if not at:
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray, np.ndarray]]:
    """(file, block), lines, which of them are blank, places of those with a quote: for each stretch of a block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, lines = batch.columns
        at = block.to_numpy()
        change = np.flatnonzero(at[1:] != at[:-1]) + 1
        named = file.dictionary_encode().indices.to_numpy()
        change = np.union1d(change, np.flatnonzero(named[1:] != named[:-1]) + 1)
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            own = lines.slice(low, high - low)
            blank = pc.or_(pc.equal(own, ""), pc.equal(own, "\r")).to_numpy(zero_copy_only=False)
            yield (file[low].as_py(), int(at[low])), own, blank, np.flatnonzero(pc.match_substring(own, '"').to_numpy(zero_copy_only=False))


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: how many records end in it and whether it ends within a cell, if it begins outside of one or within."""
    found: dict[tuple[str, int], list] = {}
    for key, lines, blank, quoted in _runs(batches):
        told = found.setdefault(key, [[0, False], [0, True]])
        full = np.concatenate(([0], np.cumsum(~blank)))
        texts = lines.take(pa.array(quoted)).to_pylist()
        for state in told:
            done = 0
            for at, text in zip(quoted.tolist(), texts, strict=True):
                if not state[1]:
                    state[0] += int(full[at] - full[done])
                state[1] = ends_inside(text, state[1])
                state[0] += not state[1]
                done = at + 1
            if not state[1]:
                state[0] += int(full[-1] - full[done])
    rows = [(*key, *out, *within) for key, (out, within) in found.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "records", "open", "records_within", "open_within"), r, strict=True)) for r in rows], schema=_STATES)


_STATES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("records", pa.int64()), ("open", pa.bool_()), ("records_within", pa.int64()), ("open_within", pa.bool_())])


def records(spark: SparkSession, path: str) -> DataFrame:
    """source_row, record: the text of each record of a CSV file, numbered from 1; blank lines are none.

    The file is read by blocks, in as many tasks as it has. A first pass tells for each block how many
    records end in it, and within or outside of a quoted cell, whichever way it begins; put together
    from the first block on (a row a block, on the driver), each block knows its state and the number
    of its first record. Records that go over the end of a block are joined from their pieces.
    """
    lines = spark.read.text(str(path), lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    inside, number = False, 1
    for r in sorted(lines.mapInArrow(_block_states, "file string, block long, records long, open boolean, records_within long, open_within boolean").collect(), key=lambda r: (r["file"], r["block"])):
        begins[r["file"], r["block"]] = inside, number
        number += r["records_within"] if inside else r["records"]
        inside = r["open_within"] if inside else r["open"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, row, line = None, False, 0, 0
        for own_key, own, blank, quoted in _runs(batches):
            if own_key != key:
                key, line = own_key, 0
                inside, row = begins[key]
            single, rows, pieces, piece_rows = [], [], [], []
            texts = own.take(pa.array(quoted)).to_pylist()
            done = 0
            for at, text in zip([*quoted.tolist(), len(own)], [*texts, None], strict=True):
                if inside:
                    pieces.append(np.arange(done, at))
                    piece_rows.append(np.full(at - done, row))
                else:
                    some = np.flatnonzero(~blank[done:at]) + done
                    single.append(some)
                    rows.append(np.arange(row, row + len(some)))
                    row += len(some)
                if text is None:
                    break
                was, inside = inside, ends_inside(text, inside)
                to, numbers = (pieces, piece_rows) if was or inside else (single, rows)
                to.append(np.array([at])), numbers.append(np.array([row]))
                row += not inside
                done = at + 1
            for at, number, whole in ((single, rows, True), (pieces, piece_rows, False)):
                at, number = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, number))
                if len(at):
                    arrays = [pa.array(number), pa.array(np.full(len(at), key[1])), pa.array(np.where(whole, -1, line + at)), own.take(pa.array(at))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["source_row", "block", "line", "record"])
            line += len(own)

    pieces = lines.mapInArrow(cut, "source_row long, block long, line long, record string")
    whole = pieces.filter(F.col("line") < 0).select("source_row", "record")
    part = F.array_sort(F.collect_list(F.struct("block", "line", "record")))
    joined = pieces.filter(F.col("line") >= 0).groupBy("source_row").agg(F.array_join(F.transform(part, lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace(F.regexp_replace("record", r"\r$", ""), "^\ufeff", ""))


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """The file's columns as strings (blank: ''), with source_row: the record number, header = 1.

    A missing or repeated column raises ValueError at once; a record of another length makes the job
    fail. Quotes, doubled quotes and line ends in quoted cells are understood; lines end with ``\\n``
    or ``\\r\\n``. All tasks read their blocks of the file (``records``).
    """
    options = {"multiLine": True, "escape": '"', "mode": "FAILFAST"}
    head = spark.read.csv(str(path), header=False, inferSchema=False, **options).first()
    names = [] if head is None else ["" if x is None else x for x in head]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"{path} repeats the columns {', '.join(doubled)}")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    cells = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    told = records(spark, path).filter(F.col("source_row") > 1).select("source_row", F.from_csv("record", cells.simpleString()[7:-1].replace(":", " "), {k: str(v) for k, v in options.items()}).alias("x"))
    return told.select(*[F.coalesce(F.col("x")[f"c{k}"], F.lit("")).alias(n) for k, n in enumerate(names)], "source_row")


def read_raw_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A, B, label and further columns of a raw file, nothing checked but its form."""
    return read_csv(spark, path, ("A", "B", "label"))


def read_fields(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The columns of an inference file; a blank cell raises DataValidationError."""
    rows = read_csv(spark, path, columns).select("source_row", *columns)
    any_blank = F.lit(False)
    for c in columns:
        any_blank = any_blank | text.is_blank(F.col(c))
    blank = rows.filter(any_blank).limit(1).collect()
    if blank:
        raise DataValidationError(f"{path}, record {blank[0]['source_row']}: a blank cell")
    return rows


def check_pairs(rows: DataFrame, context: str, *, allow_empty: bool = False) -> DataFrame:
    """``rows`` (A, B, label, source_row) with canonical labels, norm_a and norm_b, or DataValidationError.

    In this order: blank cells, names empty after normalization, unknown labels, no rows at all,
    contradictory labels of one normalized pair, flags of completeness that are no booleans or differ.
    """
    checked = text.with_normalized(rows.withColumn("label", text.label(F.col("label"))), {"A": "norm_a", "B": "norm_b"})
    found = checked.agg(
        F.count("*").alias("rows"),
        F.count_if(text.is_blank(F.col("A")) | text.is_blank(F.col("B"))).alias("blank"),
        F.count_if((F.col("norm_a") == "") | (F.col("norm_b") == "")).alias("empty"),
        F.count_if(~F.col("label").isin(*text.LABELS)).alias("unknown"),
    ).first()
    for name, what in (("blank", "have a blank A or B"), ("empty", "have a name that is empty after normalization"), ("unknown", "have an unknown label")):
        if found[name]:
            raise DataValidationError(f"{context}: {found[name]} rows {what}")
    if not found["rows"] and not allow_empty:
        raise DataValidationError(f"{context} has no rows")
    clash = quality.contradictions_to_first(checked).collect()
    if clash:
        told = "; ".join(f"row {r['source_row']} says {r['label']}, row {r['first_row']} {r['first_label']}" for r in clash)
        raise DataValidationError(f"{context}: contradictory labels of a normalized pair: {told}")
    if "group_truth_complete" in checked.columns:
        flag = text.strict_boolean(F.col("group_truth_complete"))
        wrong = checked.select(F.col("norm_a"), flag.alias("f")).groupBy("norm_a").agg(F.count_if(F.col("f").isNull()).alias("bad"), F.min("f").alias("low"), F.max("f").alias("high"))
        wrong = wrong.filter((F.col("bad") > 0) | (F.col("low") != F.col("high"))).limit(1).collect()
        if wrong:
            raise DataValidationError(f"{context}: group_truth_complete of {wrong[0]['norm_a']} is not one boolean")
    return checked


def read_labelled(spark: SparkSession, path: str, context: str, *, allow_empty: bool = False) -> DataFrame:
    """A split: A, B, label, source_row, norm_a, norm_b and group_truth_complete if the file has it."""
    try:
        rows = read_csv(spark, path, ("A", "B", "label"))
        kept = ["A", "B", "label", "source_row", *(["group_truth_complete"] if "group_truth_complete" in rows.columns else [])]
        return check_pairs(rows.select(*kept), context, allow_empty=allow_empty)
    except PySparkException as broken:
        raise DataValidationError(f"{context} cannot be read: {str(broken)[:300]}") from broken


def split_path(data_dir: str, split: str, explicit: str | None = None) -> str:
    """The file of a split: the one named explicitly, else its place in the folder."""
    return str(explicit) if explicit else f"{str(data_dir).rstrip('/')}/{split}.csv"
