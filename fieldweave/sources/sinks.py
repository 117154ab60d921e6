"""Files that leave the engine: CSV, JSON, a set of them published together."""

from __future__ import annotations

import json
import logging
import os
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_csv(df: DataFrame, path: str, *, one_file: bool = True) -> None:
    """Header, all columns, ``\\n`` line ends. ``one_file``: a plain file at ``path`` (one task writes
    it, as one file must be); otherwise a folder of part files, written by all tasks."""
    spark = df.sparkSession
    options = {"header": True, "emptyValue": "", "nullValue": "", "escape": '"', "lineSep": "\n"}
    if not one_file:
        df.write.mode("overwrite").csv(str(path), **options)
        return
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    df.coalesce(1).write.csv(folder, **options)
    fs, place = _fs(spark, folder)
    part = next(s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(place, True)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    fs, place = _fs(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def _plain(value: Any) -> Any:
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, Path):
        return str(value)
    raise TypeError(f"{type(value).__name__} has no JSON form")


def to_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False, default=_plain) + "\n"


#: The record that a set of files is complete and on its way to its places.
COMMIT = ".commit.json"


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Puts ``source`` in the place of ``target``: a file at once, so that there is always one; a folder after the old one is gone."""
    fs, place = _fs(spark, target)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = fs.getFileStatus(hadoop.Path(source)).isDirectory()
    if folder or fs.exists(place) and fs.getFileStatus(place).isDirectory():
        fs.delete(place, True)
        fs.rename(hadoop.Path(source), place)
    elif fs.getUri().getScheme() == "file":
        plain = lambda p: hadoop.Path.getPathWithoutSchemeAndAuthority(hadoop.Path(p)).toString()
        fs.delete(hadoop.Path(place.getParent(), f".{place.getName()}.crc"), False)  # of the old content
        os.replace(plain(source), plain(target))
    else:
        options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.Path(source), place, options)


def _commit_record(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    fs, place = _fs(spark, f"{folder}/{COMMIT}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def roll_forward(spark: SparkSession, folder: str) -> bool:
    """Ends a publication that was stopped after its record was written; whether there was one."""
    folder = str(folder).rstrip("/")
    record = _commit_record(spark, folder)
    if record is None:
        return False
    staging = f"{folder}/{record['staging']}"
    for name in record["files"]:
        if _exists(spark, f"{staging}/{name}"):  # else it is in its place already
            _replace(spark, f"{staging}/{name}", f"{folder}/{name}")
    fs, place = _fs(spark, f"{folder}/{COMMIT}")
    fs.delete(place, False)
    fs.delete(_fs(spark, staging)[1], True)
    return True


def current(spark: SparkSession, folder: str, name: str) -> str:
    """Where a file of the last complete publication is, also while it is on its way to its place."""
    folder = str(folder).rstrip("/")
    record = _commit_record(spark, folder)
    waiting = f"{folder}/{record['staging']}/{name}" if record and name in record["files"] else None
    return waiting if waiting and _exists(spark, waiting) else f"{folder}/{name}"


def publish(spark: SparkSession, folder: str, files: Mapping[str, Callable[[str], None]]) -> None:
    """The files as one set: all are written aside, a record says that they are complete, then each takes its place.

    Stopped before the record the old set stays; stopped later, ``current`` finds the new set, and
    ``roll_forward`` (which every publication begins with) ends the work. A file's place is never
    empty in between, except that of a folder of part files.
    """
    folder = str(folder).rstrip("/")
    fs, place = _fs(spark, folder)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(place)
    roll_forward(spark, folder)
    for left in fs.listStatus(place):  # of publications stopped before their record
        if left.getPath().getName().startswith(".staging-"):
            fs.delete(left.getPath(), True)
    staging = f".staging-{uuid.uuid4().hex}"
    fs.mkdirs(hadoop_path(f"{folder}/{staging}"))
    try:
        for name, write in files.items():
            write(f"{folder}/{staging}/{name}")
        write_text(spark, f"{folder}/{staging}/{COMMIT}", json.dumps({"staging": staging, "files": list(files)}))
        if not fs.rename(hadoop_path(f"{folder}/{staging}/{COMMIT}"), hadoop_path(f"{folder}/{COMMIT}")):
            raise RuntimeError(f"{folder}: another publication is on its way")
    except BaseException:
        fs.delete(hadoop_path(f"{folder}/{staging}"), True)
        raise
    roll_forward(spark, folder)


def run_directory(parent: str | Path) -> Path:
    """A new folder named by the time; a second one of the same second gets a number."""
    parent, stamp = Path(parent), datetime.now().strftime("run_%Y%m%d_%H%M%S")
    parent.mkdir(parents=True, exist_ok=True)
    for n in range(1000):
        place = parent / (stamp if not n else f"{stamp}_{n:02d}")
        try:
            place.mkdir()
            return place
        except FileExistsError:
            continue
    raise RuntimeError("no free run directory")


def log_to(path: str | Path | None = None) -> logging.Logger:
    """The package's logger, to the console and, if named, a file."""
    log = logging.getLogger("fieldweave")
    log.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    if path is not None:
        log.addHandler(logging.FileHandler(path, encoding="utf-8"))
    for handler in log.handlers:
        handler.setFormatter(form)
    return log
