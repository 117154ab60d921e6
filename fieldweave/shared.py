"""Intermediate tables that outlive lost executors, places in an order, joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of a table, as they are counted, that are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests) gets a temporary folder once; a cluster
    raises, since a folder of the driver's machine would not be seen by its executors.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldweave-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    An executor lost later costs only tasks that read the table, never the work that made it. The
    tables stay until ``release``, since what is computed from them is read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fieldweave-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has settled; how many. Call it when results are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def _width(field: T.StructField) -> Column:
    """Bytes of a value: what its length says, 8 for a number."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.coalesce(F.size(field.name), F.lit(0)), F.lit(0)) * 8 + 16
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its bytes, which are counted, are few enough."""
    width = F.lit(16)
    for field in df.schema:
        width = width + _width(field)
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, best a written table, with ``name``: each row's place (from 0) in the order of the columns.

    The rows are dealt by ranges, so no task sees all of them; a row for each partition, with its
    size, goes to the driver. Ties fall as they come: name columns that tell rows apart.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", at))
    before, seen = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before.append((part, seen))
        seen += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    return placed.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
