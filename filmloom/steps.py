"""Tables between steps, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables are broadcast up to this many bytes of rows, counted or measured.
BROADCAST_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set: the warehouse, or in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="filmloom-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/filmloom-steps"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step", compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``compression`` is the session's if not given.

    The lineage ends there, so a lost executor costs no recomputation of
    what lies before, and values drawn before stay as they are.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def joined_by_real_size(spark: SparkSession) -> Iterator[None]:
    """Within it what runs broadcasts no table for the size of its files, only if marked or if a shuffle has measured that it is small.

    Numbers in order take a byte or less in a file and a hundred in a table
    that the driver makes for a broadcast.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (static, measured)}
    spark.conf.set(measured, before[measured] or ("-1" if (before[static] or "").startswith("-") else str(BROADCAST_BYTES)))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def few(df: DataFrame) -> DataFrame:
    """``df``, a table between steps with narrow rows, marked for broadcast if a count says that it is small."""
    return F.broadcast(df) if df.count() * (16 * len(df.columns) + 32) <= BROADCAST_BYTES else df


def drop(*frames: DataFrame) -> None:
    """Remove the tables that ``cut`` wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
