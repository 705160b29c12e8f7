"""Files by path or address, for tasks that read or write a few bytes of their own."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it; Spark writes file: with one slash or three."""
    local = re.sub(r"^file:/+", "/", path)
    if not re.match(r"[a-z][a-z0-9+.-]+:", local):
        return fs.LocalFileSystem(), local.rstrip("/")
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the address of Spark's default store, for tasks, whose own default may be another."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def exists(path: str) -> bool:
    store, inside = located(path)
    return store.get_file_info(inside).type != fs.FileType.NotFound


def whole(path: str) -> bytes:
    store, inside = located(path)
    with store.open_input_stream(inside) as f:
        return f.read()


def head(path: str, size: int) -> bytes:
    """The first bytes of a file, and no more of it."""
    store, inside = located(path)
    with store.open_input_file(inside) as f:
        return f.read_at(min(size, f.size()), 0)
