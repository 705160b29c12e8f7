"""What lies in a folder tree: films, folders of stills, fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import pairing
from . import files


def listing(spark: SparkSession, root: str, addresses: bool = False) -> DataFrame:
    """path, size, modified of every file below ``root``; contents stay unread. Paths come without the store's address unless asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path") if addresses else F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    return found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def clips(found: DataFrame, root: str, recursive: bool = True, skip: tuple[str, ...] = ()) -> DataFrame:
    """Clips (path, is_dir, key): films, and folders of stills, which are not looked into; ordered by lower path.

    What lies below a folder of ``skip``, as an earlier run's output, is left out.
    """
    base = root.rstrip("/")
    kept = found.where(F.startswith("path", F.lit(base + "/")))
    for s in skip:
        kept = kept.where(~F.startswith("path", F.lit(s.rstrip("/") + "/")))
    if not recursive:
        depth = F.size(F.split(F.expr(f"substring(path, {len(base) + 2})"), "/"))
        still = strings.suffix(F.col("path")).isin(*pairing.STILL_SUFFIXES)
        kept = kept.where((depth == 1) | (still & (depth == 2)))
    folders = pairing.is_sequence(kept).where(F.col("folder") != base).select(F.col("folder").alias("path"), F.lit(True).alias("is_dir"))
    films = kept.where(strings.suffix(F.col("path")).isin(*pairing.FILM_SUFFIXES))
    parents = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(2))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/")
    )
    inside = films.select("path", F.explode(parents).alias("_up")).join(folders.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    films = films.join(inside, "path", "left_anti").select("path", F.lit(False).alias("is_dir"))
    return films.union(folders).withColumn("key", pairing.clip_key(F.col("path"), F.col("is_dir"))).orderBy(F.lower("path"))


def fingerprints(spark: SparkSession, root: str, head: int = 1 << 20) -> DataFrame:
    """path -> 16 hex digits of size, whole second of change and the first ``head`` bytes, of which no more are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)

    @F.pandas_udf("binary")
    def starts(path: pd.Series) -> pd.Series:
        return path.map(lambda p: files.head(p, head))

    about = F.encode(F.concat_ws("|", F.col("length").cast("string"), F.unix_seconds("modificationTime").cast("string")), "UTF-8")
    made = F.sha2(F.concat(about, starts("path")), 256)
    return found.select(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "").alias("path"), F.substring(made, 1, 16).alias("fingerprint"))
