"""What the operators share: tables, cut lineage, gapless numbering, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..steps import cut, drop, shared_folder  # noqa: F401  used as common.cut and so on

#: Java regex: what separates words, and the characters alone.
GAPS = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: A side is broadcast up to this many bytes in memory, by its counted rows; else shuffled.
BROADCAST_BYTES = 4 << 20


#: A table of fewer bytes for each core is dealt out, for a small file is often one row group and so one task.
WORTH_DEALING = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path, cores = f"{sf_dir}/{name}.parquet", spark.sparkContext.defaultParallelism
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    df = spark.read.parquet(path)
    few = size < cores * WORTH_DEALING and df.rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few else df


def small_batches(spark: SparkSession, rows: int = 256, size: int | None = None) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker: rows and, if given, bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fits_broadcast(rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> bool:
    """Whether so many rows may be broadcast: in memory a row takes twice its data and some."""
    return rows * (2 * row_bytes + 32) <= most


def with_size_checked_broadcast(df: DataFrame, row_bytes: int, array: str | None = None, item_bytes: int = 0, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its counted size is small; else have it joined by a shuffle.

    Spark goes by the size of files, which may be a fraction of that of the
    table in memory, so beyond the bound it is told not to broadcast. The data are ``row_bytes`` a row and ``item_bytes`` for each item of the
    column ``array``; as a table in memory a row takes twice that and some.
    """
    return F.broadcast(df) if fits(df, row_bytes, array, item_bytes, most) else df.hint("merge")


def fits(df: DataFrame, row_bytes: int, array: str | None = None, item_bytes: int = 0, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df``, by its counted size, may be broadcast."""
    size = F.count("*") * (2 * row_bytes + 32)
    if array:
        size = size + F.coalesce(F.sum(F.size(array)), F.lit(0)) * item_bytes
    return df.agg(size).first()[0] <= most


def maybe_among(rows: DataFrame, keys: DataFrame, h: str) -> DataFrame:
    """``rows`` without most of those whose long ``h`` is not among ``keys``, before a join on it.

    The keys become a bitmap of 2**25 bits, at most 524,288 rows whatever
    their number, which is broadcast; with very many keys it lets more through.
    """
    word, bit = F.shiftrightunsigned(h, 45), F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def parted(rows: DataFrame, keys: DataFrame, h: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long ``h`` may be among ``keys``, by the bitmap of ``maybe_among``, and the others, which are not."""
    word, bit = F.shiftrightunsigned(h, 45), F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    marked = marked.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")
    return marked.where("_may").drop("_may"), marked.where("not _may").drop("_may")


def with_listed(rows: DataFrame, listed: DataFrame, h: str, row_bytes: int, array: str | None = None, item_bytes: int = 0) -> DataFrame:
    """Left join of ``rows`` with the table ``listed`` on a long ``h``. If that is too large to broadcast, rows that can't be in it stay out of the shuffle."""
    if fits(listed, row_bytes, array, item_bytes):
        return rows.join(F.broadcast(listed), h, "left")
    may, rest = parted(rows, listed, h)
    return may.join(listed.hint("merge"), h, "left").unionByName(rest, allowMissingColumns=True)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that the optimizer computes once, however often lambdas refer to them."""
    made = F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) drawn from a hash, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, per_slice: int = 50_000) -> DataFrame:
    """Number rows 0, 1, 2 ... without gaps within each group, however large the group.

    Rows are dealt to hashed slices of about ``per_slice`` rows; row numbers
    inside a slice are shifted by the counts of the slices before it.
    """
    slices = max(1, -(-df.count() // per_slice))
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*groups).orderBy("_slice")
    starts = (
        dealt.groupBy(*groups, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(before) - F.col("_n"))
        .drop("_n")
    )
    starts = with_size_checked_broadcast(starts, 64)
    inside = Window.partitionBy(*groups, "_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("_rank", F.row_number().over(inside))
    same = F.lit(True)
    for c in [*groups, "_slice"]:
        same = same & ranked[c].eqNullSafe(starts[c])
    keep = [ranked[c] for c in df.columns]
    return ranked.join(starts, same).select(*keep, (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Smallest reachable id of every node: rows (node, component) for edges (a, b) of longs.

    Alternates large-star and small-star steps until the edges stop
    changing; each step is two shuffles, and no component is ever gathered.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct(), label)
    known = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        down = large.where("a > b")
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        stars = (
            down.join(small, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
            .select(F.col("e.x").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = cut(stars, label)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop(now)
        now = after
        if state == known:
            break
        known = state
    node = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return node.union(roots)
