"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into only two segments of 32. If two
fingerprints differ in at most three bits, one of the segments differs in at
most one, so it is the same in both once that bit is left out. Each
fingerprint is therefore indexed under its 64 variants (segment, left-out bit,
the other 31 bits); an equality join of the variants finds every candidate and
the distance of the whole fingerprints verifies it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
DISTANCE = 3
#: A variant shared by more distinct fingerprints than this is split once more.
CROWDED = 2048


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles, one for each place; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[starts[i] : ends[i + last]], SEED) for i in range(n)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text's word shingles; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 if there are none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and ``others``, long columns: fp is the fingerprint as a signed long. Null text: no words."""
    names = ["doc_id", *others, "fp"]

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names)

    common.small_batches(docs.sparkSession)
    chosen = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in names[:-1]])
    return chosen.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _variants(classes: DataFrame) -> DataFrame:
    """(key, fp, rep) for the 64 variants of every distinct fingerprint."""
    segments = F.array(
        *[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1)]
    )
    rows = classes.select("fp", "rep", F.explode(segments).alias("g")).select("fp", "rep", "g.s", "g.v")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    return rows.select(_key(F.col("s"), F.col("bit"), F.col("v")).alias("key"), "s", "fp", "rep")


def _key(segment, bit, value):
    kept = value.cast("long").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))
    head = F.expr("shiftleft(cast(s * 32 + bit as long), 32)")
    return head.bitwiseOR(kept)


def _crowded_keys(classes: DataFrame) -> DataFrame:
    """Keys of variants that may be crowded: those of any segment value that itself is."""
    values = classes.select(
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1)])
        ).alias("g")
    ).select("g.s", "g.v")
    hot = values.groupBy("s", "v").count().where(F.col("count") > CROWDED // 2)
    rows = hot.select("s", "v", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    return rows.select(_key(F.col("s"), F.col("bit"), F.col("v")).alias("key")).distinct()


def _spanning(fps: np.ndarray, reps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (larger rep, smaller rep) that connect what is linked inside one variant."""
    order = np.argsort(reps, kind="stable")
    fps, reps, edges = fps[order], reps[order], []
    left = np.arange(len(fps))
    while len(left) > 1:
        head, left = left[0], left[1:]
        open_ = [head]
        while open_ and len(left):
            near = np.bitwise_count(fps[left] ^ fps[open_.pop()]) <= distance
            edges += [(int(reps[i]), int(reps[head])) for i in left[near]]
            open_ += left[near].tolist()
            left = left[~near]
    return edges


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between representatives whose distinct fingerprints differ in few bits.

    Not all pairs: inside one variant only a spanning star of each connected
    part leaves the task, so crowded variants don't grow quadratically. A
    variant with too many fingerprints is dealt out by the bytes of the other
    segment, one of which must be equal within three bits.
    """
    rows = _variants(classes)
    crowded = common.with_size_checked_broadcast(_crowded_keys(classes), 16)
    rows = rows.join(crowded.withColumn("crowded", F.lit(True)), "key", "left")
    other = F.shiftrightunsigned(F.col("fp"), 0)
    byte = [
        F.when(F.col("s") == 0, F.shiftrightunsigned(other, 32 + 8 * i)).otherwise(F.shiftrightunsigned(other, 8 * i)).bitwiseAND(255) + 256 * i
        for i in range(4)
    ]
    parts = F.when(F.col("crowded"), F.array(*byte)).otherwise(F.array(F.lit(-1).cast("long")))
    rows = rows.select("key", F.explode(parts).alias("part"), "fp", "rep")

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            if not len(new):
                held = now
                continue
            held = [x[new[-1] :] for x in now]
            yield found([x[: new[-1]] for x in now], new[:-1])
        if held is not None:
            yield found(held, np.zeros(0, np.int64))

    def found(rows, new):
        starts, ends = np.r_[0, new], np.r_[new, len(rows[0])]
        fps, reps = rows[2].view(np.uint64), rows[3]
        size, edges = ends - starts, []
        two = starts[size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        a, b = np.maximum(reps[near], reps[near + 1]), np.minimum(reps[near], reps[near + 1])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            edges += _spanning(fps[s:e], reps[s:e], distance)
        more = np.array(edges, np.int64).reshape(-1, 2)
        pairs = np.unique(np.stack([np.r_[a, more[:, 0]], np.r_[b, more[:, 1]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    spark = classes.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    return common.cut(dealt.mapInArrow(run, "a long, b long").distinct(), "simhash-links")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = DISTANCE, others: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fp, component_id) and ``others``, long columns; component_id: the smallest doc_id reachable over links.

    Null or blank texts have fingerprint 0 and link like any other; rows with
    a null doc_id get their class's smallest id (null if it has none). Equal
    fingerprints are one class throughout; repeated rows stay repeated. Other
    columns are ignored. An empty table gives an empty result.
    """
    prints = common.cut(fingerprints(docs, shingle, others), "simhash")
    grouped = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = common.cut(grouped.where("rep is not null"), "simhash-classes")
    edges = links(classes, distance)
    labels = common.components(edges, "simhash-components")
    small = classes.join(labels, classes["rep"] == labels["node"], "left")
    ids = small.select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(ids, prints["fp"] == ids["_fp"], "left").select("doc_id", *others, "fp", "component_id")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _k1 and _k2, by which a row is known."""
    key = F.struct("doc_id", "text")
    return docs.withColumns({"_k1": F.xxhash64(key), "_k2": F.xxhash64(F.lit(1), key)})


def firsts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows``, which are keyed, without all but the smallest doc_id of each group of ``found`` (g, none, doc_id, _k1, _k2)."""
    found = found.select("g", "none", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k1", "_k2").alias("row"))
    first = found.groupBy("g", "none").agg(F.min("row").alias("first"))
    marked = found.groupBy("g", "none", "row").agg(F.count("*").alias("n")).join(first, ["g", "none"])
    marked = common.cut(marked.select("row._k1", "row._k2", "n", (F.col("row") == F.col("first")).alias("stays")), "marked")
    stays, gone = marked.where("stays"), marked.where("not stays").select("_k1", "_k2")
    out = rows.join(common.with_size_checked_broadcast(gone, 32), ["_k1", "_k2"], "left_anti")
    again = stays.where("n > 1").select("_k1", "_k2")
    if again.head(1):  # the same row several times
        again = common.with_size_checked_broadcast(again, 32)
        several = out.join(again, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
        out = out.join(again, ["_k1", "_k2"], "left_anti").unionByName(several)
    return out.drop("_k1", "_k2")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id."""
    rows = keyed(docs)
    found = common.cut(near_duplicates(rows, shingle, distance, ("_k1", "_k2")), "near-duplicates")
    # a group without any doc_id is known by its fingerprint
    g = F.when(F.col("component_id").isNull(), F.xxhash64("fp")).otherwise(F.col("component_id"))
    return firsts(rows, found.select(g.alias("g"), F.col("component_id").isNull().alias("none"), "doc_id", "_k1", "_k2")).select(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
