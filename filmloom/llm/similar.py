"""SimHash near-dedup by deletion-variant signatures, with a wanted Jaccard similarity of word shingles.

Texts whose SimHash fingerprints differ in three bits at most are found by
the variants of ``simhash`` and verified on the whole sets of shingles: what
they link is done. That reaches down to a similarity of about 0.98. Pairs of
0.8 differ in about ten bits, sixteen and more in some, and segments short
enough for that are shared by chance. So the rest, texts that no fingerprint
has linked yet, is looked for in bands of least hashes: two texts meet if in
one of ``BANDS`` bands all ``ROWS`` least hashes agree, which a pair of
similarity 0.8 misses with probability 6e-7 (0.9: 2e-14). These are verified
alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 36, 5
#: Pairs with the same second text are verified in slices of this many.
SLICE = 256

_drawn = np.random.default_rng(42).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
_FACTOR, _SHIFT, _MIX = _drawn[0] * np.uint64(2) + np.uint64(1), _drawn[1], _drawn[2] * np.uint64(2) + np.uint64(1)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; empty if it has no word."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's bands; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return (least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + _BAND


def similar(common_size, size_a, size_b, least: float):
    """Whether sets share ``least`` of their union, at 1e-9."""
    return common_size >= (least - 1e-9) * (size_a + size_b - common_size)


def _prints(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, _k1, _k2, fp, sim, bands): fp is a hash of the whole set, 0 for no word; sim the text's SimHash."""
    names = ["doc_id", "_k1", "_k2"]

    def run(batches):
        for batch in batches:
            hashes = [simhash.shingle_hashes(t, shingle) for t in batch.column(0).to_pylist()]
            sets = [np.unique(x) for x in hashes]
            sims = np.array([simhash.majority(x) for x in hashes], np.uint64)
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) if len(s) else 0 for s in sets], np.uint64)
            keys = [bands(s) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            made = [pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), held]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*names, "fp", "sim", "bands"])

    common.small_batches(rows.sparkSession)
    chosen = rows.select(F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in names])
    return chosen.mapInArrow(run, "doc_id long, _k1 long, _k2 long, fp long, sim long, bands array<long>")


def by_fingerprint(classes: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """Pairs (a, b) of classes (fp, sim) that connect all whose SimHash differs in ``distance`` bits at most, b the smaller."""
    named = classes.where("fp <> 0").select("sim", "fp")
    heads = common.cut(named.groupBy("sim").agg(F.min("fp").alias("rep")), "simhash-classes")
    near = simhash.links(heads.select(F.col("sim").alias("fp"), "rep"), distance)
    common.small_batches(classes.sparkSession)  # links takes batches of numbers, what follows whole texts
    same = named.join(heads, "sim").where("fp <> rep").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    return common.cut(same.union(near).distinct(), "simhash-pairs")


def _unlinked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are not in one component yet."""
    for side in ("a", "b"):
        of = common.with_size_checked_broadcast(labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), 24)
        pairs = pairs.join(of, side, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _sets(rows: DataFrame, prints: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, items): the sets of the wanted classes, each from one of its texts."""
    one = prints.join(common.with_size_checked_broadcast(wanted, 16), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("_k1", "_k2")).alias("k"))
    one = common.with_size_checked_broadcast(common.cut(one.select("fp", "k._k1", "k._k2"), "similar-texts"), 32)
    texts = rows.select("_k1", "_k2", "text").join(one, ["_k1", "_k2"]).select("fp", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            items = [shingles(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["fp", "items"])

    return common.cut(texts.mapInArrow(run, "fp long, items binary").dropDuplicates(["fp"]), "similar-sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar. A frequent b is dealt out in slices of its pairs."""
    slices = pairs.groupBy("b").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    slices = common.with_size_checked_broadcast(common.cut(slices, "similar-slices"), 24)
    left = pairs.join(slices, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("slices")).alias("slice"))
    left = left.join(sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a")
    right = sets.join(slices, F.col("fp") == F.col("b")).select("b", F.col("items").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    met = left.join(right, ["b", "slice"]).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= (least - 1e-9) * max(len(x), len(y)) else 0
                near.append(similar(both, len(x), len(y), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def block_links(some: list[tuple], members: list[tuple], least: float) -> set[tuple[int, int]]:
    """Similar pairs of ``some`` and ``members`` (fp, g, set) of different groups, one at least of each for every group that has any."""
    fps, groups, sets = zip(*members)
    fps, groups, sizes = np.array(fps), np.array(groups), np.array([len(s) for s in sets])
    owner, items, edges = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), set()
    for fp, g, own in some:
        both = np.bincount(owner[np.isin(items, own)], minlength=len(sets))
        near = np.flatnonzero(similar(both, sizes, len(own), least) & (groups != g))
        _, firsts = np.unique(groups[near], return_index=True)
        edges |= {(fp, int(fps[j])) for j in near[firsts]}
    return edges


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Similar pairs (a, b) of the buckets of three and more whose texts are not all linked yet.

    Texts outside a bucket's largest linked group are compared with all of its
    texts, in blocks of ``SLICE`` by ``SLICE``, so no bucket is too large for a task.
    """
    labels = common.with_size_checked_broadcast(labels.withColumnRenamed("node", "fp"), 24)
    named = common.cut(members.join(labels, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("g")), "similar-members")
    each = named.groupBy("key", "g").agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("y"))
    buckets = each.groupBy("key").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "g")).alias("top"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    slices, rest = F.ceil(F.col("n") / SLICE).alias("across"), F.ceil((F.col("n") - F.col("top.n")) / SLICE).alias("down")
    # bands often hold the same texts, which need one look
    left = buckets.where("n > 2 and groups > 1").groupBy("n", "x", "y").agg(F.min(F.struct("key", F.col("top.g").alias("top"), slices, rest)).alias("b"))
    left = common.with_size_checked_broadcast(common.cut(left.select("b.*"), "similar-buckets"), 40)
    held = named.join(left, "key").join(sets, "fp")
    at, none = F.xxhash64("fp"), F.lit(0).cast("long")

    def blocks(side, own, other):
        return held.select("key", "fp", "g", "top", "items", F.lit(side).alias("side"), F.pmod(at, F.col(own)).alias(own), F.explode(F.sequence(none, F.col(other) - 1)).alias(other))

    dealt = blocks(1, "across", "down").unionByName(blocks(0, "down", "across").where("g <> top"))
    dealt = dealt.repartition("key", "across", "down").sortWithinPartitions("key", "across", "down", "side").select("key", "across", "down", "side", "fp", "g", "items")

    def run(batches):
        now, some, all_ = None, [], []
        for batch in batches:
            done = set()
            for *block, side, fp, g, items in zip(*[c.to_pylist() for c in batch.columns]):
                if block != now:
                    done |= block_links(some, all_, least) if some and all_ else set()
                    now, some, all_ = block, [], []
                (all_ if side else some).append((fp, g, np.frombuffer(items, np.uint64)))
            yield made(done)
        yield made(block_links(some, all_, least) if some and all_ else set())

    def made(edges):
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each group linked by a Jaccard similarity of ``least`` or more.

    Texts without a word are one group. Pairs of close fingerprints are
    verified first. Of each bucket every text not linked to the bucket's first
    by these is verified against it, then those not linked by that against all
    others, so a bucket of near copies costs no more than its texts. Null
    texts have no word; repeated rows are copies; ties go to the smaller hash.
    An empty table gives an empty result.
    """
    rows = simhash.keyed(docs)
    prints = common.cut(_prints(rows, shingle), "similar")
    classes = common.cut(prints.select("fp", "sim", "bands").dropDuplicates(["fp"]), "similar-classes")
    close = by_fingerprint(classes)
    keys = classes.select(F.explode("bands").alias("key"), "fp")
    buckets = keys.groupBy("key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    buckets = common.with_size_checked_broadcast(common.cut(buckets, "similar-heads"), 24)
    members = common.cut(keys.join(buckets, "key"), "similar-members")
    pairs = common.cut(members.where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct(), "similar-pairs")
    wanted = members.select("fp").union(close.select("a")).union(close.select("b")).distinct()
    sets = _sets(rows, prints, wanted, shingle)
    linked = common.cut(_verified(close, sets, least), "similar-links")
    rest = common.cut(_unlinked(pairs, common.components(linked, "simhash-components")), "similar-rest")
    edges = linked.union(common.cut(_verified(rest, sets, least), "similar-links"))
    labels = common.components(edges, "similar-components")
    more = common.cut(_across(members, labels, sets, least), "similar-links")
    if more.head(1):
        labels = common.components(edges.union(more), "similar-components")
    labels = common.with_size_checked_broadcast(labels.withColumnRenamed("node", "fp"), 24)
    found = prints.join(labels, "fp", "left").select(F.coalesce("component", "fp").alias("g"), F.lit(False).alias("none"), "doc_id", "_k1", "_k2")
    return simhash.firsts(rows, common.cut(found, "similar-found")).select(*docs.columns)
