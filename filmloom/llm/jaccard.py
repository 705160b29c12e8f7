"""Joining texts by the Jaccard similarity of their word shingles, with signature trees.

A set of x shingles shares at least c with any similar one among the first
x - ceil(0.8 x) + c of both, in any order of all shingles. In the order taken
here those known to be frequent come last, the most frequent at the very end.
Only sets of whose first shingles others have as many as that can be similar to
any; they are the leaves of the forest.

Leaves lie sorted by size band and first shared shingle in blocks, which are the
lowest nodes that Spark sees: each holds the OR of its sets' bitmaps, its range of sizes
and the excess, by which at most a set's shingles outnumber its bits. Sixteen
nodes have a parent. Two nodes' sets have in common at most the bits that both
bitmaps have and the smaller excess; where that or the sizes fall short of what
similar sets need, the pair of nodes is pruned. Traversal goes down from pairs of
nodes that hold a common first shingle to pairs of blocks. A task gets of two
blocks the sets with such a shingle, builds trees of eight children a node over
them, goes down both in the same way and verifies the pairs of leaves on the
whole sets; pairs already connected are passed over. Nothing else finds pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash


@dataclass(frozen=True)
class Jaccard:
    """Shingles of ``shingle`` words; sets are linked if ``of`` times what they share reaches ``share`` times their union."""

    shingle: int = 5
    share: int = 80
    of: int = 100

    def first(self, n: int) -> int:
        """How many first shingles of a set of ``n`` are looked at: one in fifty more than needed to share one."""
        return min(n, n - -(-self.share * n // self.of) + 1 + n // 50)

    def least(self, n):
        """How many of these any similar set, which may be smaller, has among its own; a number or a column."""
        return F.floor(F.ceil(n * self.share / self.of) / 50) + 1 if isinstance(n, Column) else -(-self.share * n // self.of) // 50 + 1

    def similar(self, both, a, b):
        return self.of * both >= self.share * (a + b - both)

    def possible(self, both, low_a, low_b, high_a, high_b):
        """Whether sets of these size ranges that share ``both`` at most can be similar; numbers, arrays or columns."""
        return (both * (self.share + self.of) >= (low_a + low_b) * self.share) & (high_a * self.of >= low_b * self.share) & (high_b * self.of >= low_a * self.share)


SEED = 42
#: Frequent shingles known to all tasks: so many at most, counted in chunks of so many shingles.
FREQUENT, CHUNK = 1 << 18, 1 << 20
#: A block holds sets of so many shingles together, small sets counting as ``LIGHT``.
LOAD, LIGHT = 1 << 20, 1 << 11
#: Children of a node among blocks (a power of two) and in a task; nodes of a level that are paired at once.
FAN_BITS, FAN, AT_ONCE = 4, 8, 64
#: 64-bit words of a block's bitmap.
WORDS = 32
#: Entries that a task deals out at once; of a bucket, about so many are compared in a task.
ENTRIES, BUCKET = 1 << 18, 1 << 21
#: A side of a join is broadcast up to so many bytes in memory, by its counted rows: what it meets are texts or many shingles.
BROADCAST = 16 << 20
#: Bytes of a text that are split at once, and of a batch; words whose hashes a task knows.
PIECE, BATCH, WORDS_KNOWN = 1 << 22, 1 << 22, 1 << 17

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words, so many at most."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, words: Words, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of the whole sequence if it has fewer words; empty without words.

    A shingle's hash is a sum of its words' hashes, each times an odd factor of its place.
    """
    parts, at = [], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        some = raw[at:end].lower().split()
        parts.append(np.fromiter(map(words.__getitem__, some), np.uint64, len(some)))
        at = end
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    total = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(size, len(h))):
        total += h[i : i + n] * _FACTORS[i]
    return np.unique(_mixed(total))


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    return common.with_size_checked_broadcast(df, row_bytes, most=BROADCAST)


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """The bits that the tokens hash to, as 64-bit words."""
    bits = np.zeros(words * 64, np.uint8)
    bits[(tokens >> np.uint64(11)) % np.uint64(words * 64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _raw(docs: DataFrame):
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def frequent(docs: DataFrame, how: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted, rank from 1 by how often they are said): those that different sets of a task's chunk share.

    What is left out changes the order in which sets are looked at, not the result, so the number
    of these can be bounded.
    """

    def run(batches):
        words, held, size, seen = Words(), [], 0, set()

        def told():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often])], ["token", "n"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                tokens = shingle_set(raw, words, how.shingle)
                fp = hash(tokens.tobytes())
                if len(tokens) and fp not in seen:
                    seen.add(fp)
                    held.append(tokens)
                    size += len(tokens)
                if size > CHUNK:
                    yield told()
                    held, size, seen = [], 0, set()
        if held:
            yield told()

    common.small_batches(docs.sparkSession, size=BATCH)
    counted = docs.select(_raw(docs)).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    tokens = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int64)


def first_shingles(tokens: np.ndarray, known: tuple[np.ndarray, np.ndarray], how: Jaccard) -> np.ndarray:
    """The first of a set's tokens in the order of all: those not known as frequent by hash, then the others by rank."""
    n = how.first(len(tokens))
    names, ranks = known
    if not len(names) or not len(tokens):
        return tokens[:n]
    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
    rank = np.where(names[at] == tokens, ranks[at], 0)
    return tokens[np.lexsort((tokens, rank))[:n]] if rank.any() else tokens[:n]


def _prints(rows: DataFrame, known, how: Jaccard) -> DataFrame:
    """(doc_id, _k1, _k2, fp, n, firsts): fp is a hash of the whole set, 0 without words."""
    names = ["doc_id", "_k1", "_k2"]
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        words = Words()
        for batch in batches:
            sets = [shingle_set(raw, words, how.shingle) for raw in batch.column(0).to_pylist()]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64)
            firsts = [first_shingles(s, shared.value, how) if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), held], [*names, "fp", "n", "firsts"])

    common.small_batches(rows.sparkSession, size=BATCH)
    chosen = rows.select(_raw(rows), *[F.col(c).cast("long").alias(c) for c in names])
    return chosen.mapInArrow(run, "doc_id long, _k1 long, _k2 long, fp long, n long, firsts array<long>")


def _entries(batches, chosen):
    """(tokens, fps) of all first shingles that ``chosen`` (tokens to booleans) takes, in parts of about ``ENTRIES``."""
    tokens, fps, held, seen = [], [], 0, set()
    for batch in batches:
        ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
        for fp, a, b in zip(batch.column(0).to_numpy(), ends[:-1], ends[1:]):
            if fp in seen:  # equal texts of a task
                continue
            seen.add(fp)
            own = flat[a:b][chosen(flat[a:b].view(np.uint64))]
            tokens.append(own)
            fps.append(np.full(len(own), fp))
            held += len(own)
        if held > ENTRIES:
            yield np.concatenate(tokens), np.concatenate(fps)
            tokens, fps, held, seen = [], [], 0, set()
    if held:
        yield np.concatenate(tokens), np.concatenate(fps)


def _shared(prints: DataFrame, known: tuple[np.ndarray, np.ndarray], how: Jaccard) -> DataFrame:
    """(token, fp, n): the first shingles that several sets have, of the sets that have enough of them.

    Shingles known as frequent are in several sets. The others are, in each
    task's chunks, in one set each, so they are as often as there are chunks at
    most; they are dealt out in buckets, many in a row, and compared there.
    """
    spark = prints.sparkSession
    names = spark.sparkContext.broadcast(known[0])

    def is_known(tokens):
        at = np.minimum(np.searchsorted(names.value, tokens), max(0, len(names.value) - 1))
        return names.value[at] == tokens if len(names.value) else np.zeros(len(tokens), bool)

    rows = prints.where("n > 0").select("fp", "firsts")
    total = rows.agg(F.sum(F.size("firsts"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))

    def often(batches):
        for tokens, fps in _entries(batches, is_known):
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(fps)], ["token", "fp"])

    def deal(batches):
        for tokens, fps in _entries(batches, lambda t: ~is_known(t)):
            bucket = (_mixed(tokens.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, fps = bucket[order], tokens[order], fps[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [[x[s:e].tobytes() for s, e in zip(cuts, [*cuts[1:], len(bucket)])] for x in (tokens, fps)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *(pa.array(x, pa.binary()) for x in parts)], ["bucket", "tokens", "fps"])

    def several(parts):
        tokens, fps = (np.frombuffer(b"".join(x), np.int64) for x in zip(*parts))
        order = np.lexsort((fps, tokens))
        tokens, fps = tokens[order], fps[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (fps[1:] != fps[:-1])]
        tokens, fps = tokens[new], fps[new]
        same = tokens[1:] == tokens[:-1]
        kept = np.r_[False, same] | np.r_[same, False]
        return pa.RecordBatch.from_arrays([pa.array(tokens[kept]), pa.array(fps[kept])], ["token", "fp"])

    def met(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, tokens, fps in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != now and parts:
                    yield several(parts)
                    parts = []
                now = bucket
                parts.append((tokens, fps))
        if parts:
            yield several(parts)

    common.small_batches(spark, 2048, BATCH)
    dealt = rows.mapInArrow(deal, "bucket int, tokens binary, fps binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(met, "token long, fp long").unionByName(rows.mapInArrow(often, "token long, fp long"))
    found = common.cut(found, "jaccard-keys")
    sizes = prints.where("n > 0").select("fp", "n").distinct()
    # a frequent shingle of a set comes once from every task that has the set, so sets may look to have more than they do
    wanted = found.groupBy("fp").agg(F.count("*").alias("k"))
    wanted = wanted.join(sizes, "fp").where(F.col("k") >= how.least(F.col("n"))).select("fp", "n")
    wanted = _small(common.cut(wanted, "jaccard-wanted"), 16)
    return common.cut(common.maybe_among(found, wanted, "fp").join(wanted, "fp").select("token", "fp", "n").distinct(), "jaccard-keys")


def _blocks(keys: DataFrame, how: Jaccard) -> DataFrame:
    """(fp, n, block): sets in the order of size band and first shared shingle, cut into blocks that are numbered in that order."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(how.of / how.share)))
    rows = keys.groupBy("fp").agg(F.min("token").alias("at"), F.first("n").alias("n")).withColumn("band", band)
    inorder = common.cut(rows, "jaccard-order").repartitionByRange("band", "at", "fp").sortWithinPartitions("band", "at", "fp")

    def run(batches):
        load, band, block = 0, None, -1
        for batch in batches:
            out = []
            for b, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if b != band or load >= LOAD:
                    load, band, block = 0, b, block + 1
                load += max(n, LIGHT)
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.int64())], ["fp", "n", "part", "at"])

    parts = inorder.select("band", "fp", "n", F.spark_partition_id().alias("part")).mapInArrow(run, "fp long, n long, part int, at long")
    placed = common.cut(parts, "jaccard-parts")
    sizes = placed.groupBy("part").agg(F.max("at") + 1).collect()  # one row a partition
    offset, starts = 0, []
    for part, n in sorted(map(tuple, sizes)):
        starts.append((part, offset))
        offset += n
    # an Arrow table: rows of Python objects would have each executor start further Python workers for them, which stay
    starts = keys.sparkSession.createDataFrame(pa.table(list(zip(*starts)) or [[], []], pa.schema([("part", pa.int32()), ("start", pa.int64())])))
    return common.cut(placed.join(F.broadcast(starts), "part").select("fp", "n", (F.col("start") + F.col("at")).alias("block")), "jaccard-blocks")


def _leaves(rows: DataFrame, prints: DataFrame, placed: DataFrame, how: Jaccard) -> DataFrame:
    """(block, fp, n, items, bits): the sets of the placed classes, each read anew from one of its texts, with its bitmap."""
    kept = common.maybe_among(prints.select("fp", "_k1", "_k2"), placed, "fp").groupBy("fp").agg(F.min(F.struct("_k1", "_k2")).alias("k"))
    one = common.cut(placed.join(kept, "fp").select("block", "fp", "n", "k._k1", "k._k2"), "jaccard-texts")
    near = common.maybe_among(rows.select("_k1", "_k2", _raw(rows)), one, "_k1")
    texts = near.join(_small(one, 48), ["_k1", "_k2"])

    def run(batches):
        words = Words()
        for batch in batches:
            sets = [shingle_set(raw, words, how.shingle) for raw in batch.column(3).to_pylist()]
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate([bitmap(t, WORDS) for t in sets]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t.tobytes() for t in sets], pa.binary()), maps], ["block", "fp", "n", "items", "bits"])

    common.small_batches(rows.sparkSession, size=BATCH)
    sets = common.cut(texts.select("block", "fp", "n", "text").mapInArrow(run, "block long, fp long, n long, items binary, bits array<long>"), "jaccard-sets")
    if sets.count() > one.count():  # the same row several times
        sets = common.cut(sets.dropDuplicates(["fp"]), "jaccard-sets")
    return sets


def _nodes(sets: DataFrame) -> DataFrame:
    """(block, bits, low, high, excess): the union of a block's bitmaps, its sizes, and by how much a set may outnumber its bits."""
    ones = F.aggregate("bits", F.lit(0), lambda n, w: n + F.bit_count(w))
    held = sets.select("block", "bits", F.col("n").alias("low"), F.col("n").alias("high"), (F.col("n") - ones).alias("excess"))
    return common.cut(_united(held), "jaccard-nodes")


def _united(nodes: DataFrame) -> DataFrame:
    bits = F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in range(WORDS)]).alias("bits")
    return nodes.groupBy("block").agg(bits, F.min("low").alias("low"), F.max("high").alias("high"), F.max("excess").alias("excess"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up."""
    return _united(nodes.withColumn("block", F.shiftright("block", FAN_BITS)))


def _pruned(pairs: DataFrame, nodes: DataFrame, how: Jaccard) -> DataFrame:
    """Those of the pairs (token, a, b) of nodes whose sets may be similar."""
    cols = ["bits", "low", "high", "excess"]
    small = _small(nodes, 8 * WORDS + 56)
    one, other = (small.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    both = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, c: n + c)
    most = F.least(both + F.least("excess_a", "excess_b"), "high_a", "high_b")
    each = pairs.select("a", "b").distinct().join(one, "a").join(other, "b")
    each = each.where(how.possible(most, *[F.col(c) for c in ("low_a", "low_b", "high_a", "high_b")])).select("a", "b")
    each = common.cut(each, "jaccard-node-pairs")
    return pairs.join(_small(each, 16), ["a", "b"], "left_semi").select("token", "a", "b")


def block_pairs(at: DataFrame, nodes: DataFrame, how: Jaccard) -> DataFrame:
    """(token, a, b), a <= b: pairs of blocks that hold the token and may hold similar sets.

    ``at`` is (token, block, sets). A token of very many blocks starts at the
    level where it is in at most ``AT_ONCE`` nodes and is followed down.
    """
    levels = [(common.cut(at, "jaccard-at"), nodes)]
    while True:
        wide = levels[-1][0].groupBy("token").agg(F.count("*").alias("nodes")).where(F.col("nodes") > AT_ONCE)
        if not wide.head(1):
            break
        up = levels[-1][0].groupBy("token", F.shiftright("block", FAN_BITS).alias("block")).agg(F.sum("sets").alias("sets"))
        levels.append((common.cut(up, "jaccard-at"), common.cut(_parents(levels[-1][1]), "jaccard-blocks")))
    above = None
    for depth in reversed(range(len(levels))):
        now, here = levels[depth]
        one, other = now.select("token", F.col("block").alias("a"), "sets"), now.select("token", F.col("block").alias("b"))
        several = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("sets") > 1))
        starts = now.groupBy("token").agg(F.count("*").alias("nodes")).where(F.col("nodes") <= AT_ONCE)
        if depth:  # narrow already one level down: it starts there
            below = levels[depth - 1][0].groupBy("token").agg(F.count("*").alias("nodes")).where(F.col("nodes") > AT_ONCE)
            starts = starts.join(below.select("token"), "token", "left_semi")
        found = one.join(starts.select("token"), "token", "left_semi").join(other, "token").where(several).select("token", "a", "b")
        if above is not None:
            left = one.withColumn("pa", F.shiftright("a", FAN_BITS))
            right = other.withColumn("pb", F.shiftright("b", FAN_BITS))
            down = above.select("token", F.col("a").alias("pa"), F.col("b").alias("pb")).join(left, ["token", "pa"]).join(right, ["token", "pb"])
            found = found.unionByName(down.where(several).select("token", "a", "b"))
        above = common.cut(_pruned(common.cut(found, "jaccard-pairs"), here, how), "jaccard-pairs")
    return above


class Tree:
    """Nodes over sets, level by level: ORed bitmaps, size ranges, excess and, where it is one, the label."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, words: int):
        maps = np.stack([bitmap(s, words) for s in sets])
        sizes = np.array([len(s) for s in sets], np.int64)
        excess = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, excess, labels, labels)]

    def grown(self, height: int) -> Tree:
        while len(self.levels) < height:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            maps, low, high, excess, least, most = self.levels[-1]
            ops = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(op.reduceat(x, at, axis=0) for op, x in zip(ops, (maps, low, high, excess, least, most))))
        return self


def _height(n: int) -> int:
    levels = 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def traversed(a: Tree, b: Tree, how: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (i of a, j of b) that may be similar and have not the same label; of one tree with itself, i < j."""
    height, same = _height(max(len(a.levels[0][0]), len(b.levels[0][0]))), a is b
    a.grown(height), b.grown(height)
    i, j = np.zeros(1, int), np.zeros(1, int)
    for depth in reversed(range(height)):
        one, other = a.levels[depth], b.levels[depth]
        if depth < height - 1:
            grid = np.arange(FAN)
            i, j = (np.repeat(i, FAN * FAN) * FAN + np.tile(np.repeat(grid, FAN), len(i))), (np.repeat(j, FAN * FAN) * FAN + np.tile(grid, len(j) * FAN))
            inside = (i < len(one[0])) & (j < len(other[0]))
            if same:
                inside &= i <= j if depth else i < j
            i, j = i[inside], j[inside]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 14):
            x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            both = np.bitwise_count(one[0][x] & other[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(one[3][x], other[3][y])
            both = np.minimum(both, np.minimum(one[2][x], other[2][y]))
            alone = (one[4][x] == one[5][x]) & (other[4][y] == other[5][y]) & (one[4][x] == other[4][y])
            keep[s : s + (1 << 14)] = how.possible(both, one[1][x], other[1][y], one[2][x], other[2][y]) & ~alone
        i, j = i[keep], j[keep]
        if same and not depth:
            i, j = i[i < j], j[i < j]
    return i, j


def tree_links(some: list[tuple], others: list[tuple], how: Jaccard) -> list[tuple[int, int]]:
    """Links (fp, fp) that connect what is similar between ``some`` and ``others`` (fp, label, set), or within ``some`` if there are no others."""
    sides = [sorted(side, key=lambda m: (m[1], len(m[2]))) for side in (some, others) if side]
    middle = int(np.median([len(m[2]) for side in sides for m in side]))
    words = min(256, max(16, 1 << max(0, (2 * middle - 1).bit_length() - 6)))
    names = {g: k for k, g in enumerate({m[1] for side in sides for m in side})}
    labels = [np.array([names[m[1]] for m in side]) for side in sides]
    trees = [Tree([m[2] for m in side], at, words) for side, at in zip(sides, labels)]
    i, j = traversed(trees[0], trees[-1], how)
    group, edges = np.arange(len(names)), []
    left, right = sides[0], sides[-1]
    ga, gb = labels[0], labels[-1]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    for s, e in zip(starts, np.r_[starts[1:], len(i)] if len(starts) else []):
        x, mine = left[i[s]], ga[i[s]]
        for k in j[s:e][group[gb[j[s:e]]] != group[mine]]:
            if group[gb[k]] == group[mine]:
                continue
            y = right[k]
            at = np.searchsorted(y[2], x[2])
            both = int(np.count_nonzero(y[2][np.minimum(at, len(y[2]) - 1)] == x[2]))
            if how.similar(both, len(x[2]), len(y[2])):
                edges.append((x[0], y[0]))
                group[group == group[gb[k]]] = group[mine]
    return edges


def _enough(keys: DataFrame, pairs: DataFrame, how: Jaccard) -> DataFrame:
    """(a, b, side, fp): the sets of pairs (token, a, b) of blocks that have enough of their first shingles in common with the other block."""
    at = keys.join(pairs.select("token", F.col("a").alias("block"), "a", "b"), ["token", "block"]).select("a", "b", F.lit(0).alias("side"), "fp", "n")
    other = keys.join(pairs.where("a <> b").select("token", F.col("b").alias("block"), "a", "b"), ["token", "block"]).select("a", "b", F.lit(1).alias("side"), "fp", "n")
    asked = at.unionByName(other).groupBy("a", "b", "side", "fp").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return asked.where(F.col("k") >= how.least(F.col("n"))).select("a", "b", "side", "fp")


def _trees(met: DataFrame, how: Jaccard) -> DataFrame:
    """Links (a, b) between sets (a, b, side, fp, g, items) of pairs of blocks. Each task goes down the trees of one pair at a time."""
    dealt = met.repartition("a", "b").sortWithinPartitions("a", "b", "side").select("a", "b", "side", "fp", "g", "items")

    def run(batches):
        now, sides = None, ([], [])
        for batch in batches:
            done = []
            for a, b, side, fp, g, items in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, b) != now:
                    done += links(now, *sides)
                    now, sides = (a, b), ([], [])
                sides[side].append((fp, g, np.frombuffer(items, np.uint64)))
            yield made(done)
        yield made(links(now, *sides))

    def links(now, some, others):
        return tree_links(some, others, how) if some and (others or now[0] == now[1]) else []

    def made(edges):
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    common.small_batches(met.sparkSession, size=BATCH)
    return common.cut(dealt.mapInArrow(run, "a long, b long"), "jaccard-links")


def _within_blocks(sets: DataFrame, keys: DataFrame, pairs: DataFrame, how: Jaccard) -> DataFrame:
    """Links between sets of the same block; a set that comes along for its bits in the filter changes nothing."""
    asked = _enough(keys, pairs, how).select("fp").distinct()
    own = common.maybe_among(sets.select("block", "fp", "items"), asked, "fp")
    return _trees(own.select(F.col("block").alias("a"), F.col("block").alias("b"), F.lit(0).alias("side"), "fp", F.col("fp").alias("g"), "items"), how)


def _across_blocks(sets: DataFrame, keys: DataFrame, pairs: DataFrame, labels: DataFrame, how: Jaccard) -> DataFrame:
    """Links between sets of different blocks, of those pairs whose sets have not all the same label (node, component) already."""
    named = _enough(keys, pairs, how).join(_small(labels.withColumnRenamed("node", "fp"), 16), "fp", "left")
    asked = common.cut(named.withColumn("g", F.coalesce("component", "fp")).drop("component"), "jaccard-asked")
    open_ = asked.groupBy("a", "b").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least <> most").select("a", "b")
    asked = common.cut(asked.join(_small(open_, 16), ["a", "b"], "left_semi"), "jaccard-asked")
    own = common.maybe_among(sets.select("fp", "items"), asked.select("fp").distinct(), "fp")
    return _trees(_small(asked, 40).join(own, "fp"), how)


def linked(docs: DataFrame, how: Jaccard = Jaccard()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: size of its set, smallest doc_id reachable over links.

    Null, empty and blank texts have an empty set, which is linked with
    nothing: component_id is the doc_id. Equal sets are linked. Rows with a null
    doc_id get the smallest of their component, null if it has none; repeated
    rows stay repeated; an empty table gives an empty result. Other columns are
    ignored.
    """
    rows = simhash.keyed(docs.select("doc_id", "text"))
    known = frequent(docs, how)
    prints = common.cut(_prints(rows, known, how), "jaccard")
    keys = _shared(prints, known, how)
    placed = _blocks(keys, how)
    sets = _leaves(rows, prints, placed, how)
    nodes = _nodes(sets)
    keys = common.cut(keys.join(_small(placed.select("fp", "block"), 16), "fp").select("token", "fp", "n", "block"), "jaccard-placed")
    pairs = block_pairs(keys.groupBy("token", "block").agg(F.count("*").alias("sets")), nodes, how)
    links = _within_blocks(sets, keys, pairs.where("a = b"), how)
    labels = common.components(links, "jaccard-components")
    across = _across_blocks(sets, keys, pairs.where("a <> b"), labels, how)
    if across.head(1):
        labels = common.components(links.union(across), "jaccard-components")
    return _with_components(prints, labels)


def _with_components(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``prints`` with its component's smallest doc_id."""
    ids = prints.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    ids = ids.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("g"))
    ids = common.cut(ids, "jaccard-ids")
    least = ids.groupBy("g").agg(F.min("least").alias("component_id"))
    named = common.cut(ids.join(least, "g").select("fp", "rows", "component_id"), "jaccard-named")
    # a set that is a thousandth of all rows would be one task's: at most a thousand of these are broadcast
    often = named.where(F.col("rows") > max(10_000, prints.count() // 1000)).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    out = prints.select("doc_id", "n", "fp").join(F.broadcast(often), "fp", "left")
    hot = out.where("hot").select("doc_id", "n", F.col("hot_id").alias("component_id"))
    rest = out.where("hot is null and n > 0").select("doc_id", "n", "fp").join(_small(named.select("fp", "component_id"), 16), "fp")
    none = out.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = hot.unionByName(rest.select("doc_id", "n", "component_id")).unionByName(none)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then everything reachable.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5_number(array_to_string(words[i : least(i + 4, len(words))], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * met >= 80 * (p.n + q.n - met)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""
