"""Bits of frames as rows: 64 pixels a word, and what morphology, memory and components are over them.

A plane is rows (clip_id, frame_idx, y, w, bits) for the words that are not 0:
bit k of word w is the pixel x = 64 * w + k. Text covers little of a frame, so
these are few. Thresholds, unions, dilation by shifts and the union over
neighbouring frames are expressions and aggregations; components come from runs
of pixels, joined with the runs they touch and contracted to stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import steps
from ..config import Temporal
from ..kernels.arrays import ellipse

FRAME = ["clip_id", "frame_idx"]
WORD = [*FRAME, "y", "w"]
PLANE = "clip_id string, frame_idx long, y int, w int, bits long"


def packed(frames: DataFrame, column: str, least: int = 128) -> DataFrame:
    """The bits of ``column``, a byte plane (height, width), that are ``least`` and more."""

    def run(batches):
        for batch in batches:
            clips, index, ys, ws, bits = [], [], [], [], []
            for clip, i, h, w, data in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(np.frombuffer(data, np.uint8).reshape(h, w) >= least)
                y, at = np.nonzero(words)
                clips += [clip] * len(y)
                index += [i] * len(y)
                ys.append(y)
                ws.append(at)
                bits.append(words[y, at])
            if clips:
                flat = [np.concatenate(v).astype(t) for v, t in ((ys, np.int32), (ws, np.int32), (bits, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(clips), pa.array(index, pa.int64()), *map(pa.array, flat)], WORD + ["bits"])

    return frames.select(F.col("clip_id").cast("string").alias("clip_id"), "frame_idx", "height", "width", column).mapInArrow(run, PLANE)


def words_of(mask: np.ndarray) -> np.ndarray:
    """Rows of a mask as 64-bit words."""
    h, w = mask.shape
    wide = np.zeros((h, -(-w // 64) * 64), bool)
    wide[:, :w] = mask
    return np.packbits(wide, axis=1, bitorder="little").view(np.int64)


def unpacked(words: list[tuple[int, int, int]], height: int, width: int) -> np.ndarray:
    """A mask of 0 and 1 from (y, w, bits); what lies outside it is ignored."""
    plane = np.zeros((height, -(-width // 64)), np.int64)
    for y, w, bits in words:
        if y < height and w < plane.shape[1]:
            plane[y, w] = bits
    return np.unpackbits(plane.view(np.uint8), axis=1, bitorder="little")[:, :width]


def packed_pixels(pixels: DataFrame, lit: Column) -> DataFrame:
    """The bits of pixel rows (clip_id, frame_idx, y, x) where ``lit``."""
    word, bit = F.floor(F.col("x") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(x % 64 as int))")
    return pixels.where(lit).groupBy(*FRAME, F.col("y").cast("int").alias("y"), word).agg(F.bit_or(bit).alias("bits"))


def pixels_of(plane: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, y, x) of the bits that are set."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    return plane.select(*FRAME, "y", "w", F.explode(places).alias("k")).select(*FRAME, F.col("y").cast("long").alias("y"), (F.col("w") * 64 + F.col("k")).cast("long").alias("x"))


def united(plane: DataFrame) -> DataFrame:
    """One row a word: the union of all its rows."""
    return plane.groupBy(*WORD).agg(F.bit_or("bits").alias("bits"))


def around(plane: DataFrame, radius: int, wanted: DataFrame | None = None) -> DataFrame:
    """For every frame the union of the planes of ±radius frames; with ``wanted`` (clip_id, frame_idx) for those alone."""
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame_idx") - radius), F.col("frame_idx") + radius)
    dealt = plane.select("clip_id", F.explode(near).alias("frame_idx"), "y", "w", "bits")
    return united(dealt if wanted is None else dealt.join(wanted.select(*FRAME).distinct(), FRAME, "left_semi"))


def _spread(bits: Column, reach: int) -> list[tuple[int, Column]]:
    """(words to the right, bits) of pixels and up to ``reach`` others on both sides."""
    zero = F.lit(0).cast("long")
    inside, right, left = bits, zero, zero
    for k in range(1, reach + 1):
        inside = inside.bitwiseOR(F.shiftleft(bits, k)).bitwiseOR(F.shiftrightunsigned(bits, k))
        right = right.bitwiseOR(F.shiftrightunsigned(bits, 64 - k))
        left = left.bitwiseOR(F.shiftleft(bits, 64 - k))
    return [(0, inside)] + ([(1, right), (-1, left)] if reach else [])


def dilated(plane: DataFrame, foot: np.ndarray) -> DataFrame:
    """The plane grown by a symmetric footprint of up to 127 columns; bits right of and below a frame are for readers to ignore."""
    radius = foot.shape[0] // 2
    parts = [
        F.struct((F.col("y") + dy).alias("y"), (F.col("w") + dw).alias("w"), bits.alias("bits"))
        for dy in range(-radius, radius + 1)
        if foot[dy + radius].any()
        for dw, bits in _spread(F.col("bits"), int(foot[dy + radius].sum()) // 2)
    ]
    return united(plane.select(*FRAME, F.inline(F.array(*parts))).where("bits <> 0 and y >= 0 and w >= 0"))


def runs(plane: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, y, w, x0, x1): runs of pixels within words, both ends included."""
    bits = F.col("bits")
    first = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1)))
    last = bits.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(bits, 1)))

    def places(ends: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", ends, k) == 1)

    pairs = F.arrays_zip(places(first).alias("a"), places(last).alias("b"))
    each = plane.select(*WORD, F.explode(pairs).alias("p"))
    return each.select(*WORD, (F.col("w") * 64 + F.col("p.a")).alias("x0"), (F.col("w") * 64 + F.col("p.b")).alias("x1"))


def touching(spans: DataFrame, diagonal: bool = True) -> DataFrame:
    """(clip_id, frame_idx, a, b): runs that belong together, a below or right of b; a run is known by y << 32 | x0.

    A run looks for others in the words it reaches, so no row's runs meet all
    of the next.
    """
    reach = 1 if diagonal else 0
    node = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x0").cast("long"))
    rows = spans.select(*FRAME, "y", "w", "x0", "x1", node.alias("n"))
    up = rows.select(*FRAME, (F.col("y") - 1).alias("y"), F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("x0") - reach) / 64)).cast("int"), F.floor((F.col("x1") + reach) / 64).cast("int"))).alias("w"), F.col("x0").alias("p0"), F.col("x1").alias("p1"), F.col("n").alias("a"))
    left = rows.where("x0 % 64 = 0 and w > 0").select(*FRAME, "y", (F.col("w") - 1).alias("w"), (F.col("x0") - 1).alias("p0"), (F.col("x0") - 1).alias("p1"), F.col("n").alias("a"))
    asked = up.withColumn("reach", F.lit(reach)).unionByName(left.withColumn("reach", F.lit(0)))
    met = asked.join(rows.select(*WORD, "x0", "x1", F.col("n").alias("b")), WORD)
    return met.where((F.col("p0") <= F.col("x1") + F.col("reach")) & (F.col("p1") >= F.col("x0") - F.col("reach"))).select(*FRAME, "a", "b")


def contracted(edges: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """(keys, n, label): the smallest node reachable over edges (keys, a, b), for nodes that have any; stars, large then small, until stable."""
    now = steps.cut(edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy(*keys, "a").agg(F.min("b").alias("m"), F.collect_set("b").alias("others"))
        ends = F.explode(F.array_union(F.array("a"), "others")).alias("a")
        stars = small.select(*keys, ends, F.col("m").alias("b")).where("a <> b").distinct()
        after = steps.cut(stars, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(20,0)"))).first()
        steps.drop(now)
        now = after
        if state == known:
            break
        known = state
    roots = now.select(*keys, F.col("b").alias("n"), F.col("b").alias("label")).distinct()
    return now.select(*keys, F.col("a").alias("n"), F.col("b").alias("label")).unionByName(roots)


def components(plane: DataFrame, diagonal: bool = True) -> DataFrame:
    """The runs of a plane with ``label``, the same for all of a connected part: its first run's number, in reading order."""
    spans = steps.cut(runs(plane), "runs")
    labels = contracted(touching(spans, diagonal))
    node = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x0").cast("long"))
    return spans.withColumn("n", node).join(labels, [*FRAME, "n"], "left").withColumn("label", F.coalesce("label", "n")).drop("n")


def blobs(labelled: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, label, area, x0, y0, x1, y1) of labelled runs; x1 and y1 are the first beyond."""
    size = F.col("x1") - F.col("x0") + 1
    return labelled.groupBy(*FRAME, "label").agg(
        F.sum(size).cast("long").alias("area"), F.min("x0").cast("long").alias("x0"), F.min("y").cast("long").alias("y0"), (F.max("x1") + 1).cast("long").alias("x1"), (F.max("y") + 1).cast("long").alias("y1")
    )


def _bits_of_run() -> Column:
    """The run's bits within its word."""
    return F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (x1 - x0)), x0 % 64)")


def supported(labelled: DataFrame, memory: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, label, area, inside): how many of a blob's pixels ``memory`` has."""
    met = labelled.join(memory.select(*WORD, F.col("bits").alias("_m")), WORD, "left")
    inside = F.coalesce(F.bit_count(_bits_of_run().bitwiseAND(F.col("_m"))), F.lit(0))
    return met.groupBy(*FRAME, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.sum(inside).alias("inside"))


def remembered(frames: DataFrame, options: Temporal) -> DataFrame:
    """(clip_id, frame_idx, words): the bits that may stay of frames (shape, peak) with blobs that no confident frame near them supports.

    Frames that are not among the rows stay whole: nothing around them is
    confident, the memory does not cover what they show, as when the text has
    moved, or all of their blobs are supported.
    """
    near = ellipse(2 * max(1, options.prior_tolerance) + 1)
    now = steps.cut(packed(frames, "shape"), "bits")
    sure = frames.where(F.col("peak") >= options.prior_min_level * 255).select(*FRAME)
    memory = dilated(around(now.join(sure, FRAME, "left_semi"), options.prior_window // 2, now.select(*FRAME)), near)
    memory = steps.cut(memory, "memory")
    unknown = now.join(memory.select(*WORD, F.col("bits").alias("_m")), WORD, "left").where(F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_m", F.lit(0).cast("long")))) != 0)
    asked = unknown.select(*FRAME).distinct()
    if options.prior_min_overlap <= 0:  # else a frame without memory has no overlap anyway
        asked = asked.join(memory.select(*FRAME).distinct(), FRAME, "left_semi")
    asked = steps.cut(asked, "asked")
    if not asked.head(1):
        return asked.select(*FRAME, F.lit(None).cast("array<struct<y:int,w:int,bits:bigint>>").alias("words"))
    labelled = steps.cut(components(now.join(asked, FRAME, "left_semi")), "labelled")
    blob = supported(labelled, memory).withColumn("strange", F.col("inside") < options.prior_min_support * F.col("area"))
    blob = steps.cut(blob, "blobs")
    frame = blob.groupBy(*FRAME).agg(F.sum("inside").alias("inside"), F.sum("area").alias("area"), F.bool_or("strange").alias("strange"))
    changed = frame.where(F.col("strange") & (F.col("inside") >= options.prior_min_overlap * F.col("area"))).select(*FRAME)
    stay = labelled.join(blob.where("not strange").select(*FRAME, "label"), [*FRAME, "label"], "left_semi").join(changed, FRAME, "left_semi")
    grown = dilated(united(stay.select(*WORD, _bits_of_run().alias("bits"))), near)
    words = grown.groupBy(*FRAME).agg(F.collect_list(F.struct("y", "w", "bits")).alias("words"))
    none = F.array().cast("array<struct<y:int,w:int,bits:bigint>>")
    return changed.join(words, FRAME, "left").select(*FRAME, F.coalesce("words", none).alias("words"))


def nearest_valid(pixels: DataFrame, radius: int, keys: list[str] = FRAME) -> DataFrame:
    """Pixels (keys, y, x, v) with v from the nearest pixel that has one (not null) within ``radius`` rows and columns, and gap, its squared distance.

    Two passes: in every row the nearest value to the left and to the right by
    windows, then across rows, of which only those within the radius are looked
    at. Ties go to the smaller y, then the smaller x, of what is taken; v and
    gap are null where nothing is near enough.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x")
    here = F.when(F.col("v").isNotNull(), F.struct(F.col("x").alias("at"), "v"))
    sides = {
        "_l": F.last(here, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)),
        "_r": F.first(here, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing)),
    }
    own = F.array(*[F.struct(F.abs(F.col("x") - F.col(f"{s}.at")).alias("d"), F.col(f"{s}.at").alias("at"), F.col(f"{s}.v").alias("v")) for s in sides])
    best = F.array_min(F.filter(own, lambda c: c["d"] <= radius))
    rows = pixels.withColumns(sides).select(*keys, "y", "x", "v", best.alias("_b"))
    column = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    near = F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("y", "_b"))).over(column)
    ranked = F.transform(
        near, lambda p: F.struct((p["_b"]["d"] * p["_b"]["d"] + (p["y"] - F.col("y")) * (p["y"] - F.col("y"))).alias("d"), p["y"].alias("y"), p["_b"]["at"].alias("at"), p["_b"]["v"].alias("v"))
    )
    found = rows.withColumn("_n", F.array_min(ranked))
    return found.select(*keys, "y", "x", F.col("_n.v").alias("v"), F.col("_n.d").alias("gap"))
