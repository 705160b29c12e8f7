"""Boxes over time: merging of detectors, persistence, carrying forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Filters
from ..functions import boxes


def merge(dets: DataFrame, keys: list[str], order: list[str], percent: int = 60) -> DataFrame:
    """Boxes of each frame after greedy merging in the order given.

    A box that overlaps one already kept by ``percent`` IoU is folded into the
    first such box, which keeps its geometry and takes the better score. A
    frame's boxes are few; frames are independent.
    """
    fields = ["x0", "y0", "x1", "y1", "score"]
    listed = dets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias("_all"))
    plain = F.transform("_all", lambda d: F.struct(*[d[c].alias(c) for c in fields]))

    def parts(d):
        return tuple(d[c] for c in fields[:4])

    def fold(kept, d):
        same = F.transform(kept, lambda k: boxes.iou_at_least(parts(k), parts(d), percent))
        at = F.array_position(same, F.lit(True))
        better = F.transform(
            kept,
            lambda k, i: F.struct(
                *[k[c].alias(c) for c in fields[:4]],
                F.when(i + 1 == at, F.greatest(k["score"], d["score"])).otherwise(k["score"]).alias("score"),
            ),
        )
        return F.when(at > 0, better).otherwise(F.concat(kept, F.array(d)))

    listed = listed.withColumn("_plain", plain)
    merged = listed.select(*keys, F.posexplode(F.aggregate("_plain", F.filter("_plain", lambda d: F.lit(False)), fold)).alias("_i", "_d"))
    return merged.select(*keys, F.col("_i").cast("long").alias("kept_id"), *[F.col(f"_d.{c}").alias(c) for c in fields])


def persistence(dets: DataFrame, frames: DataFrame, options: Filters = Filters()) -> DataFrame:
    """``dets`` with hits, the frames of the window that show the same box, required and keep.

    The window of ±persist_window // 2 frames is an equality join: every box
    is offered to the frames around it, and boxes meet on (clip, frame). Its
    length near a clip's ends counts frames without boxes too.
    """
    radius = options.persist_window // 2
    offered = dets.select(
        "clip_id",
        F.explode(F.sequence(F.col("frame_idx") - radius, F.col("frame_idx") + radius)).alias("frame_idx"),
        F.col("frame_idx").alias("_seen"),
        *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")],
    )
    same = boxes.iou_at_least(boxes.box(), boxes.box("_"), round(100 * options.persist_iou))
    if options.allow_vertical_scroll:
        same = same | boxes.scrolled(boxes.box(), boxes.box("_"))
    met, keys = dets.join(offered, ["clip_id", "frame_idx"]), ["clip_id", "frame_idx", "det_id"]
    if 2 * radius < 63:  # frames of the window as bits; a box meets itself, so none is lost
        at = F.expr(f"shiftleft(1L, cast(_seen - frame_idx + {radius} as int))")
        hits = F.bit_count(F.coalesce(F.bit_or(F.when(same, at)), F.lit(0).cast("long"))).cast("long")
    else:
        hits = F.count_distinct(F.when(same, F.col("_seen")))
    out = met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in dets.columns if c not in keys], hits.alias("hits"))
    ends = frames.groupBy("clip_id").agg(F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("_last"))
    length = (
        F.least(F.col("frame_idx") + radius, F.col("_last")) - F.greatest(F.col("frame_idx") - radius, F.col("_first")) + 1
    )
    out = out.join(ends, "clip_id").withColumn("required", F.least(F.lit(options.min_persist_frames).cast("long"), length))
    always = options.scene_text != "keep" or options.min_persist_frames <= 1
    return out.withColumn("keep", F.lit(True) if always else F.col("hits") >= F.col("required")).drop("_first", "_last")


def carry_forward(frames: DataFrame, every: int, value: str) -> DataFrame:
    """``frames`` with ``value`` of the last frame whose index ``every`` divides.

    A detected frame without boxes must hold an empty value, not null, or an
    older one would come back.
    """
    seen = F.when(F.pmod("frame_idx", F.lit(every)) == 0, F.col(value))
    so_far = Window.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(value, F.last(seen, ignorenulls=True).over(so_far))
