"""Windows over frames: truncated sliding windows, runs, verdicts, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Sweep, Thresholds


def sliding(keys: list[str], radius: int, order: str = "frame_idx") -> WindowSpec:
    """±radius rows, cut off at both ends of a clip."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)


def smoothed(pixels: DataFrame, keys: list[str], mode: str = "median", window: int = 3) -> Column:
    """Temporal median (an even window takes the floor of the middle pair's mean), maximum or nothing."""
    w = sliding(keys, window // 2)
    if mode == "median":
        return F.floor(F.percentile("v", F.lit(0.5)).over(w))
    if mode == "max":
        return F.max("v").over(w)
    if mode == "none":
        return F.col("v")
    raise ValueError(f"unknown temporal mode {mode!r}; use median, max or none")


def observed(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Frames with hit, run (hits in a row within the window), text_frames and longest_run so far, flagged; one window after another."""
    hit = F.coalesce((F.col("dets") >= 1) & (F.col("coverage") >= t.min_coverage), F.lit(False))
    clip = Window.partitionBy("clip_id").orderBy("window_id", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    part = Window.partitionBy("clip_id", "window_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("hit", hit).withColumn("_break", F.sum(F.when(~F.col("hit"), 1).otherwise(0)).over(part))
    island = Window.partitionBy("clip_id", "window_id", "_break").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum(F.col("hit").cast("long")).over(island))
    rows = rows.withColumn("text_frames", F.sum(F.col("hit").cast("long")).over(clip)).withColumn("longest_run", F.max("run").over(clip))
    return rows.withColumn("flagged", (F.col("text_frames") >= t.min_text_frames) & (F.col("longest_run") >= t.min_run)).drop("_break")


def scanned(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``observed`` up to the first frame at which a clip is flagged, that one included; nothing after it is looked at."""
    at = F.struct("window_id", "frame_idx")
    rows = observed(frames, t).withColumn("_stop", F.min(F.when(F.col("flagged"), at)).over(Window.partitionBy("clip_id")))
    return rows.where(F.col("_stop").isNull() | (at <= F.col("_stop"))).drop("_stop")


def verdicts(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per clip: what was counted up to the first frame at which it is flagged, nothing after it."""
    return counted(scanned(frames, t))


def counted(seen: DataFrame) -> DataFrame:
    """One row per clip of what ``scanned`` gives."""
    hits = F.slice(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("frame_idx")))), 1, 8)
    return seen.groupBy("clip_id").agg(
        F.count("*").alias("frames_scanned"),
        F.max("text_frames").alias("text_frames"),
        F.max("longest_run").alias("longest_run"),
        F.greatest(F.max("coverage"), F.lit(0.0)).alias("peak_coverage"),
        F.bool_or("flagged").alias("flagged"),
        hits.alias("hits"),
    )


def strongest(frames: DataFrame, k: int = 3) -> DataFrame:
    """The k frames of each clip with boxes and the greatest coverage, earlier ones first among equals."""
    order = Window.partitionBy("clip_id").orderBy(F.col("coverage").desc(), "frame_idx")
    return frames.where("dets >= 1").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(1, k))


def window_plan(clips: DataFrame, windows: int, window_len: int, radius: int, exhaustive: bool = False) -> DataFrame:
    """(clip_id, start, count) of evenly spread windows; count null: to the end."""
    length, n = max(window_len, 2 * max(0, radius) + 1), max(1, windows)
    total = F.col("total_frames")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.when(total > 0, total).alias("count")))
    open_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("count")))
    if n == 1:
        spread = whole
    else:
        starts = F.array_sort(
            F.array_distinct(
                F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (total - length) / float(n - 1)).cast("long"))
            )
        )
        spread = F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).cast("long").alias("count")))
    plan = F.when(F.lit(exhaustive) | (total <= 0), open_).when(total <= length * n, whole).otherwise(spread)
    return clips.select("clip_id", F.explode(plan).alias("w")).select("clip_id", "w.start", "w.count")


def plan_cost(plan: DataFrame, clips: DataFrame, seek: int = 10) -> DataFrame:
    """(clip_id, cost): frames to read plus ``seek`` for every window."""
    each = plan.join(clips.select("clip_id", "total_frames"), "clip_id")
    frames = F.coalesce(F.col("count"), F.greatest("total_frames", F.lit(1)))
    return each.groupBy("clip_id").agg((F.sum(frames) + seek * F.count("*")).alias("cost"), F.count("*").alias("windows"))


def sweep_plan(clips: DataFrame, sweep: Sweep = Sweep(), most: float = 0.25) -> DataFrame:
    """(clip_id, start, count) of the cheap pass: short clusters over at most a quarter of a clip."""
    frames, total = max(1, sweep.frames), F.col("total_frames")
    budget = max(1, sweep.clusters) * frames
    affordable = F.floor(F.floor(total * most) / frames)
    clusters = F.greatest(F.lit(1), F.least(F.lit(sweep.clusters), affordable))
    first = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(budget).cast("long").alias("count")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), total.alias("count")))
    starts = F.array_sort(
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0).cast("long"), clusters - 1),
                lambda i: F.rint(i * (total - frames) / F.greatest(clusters - 1, F.lit(1)).cast("double")).cast("long"),
            )
        )
    )
    spread = F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(frames).cast("long").alias("count")))
    plan = F.when(total <= 0, first).when((clusters == 1) | (total <= frames * clusters), whole).otherwise(spread)
    return clips.select("clip_id", F.explode(plan).alias("w")).select("clip_id", "w.start", "w.count")


def sweep_is_worth_it(clips: DataFrame, sweep: Sweep, windows: int, window_len: int, radius: int, margin: float = 0.8, least: int = 3) -> DataFrame:
    """(clip_id, worth_it): whether the sweep costs clearly less than reading blindly."""
    cheap = plan_cost(sweep_plan(clips, sweep), clips).select("clip_id", F.col("cost").alias("cheap"), F.col("windows").alias("clusters"))
    blind = plan_cost(window_plan(clips, windows, window_len, radius), clips).select("clip_id", F.col("cost").alias("blind"))
    enough = F.col("clusters") >= min(least, max(1, sweep.clusters))
    return cheap.join(blind, "clip_id").select("clip_id", "cheap", "blind", (enough & (F.col("cheap") < margin * F.col("blind"))).alias("worth_it"))


def confirm_plan(hits: DataFrame, clips: DataFrame, window_len: int, radius: int, most: int = 4) -> DataFrame:
    """(clip_id, start, count): windows centred on groups of hit frames, a new group after a gap of a window."""
    length = max(window_len, 2 * max(0, radius) + 1)
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    once = hits.select("clip_id", "frame_idx").distinct()
    gap = F.col("frame_idx") - F.lag("frame_idx").over(order)
    grouped = once.withColumn("_new", F.when(gap.isNull() | (gap > length), 1).otherwise(0))
    grouped = grouped.withColumn("group_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy("clip_id", "group_id").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")).where(F.col("group_id") <= max(1, most))
    centre = F.floor((F.col("a") + F.col("b")) / 2)
    start = F.greatest(F.lit(0), centre - length // 2)
    joined = spans.join(clips.select("clip_id", "total_frames"), "clip_id")
    start = F.when(F.col("total_frames") > 0, F.least(start, F.greatest(F.lit(0), F.col("total_frames") - length))).otherwise(start)
    return joined.select("clip_id", start.cast("long").alias("start"), F.lit(length).cast("long").alias("count")).distinct()
