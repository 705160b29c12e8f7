"""Aggregates over pixels, components and frames; labelling and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates

PERCENTS = (5, 10, 50, 90, 95)


def percentiles(pixels: DataFrame, keys: list[str], value: str = "v", percents=PERCENTS) -> DataFrame:
    """Exact percentiles, linear between neighbours."""
    return pixels.groupBy(*keys).agg(*[F.round(F.percentile(value, F.lit(p / 100)), 6).alias(f"p{p}") for p in percents])


def coverage(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Opacity-weighted share of a mask's pixels, peak and whether any is set."""
    return masks.groupBy(*keys).agg(
        (F.sum("v") / (255.0 * F.count("*"))).alias("coverage"), F.max("v").alias("peak"), F.bool_or(F.col("v") > 0).alias("any_set")
    )


def otsu(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold that parts the 256-bin histogram with the greatest between-class variance; the first of equals."""
    bins = pixels.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("v")
    whole = Window.partitionBy(*keys)
    c = bins.select(
        "*",
        F.sum("n").over(upto).alias("w0"),
        F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("w"),
        F.sum(F.col("n") * F.col("v")).over(whole).alias("s"),
    )
    w1 = F.col("w") - F.col("w0")
    apart = F.col("s0") * F.col("w") - F.col("s") * F.col("w0")
    between = F.when(w1 > 0, F.round(apart.cast("double") * apart / (F.col("w0") * w1), 6)).otherwise(0.0)
    best = F.max_by("v", F.struct(between, (-F.col("v"))))
    return c.groupBy(*keys).agg(best.alias("threshold"), F.max(between).alias("variance"))


def composed(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Per pixel the greatest alpha of overlapping patches (alpha, level), and the greatest level of those that cover it."""
    from ..functions import pixels as px

    covered = px.normalised(F.col("alpha"), F.col("level")) > 0.25
    return patches.groupBy(*keys).agg(
        F.max("alpha").alias("alpha"), F.greatest(F.max(F.when(covered, F.col("level"))), F.lit(0.0)).alias("level")
    )


def blob_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Area, bounds and median of labelled pixels."""
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("area"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"),
        (F.max("y") + 1).alias("y1"),
        F.percentile("v", F.lit(0.5)).alias("median"),
    )


def blob_support(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per blob (keys, label) the share inside ``allowed``; per frame the area-weighted mean, as prior_overlap."""
    each = pixels.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.count_if(F.col("allowed")).alias("inside"))
    frame = Window.partitionBy(*keys)
    return each.select(
        "*",
        (F.col("inside") / F.col("area")).alias("overlap"),
        (F.sum("inside").over(frame) / F.sum("area").over(frame)).alias("prior_overlap"),
    )


def remembered_pixels(pixels: DataFrame, radius: int, min_level: float) -> DataFrame:
    """Pixels with ``trusted``: set in a frame of ±radius whose peak is at least ``min_level`` of 255."""
    peak = F.max("v").over(Window.partitionBy("clip_id", "frame_idx"))
    around = Window.partitionBy("clip_id", "y", "x").orderBy("frame_idx").rowsBetween(-radius, radius)
    sure = (peak >= min_level * 255) & (F.col("v") > 127)
    return pixels.withColumn("_sure", sure).withColumn("trusted", F.bool_or("_sure").over(around)).drop("_sure")


def held_to_verdicts(pixels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``pixels`` (label, v) with v where its blob is kept, 0 elsewhere: a blob stays with ``least`` pixels above half."""
    keep = pixels.groupBy(*keys, "label").agg(F.when(F.count_if(F.col("v") > 127) >= least, 255).otherwise(0).cast("long").alias("_keep"))
    return pixels.join(keep, [*keys, "label"]).withColumn("v", F.col("v").bitwiseAND(F.col("_keep"))).drop("_keep")


def tilt_scores(ink: DataFrame, keys: list[str], max_tilt: float = 8.0, step: float = 2.0, margin: float = 1.2) -> DataFrame:
    """Angle at which the sheared ink (x, y, v) falls into the fewest rows; 0 where no angle clearly wins.

    Every pixel of ink is sheared by each of a few constant angles.
    """
    import math

    n = math.ceil(max(2.5 * max_tilt, 45.0) / step)  # well past the tolerance, or a steep slope would pass for a slight one
    grid = [(k * step, math.tan(math.radians(k * step))) for k in range(-n, n + 1)]
    angles = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(t).alias("slope")) for a, t in grid])
    middle = F.avg("x").over(Window.partitionBy(*keys))
    sheared = ink.withColumn("_m", middle).select("*", F.inline(angles))
    band = F.rint(F.col("y") - (F.col("x") - F.col("_m")) * F.col("slope"))
    profile = sheared.groupBy(*keys, "angle", band.alias("band")).agg(F.sum("v").alias("s"))
    score = profile.groupBy(*keys, "angle").agg(F.sum(F.col("s") * F.col("s")).alias("score"))
    best = score.groupBy(*keys).agg(
        F.max_by("angle", F.struct("score", -F.abs("angle"), "angle")).alias("_angle"),
        F.max("score").alias("best"),
        F.max(F.when(F.col("angle") == 0, F.col("score"))).alias("flat"),
    )
    angle = F.when(F.col("best") <= F.col("flat") * margin, 0.0).otherwise(F.col("_angle"))
    return best.select(*keys, angle.alias("tilt"), "best", "flat")


def on_off(rows: DataFrame) -> DataFrame:
    """Frames (clip_id, frame_idx) with state on, off or neither, from coloured pixels per row (y, n).

    Each row's own median over time is taken off first, so that scenery of the text's colour cancels.
    """
    still = F.percentile("n", F.lit(0.5)).over(Window.partitionBy("clip_id", "y"))
    signal = rows.withColumn("_r", F.col("n") - still).groupBy("clip_id", "frame_idx").agg(F.sum("_r").alias("signal"))
    clip = Window.partitionBy("clip_id")
    low, span = F.min("signal").over(clip), F.max("signal").over(clip) - F.min("signal").over(clip)
    norm = F.when(span >= 1, (F.col("signal") - low) / span)
    state = F.when(norm > 0.5, "on").when(norm < 0.2, "off").otherwise("neither")
    return signal.select("clip_id", "frame_idx", F.round("signal", 6).alias("signal"), state.alias("state"))


def label_pixels(lit: DataFrame, min_on: float, min_gain: float) -> DataFrame:
    """Pixels lit in most frames that show the text and clearly more often than in those that don't."""
    on = F.avg(F.when(F.col("state") == "on", F.col("lit").cast("double")))
    off = F.avg(F.when(F.col("state") == "off", F.col("lit").cast("double")))
    each = lit.groupBy("clip_id", "y", "x").agg(F.round(on, 6).alias("on_mean"), F.round(off, 6).alias("off_mean"))
    gain = F.col("off_mean").isNull() | (F.col("on_mean") - F.col("off_mean") >= min_gain)
    return each.withColumn("candidate", (F.col("on_mean") >= min_on) & gain)


def text_band(parts: DataFrame, keys: list[str], gap: float = 2.0) -> DataFrame:
    """Components (cy, bh, area, label) of the block with the most ink; blocks part where rows are far apart."""
    order = Window.partitionBy(*keys).orderBy("cy", "label")
    tall = F.percentile("bh", F.lit(0.5)).over(Window.partitionBy(*keys))
    step = F.col("cy") - F.lag("cy").over(order)
    marked = parts.withColumn("_tall", tall).withColumn("_new", F.when(step.isNull() | (step > gap * F.col("_tall")), 1).otherwise(0))
    marked = marked.withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ink = F.sum("area").over(Window.partitionBy(*keys, "band"))
    best = F.max(F.struct(F.col("_ink"), (-F.col("band")).alias("b"))).over(Window.partitionBy(*keys))
    return marked.withColumn("_ink", ink).withColumn("_b", -best["b"]).where(F.col("band") == F.col("_b")).drop("_tall", "_new", "_ink", "_b")


def mask_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame fgIoU, recall on the core and precision of pixels (pred, truth, core)."""
    p, t, c = F.col("pred"), F.col("truth"), F.col("core")

    def share(a: Column, b: Column) -> Column:
        return F.count_if(a) / F.greatest(F.count_if(b), F.lit(1))

    return pairs.groupBy(*keys).agg(
        share(p & t, p | t).alias("iou"), share(p & c, c).alias("recall"), share(p & t, p).alias("precision")
    )


def score_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    def middle(c):
        return F.round(F.percentile(c, F.lit(0.5)), 6)

    return scores.groupBy(*keys).agg(
        middle("iou").alias("iou"), middle("recall").alias("recall"), middle("precision").alias("precision"), F.min("iou").alias("worst"), F.count("*").alias("frames")
    )


def preview_numbers(pixels: DataFrame, keys: list[str], low: float, high: float, brightness: float) -> DataFrame:
    """What a preview says of a mask's pixels (v, 0 .. 255): the share covered, the peak, and the code that text is painted with."""
    covered = F.avg(gates.text_pixels(F.col("v")).cast("double"))
    painted = F.lit(low + min(max(brightness, 0.0), 1.0) * (high - low))
    return pixels.groupBy(*keys).agg(covered.alias("covered"), (F.max("v") / 255.0).alias("peak"), painted.alias("painted"))


def report_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("verdict").agg(F.count("*").alias("clips"))


def relative_code(ring: DataFrame, keys: list[str], offset: float, low: float, high: float) -> DataFrame:
    """Level just in front of the depth around a text: the ring's 90th percentile and a share of the range."""
    base = F.percentile("v", F.lit(0.9)) + offset * (high - low)
    return ring.groupBy(*keys).agg(F.round(F.least(F.greatest(base, F.lit(low)), F.lit(high)), 6).alias("code"))


def colour_spread(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """P90 - P10 over blobs (label) of the median of their stronger halves."""
    mid = F.percentile("v", F.lit(0.5)).over(Window.partitionBy(*keys, "label"))
    strong = pixels.withColumn("_mid", mid).where(F.col("v") >= F.col("_mid"))
    each = strong.groupBy(*keys, "label").agg(F.percentile("v", F.lit(0.5)).alias("median"))
    spread = F.percentile("median", F.lit(0.9)) - F.percentile("median", F.lit(0.1))
    return each.groupBy(*keys).agg(F.round(spread, 6).alias("spread"))


def thinned(ink: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every k-th pixel of a region with more than ``most``."""
    rows = ink.withColumns(
        {"_rn": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))}
    )
    step = F.floor(F.col("_n") / most) + 1
    return rows.where((F.col("_n") <= most) | (F.pmod("_rn", step) == 0)).drop("_rn", "_n")


def region_pixels(pixels: DataFrame, blobs: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels inside the box of any blob (x0, y0, x1, y1) of their frame."""
    boxes = blobs.groupBy(*keys).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_boxes"))
    inside = F.exists("_boxes", lambda b: (F.col("x") >= b["x0"]) & (F.col("x") < b["x1"]) & (F.col("y") >= b["y0"]) & (F.col("y") < b["y1"]))
    return pixels.join(boxes, keys).where(inside).drop("_boxes")
