"""Gates: which boxes, glyph components and frames stay. Native predicates, cheapest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Filters, Level, Strokes, Sweep, parse_roi
from ..functions import boxes


def geometry(dets: DataFrame, width: int | Column, height: int | Column, options: Filters = Filters()) -> DataFrame:
    """Boxes of plausible size and shape, at least half inside the region of interest.

    ``width`` and ``height`` are the frames' size, one for all or columns. The
    region is the whole frame when scene text is to be masked as well.
    """
    x0, y0, x1, y1 = parse_roi(options.roi if options.scene_text == "keep" else "full")
    width, height = (F.lit(v).cast("double") for v in (width, height))
    roi = tuple(F.lit(v) * side for v, side in ((x0, width), (y0, height), (x1, width), (y1, height)))
    b = boxes.box()
    w, h = b[2] - b[0], b[3] - b[1]
    share = h / height
    return dets.where((w > 1) & (h > 1)).where(
        (share >= options.min_text_height)
        & (share <= options.max_text_height)
        & (w / h <= options.max_aspect)
        & (boxes.overlap(b, roi) / boxes.area(b) >= 0.5)
    )


def roi_overlap(dets: DataFrame, width: int, height: int, roi: str) -> DataFrame:
    """``dets`` with the share of each box inside the region."""
    x0, y0, x1, y1 = parse_roi(roi)
    region = tuple(F.lit(v).cast("double") for v in (x0 * width, y0 * height, x1 * width, y1 * height))
    b = boxes.box()
    return dets.withColumn("inside", F.when(boxes.area(b) > 0, boxes.overlap(b, region) / boxes.area(b)).otherwise(0.0))


def confident(dets: DataFrame, min_score: float) -> DataFrame:
    return dets.where(F.col("score") >= min_score)


def size_floor(clips: DataFrame, options: Filters, min_height: float = 0.02, min_pixels: int = 14) -> DataFrame:
    """``clips`` (with height in pixels) with the least box height as a share, raised but never lowered."""
    floor = F.greatest(F.lit(options.min_text_height), F.lit(min_height), F.lit(float(min_pixels)) / F.greatest(F.col("height"), F.lit(1)))
    return clips.withColumn("min_text_height", floor)


def overlaid(looks: DataFrame, options: Filters = Filters()) -> DataFrame:
    """``looks`` (contrast, lit, spread; null: too small to say) of regions that look like overlaid writing."""
    flat = (F.col("lit") < 8) | (F.col("spread") <= options.max_chroma_std)
    return looks.where((F.col("contrast") >= options.min_contrast) & flat)


def flat_and_contrasty(pixels: DataFrame, keys: list[str], options: Filters = Filters()) -> DataFrame:
    """Per region (``keys``) of pixels r, g, b: contrast, side, lit, spread and keep.

    Overlaid writing stands out on one side of the median and is of one colour.
    """
    from ..functions import pixels as px

    lum = pixels.withColumn("lum", px.luminance(F.col("r"), F.col("g"), F.col("b")))
    marks = lum.groupBy(*keys).agg(
        *[F.percentile("lum", F.lit(p / 100)).alias(f"p{p}") for p in (5, 10, 50, 90, 95)],
        F.count("*").alias("n"),
    )
    marks = marks.withColumn("light", F.col("p95") - F.col("p50") >= F.col("p50") - F.col("p5")).withColumn(
        "contrast", F.greatest(F.col("p95") - F.col("p50"), F.col("p50") - F.col("p5"))
    )
    glyph = F.when(F.col("light"), F.col("lum") >= F.col("p90")).otherwise(F.col("lum") <= F.col("p10"))
    red, green, hue = px.chromaticity(F.col("r"), F.col("g"), F.col("b"))
    seen = lum.join(marks, keys).where(glyph & hue).withColumns({"cr": red, "cg": green})
    spread = seen.groupBy(*keys).agg(
        F.count("*").alias("lit"), ((F.stddev_pop("cr") + F.stddev_pop("cg")) / 2).alias("spread")
    )
    out = marks.join(spread, keys, "left").fillna({"lit": 0})
    flat = (F.col("lit") < 8) | (F.col("spread") <= options.max_chroma_std)
    return out.select(*keys, "contrast", "light", "lit", "spread", ((F.col("contrast") >= options.min_contrast) & flat).alias("keep"))


def stroke_components(parts: DataFrame, options: Strokes = Strokes()) -> DataFrame:
    """Components (area, bw, bh, crop_w, crop_h, strength, stroke, text_height, segmented) shaped like strokes."""
    most = F.greatest(F.lit(options.max_stroke), options.max_stroke_frac * F.col("text_height"))
    spans = (F.col("bw") >= F.col("crop_w") - 1) & (F.col("bh") >= F.col("crop_h") - 1)
    small = (F.col("area") <= options.max_cc_area_frac * F.col("crop_w") * F.col("crop_h")) & ~spans & (F.col("stroke") <= most)
    return parts.where(
        (F.col("area") >= options.min_cc_area)
        & (F.col("strength") >= options.min_relative_strength)
        & (F.col("stroke") >= options.min_stroke)
        & (F.col("segmented") | small)
    )


def agreeing(parts: DataFrame, keys: list[str], value: str, tol: float, min_agree: float) -> DataFrame:
    """Components (area, ``value``) without those that disagree with the others of their group.

    Only components of half the median area vote; the bar is ``tol`` or three
    times the median distance; nothing goes if fewer than three vote or fewer
    than ``min_agree`` of them agree.
    """
    group = Window.partitionBy(*keys)
    judged = parts.withColumn("_big", F.col("area") >= 0.5 * F.percentile("area", F.lit(0.5)).over(group))
    vote = F.when(F.col("_big"), F.col(value))
    far = judged.withColumn("_votes", F.count(vote).over(group)).withColumn(
        "_far", F.abs(vote - F.percentile(vote, F.lit(0.5)).over(group))
    )
    bar = F.greatest(F.lit(tol), 3 * F.percentile("_far", F.lit(0.5)).over(group))
    far = far.withColumn("_ok", F.col("_far") <= bar)
    share = F.avg(F.when(F.col("_far").isNotNull(), F.col("_ok").cast("double"))).over(group)
    far = far.withColumn("_share", share)
    stands = (F.col("_votes") < 3) | (F.col("_share") < min_agree) | F.col("_far").isNull()
    return far.where(stands | F.col("_ok") if tol > 0 else F.lit(True)).drop("_big", "_votes", "_far", "_ok", "_share")


def thin_frames(ink: DataFrame, keys: list[str], weak_fill: float) -> DataFrame:
    """Frames of boxes (ink, box_area) whose ink fills less than ``weak_fill`` of the boxes."""
    fill = F.sum("ink") / F.greatest(F.sum("box_area"), F.lit(1))
    return ink.groupBy(*keys).agg(fill.alias("fill")).withColumn("thin", F.col("fill") < weak_fill)


def upright(dets: DataFrame, keys: list[str], options: Level = Level()) -> DataFrame:
    """Boxes whose ink runs level or can't be judged (tilt null); none of a frame that has only sloped ones."""
    level = F.abs(F.col("tilt")) <= options.max_tilt
    frame = Window.partitionBy(*keys)
    any_level = F.coalesce(F.bool_or(F.coalesce(level, F.lit(False))).over(frame), F.lit(False))
    any_tilted = F.bool_or(~F.coalesce(level, F.lit(True))).over(frame)
    kept = dets.withColumns({"_l": any_level, "_t": any_tilted})
    return kept.where(F.coalesce(level, F.lit(True)) & ~(F.col("_t") & ~F.col("_l"))).drop("_l", "_t")


def letters(parts: DataFrame, min_area: int, min_h: int, max_h: int, max_w: int) -> DataFrame:
    """Components (area, bw, bh) of a letter's size."""
    return parts.where((F.col("area") >= min_area) & F.col("bh").between(min_h, max_h) & (F.col("bw") <= max_w))


def hit_clusters(frames: DataFrame, keys: list[str], options: Sweep = Sweep()) -> DataFrame:
    """Clusters of swept frames (cluster, hit) with enough hits."""
    found = frames.groupBy(*keys, "cluster").agg(F.count_if(F.col("hit")).alias("hits"), F.count("*").alias("seen"))
    return found.where(F.col("hits") >= max(1, options.min_cluster_hits))


def text_pixels(alpha: Column) -> Column:
    """Whether a mask value 0 .. 255 counts as text: its share is above 0.02."""
    return alpha >= 6


def not_done(clips: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``clips`` that are not among ``done`` yet, for resuming."""
    return clips.join(done.select(key).distinct(), key, "left_anti")
