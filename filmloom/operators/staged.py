"""Triage of clips that reads frames only as they are asked for.

A clip is read in waves: the clusters of the sweep, then its windows one after
another, then its strongest frames one after another. A wave names the frames
it needs; only their files are opened. Clips that are decided leave: those
without hits after the sweep, flagged ones before their next window, those
whose words read before their next frame, and those of which a frame could not
be looked at. The report is that of ``scan.triage`` over a table of all frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import steps
from ..config import Config
from ..sources import detectors
from ..sources.frames import read_listed
from . import gates, masks, scan, windows

Look = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Eyes:
    """How frames, rows of a listing (clip_id, frame_idx, window_id, ...), are looked at.

    ``glance`` gives (clip_id, window_id, frame_idx, dets), ``stare`` coverage,
    dets, and if it knows them tilted and min_text_px; both may give error and
    seconds. ``read`` gives (clip_id, frame_idx, pos, word, confidence).
    """

    glance: Look
    stare: Look
    read: Look | None = None


def triage(listing: DataFrame, eyes: Eyes, config: Config = Config(), pairs: DataFrame | None = None, copies: DataFrame | None = None, sweep: bool = True, radius: int | None = None) -> DataFrame:
    """``scan.triage`` of clips from a listing of their frames (clip_id, frame_idx and what the eyes need); ``radius`` is the options' halo if not given.

    The report is a table of files, so that its joins run by real sizes as the waves' do.
    """
    with steps.joined_by_real_size(listing.sparkSession):
        return steps.cut(_triage(listing, eyes, config, pairs, copies, sweep, radius), "report")


def _triage(listing: DataFrame, eyes: Eyes, config: Config, pairs: DataFrame | None, copies: DataFrame | None, sweep: bool, radius: int | None) -> DataFrame:
    plan, radius = config.scan, config.halo if radius is None else radius
    listing = steps.cut(listing, "listing")
    clips = steps.cut(listing.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("total_frames")), "clips")
    worth = steps.cut(scan.worth_sweeping(clips, config.sweep if sweep else None, plan, radius), "swept-clips")
    wanted = scan.planned(listing.join(steps.few(worth), "clip_id", "left_semi"), windows.sweep_plan(clips, config.sweep))
    swept = steps.cut(eyes.glance(wanted), "swept")
    close = windows.confirm_plan(scan.swept_hits(swept, config.sweep), clips, plan.window_len, radius)
    blind = windows.window_plan(clips, plan.windows, plan.window_len, radius, plan.exhaustive).join(worth, "clip_id", "left_anti")
    both = scan.numbered_windows(close.unionByName(blind))
    broken = scan.failures(swept)
    both = steps.cut(both if broken is None else both.join(broken, "clip_id", "left_anti"), "windows")
    seen = _confirmed(listing, both, eyes, config)
    read = None if eyes.read is None else _read(listing, seen, eyes, config)
    return scan.report(clips, swept, seen, read, pairs, copies, config.sweep, config.reading)


def _confirmed(listing: DataFrame, plan: DataFrame, eyes: Eyes, config: Config) -> DataFrame:
    """What was seen of the windows, those of a clip one after another until it is decided."""
    seen, wave = None, 1
    while True:
        now = plan.where(F.col("window_id") == wave)
        if seen is not None:
            looked = windows.scanned(seen, config.thresholds)
            done, broken = looked.where("flagged").select("clip_id"), scan.failures(looked)
            done = done if broken is None else done.unionByName(broken.select("clip_id"))
            now = now.join(done.distinct(), "clip_id", "left_anti")
        now = steps.cut(now, "wave")
        if seen is not None and not now.head(1):
            return steps.cut(windows.scanned(seen, config.thresholds), "seen")
        found = steps.cut(eyes.stare(scan.planned(listing, now)), "seen")
        seen = found if seen is None else seen.unionByName(found)
        wave += 1


def _read(listing: DataFrame, seen: DataFrame, eyes: Eyes, config: Config) -> DataFrame:
    """Words (clip_id, frame_idx, rank, pos, word, confidence) of the flagged clips' strongest frames, one frame after another until one reads."""
    flagged = seen.where("flagged").select("clip_id").distinct()
    broken = scan.failures(seen)
    flagged = flagged if broken is None else flagged.join(broken, "clip_id", "left_anti")
    best = windows.strongest(seen, config.reading.max_frames).join(flagged, "clip_id", "left_semi").select("clip_id", "frame_idx", "window_id", "rank")
    best = steps.cut(best, "best")
    read = None
    for rank in range(1, max(1, config.reading.max_frames) + 1):
        now = best.where(F.col("rank") == rank)
        if read is not None:
            said = scan.legible_words(read, config.reading).where("legible").select("clip_id")
            now = now.join(said, "clip_id", "left_anti")
        now = steps.cut(now, "evidence")
        frames = listing.join(steps.few(now), ["clip_id", "frame_idx"])
        words = eyes.read(frames).join(now.select("clip_id", "frame_idx", "rank"), ["clip_id", "frame_idx"])
        found = steps.cut(words.select("clip_id", "frame_idx", "rank", "pos", "word", "confidence"), "words")
        read = found if read is None else read.unionByName(found)
    return read


def from_table(seen: DataFrame) -> Look:
    """A look that takes what is known of the frames (clip_id, frame_idx, ...) from a table."""
    return lambda wanted: wanted.select("clip_id", "window_id", "frame_idx").join(seen, ["clip_id", "frame_idx"])


def eyes_for_stills(config: Config, boxes: DataFrame | None = None, words: DataFrame | None = None, reader: str | None = None) -> Eyes:
    """Eyes for listings of stills (path, length): boxes from a table or from the registered batch detectors that ``config.detect`` names.

    A glance counts boxes of plausible shape; with a table of boxes it opens no
    file but for the frames' sizes. A stare makes the window's masks, a clip of its own, and counts boxes
    that are tall enough and run level in them. Words come from a table or from
    the registered ``reader``.
    """
    floor = _with_floor(config)

    def found(wanted: DataFrame) -> DataFrame:
        """Boxes of the wanted frames with sizes: (clip_id, window_id, frame_idx, height, width, boxes, error, seconds)."""
        if boxes is None:
            frames = read_listed(wanted, others=("window_id",))
            return detectors.detect_frames(frames, config.detect.detectors, config.detect.batch_size, others=("window_id",))
        from ..sources.frames import still_sizes

        keys = ["clip_id", "frame_idx"]
        listed = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("det_id", "x0", "y0", "x1", "y1", "score"))).alias("b"))
        sizes = still_sizes(wanted.select(*keys, "path").distinct())
        rows = wanted.select(*keys, "window_id").join(sizes, keys).join(listed, keys, "left")
        made = F.transform("b", lambda b: F.struct(F.lit(0).alias("detector_ord"), *[b[c].cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], b["score"].cast("double").alias("score")))
        return rows.select(*keys, "window_id", "height", "width", F.coalesce(made, F.array()).cast(detectors.BOXES).alias("boxes"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"))

    def apart(rows: DataFrame) -> DataFrame:
        """Every window as a clip of its own, since windows may hold the same frames."""
        return rows.withColumn("clip_id", F.concat_ws("|", "clip_id", F.col("window_id").cast("string")))

    def together(rows: DataFrame) -> DataFrame:
        window = F.regexp_extract("clip_id", r"\|(\d+)$", 1).cast("long")
        return rows.withColumn("window_id", window).withColumn("clip_id", F.regexp_replace("clip_id", r"\|\d+$", ""))

    def glance(wanted: DataFrame) -> DataFrame:
        seen = steps.cut(apart(found(wanted)), "glances")
        kept = masks.boxes(seen, detectors.boxes_of(seen), floor(seen))
        counts = kept.groupBy("clip_id", "frame_idx").agg(F.count("*").alias("dets"))
        out = seen.select("clip_id", "frame_idx", "error", "seconds").join(counts, ["clip_id", "frame_idx"], "left").fillna({"dets": 0})
        return together(out)

    def stare(wanted: DataFrame) -> DataFrame:
        frames = steps.cut(apart(read_listed(wanted, others=("window_id",))), "window-frames")
        seen = detectors.detect_frames(frames, config.detect.detectors, config.detect.batch_size) if boxes is None else _with_table(apart(found(wanted)), frames)
        seen = steps.cut(seen, "window-boxes")
        whole = frames.where("error is null")
        dets = detectors.boxes_of(seen)
        sizes = seen.where("height is not null").select("clip_id", "frame_idx", "height", "width")
        made = floor(seen)
        shown = steps.cut(masks.run(whole, dets, made, sizes=sizes), "window-masks")
        kept = steps.cut(masks.boxes(sizes, dets, made), "window-kept")
        tilted = scan.tilts(masks.ink(shown, kept), kept, config.level)
        counted = scan.looked_at(sizes, tilted, made.filters, config.level, config.size)
        out = seen.select("clip_id", "frame_idx", "error", "seconds").join(counted.select("clip_id", "frame_idx", "dets", "tilted", "min_text_px"), ["clip_id", "frame_idx"], "left")
        return together(out.join(masks.measured(shown), ["clip_id", "frame_idx"], "left"))

    def read(wanted: DataFrame) -> DataFrame:
        if words is not None:
            return wanted.select("clip_id", "frame_idx").join(words, ["clip_id", "frame_idx"])
        seen = steps.cut(found(wanted), "evidence-boxes")
        return detectors.read_words(read_listed(wanted), detectors.boxes_of(seen), reader)

    return Eyes(glance, stare, read if words is not None or reader else None)


def _with_table(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Boxes of a table with what reading the frames came to."""
    came = frames.select("clip_id", "frame_idx", "error", "seconds")
    return found.drop("error", "seconds", "window_id").join(came, ["clip_id", "frame_idx"])


def _with_floor(config: Config) -> Callable[[DataFrame], Config]:
    """The options with the size floor of the lowest clip; ``scan.looked_at`` holds each clip to its own."""

    def made(seen: DataFrame) -> Config:
        clips = seen.where("height is not null").groupBy("clip_id").agg(F.max("height").alias("height"))
        least = gates.size_floor(clips, config.filters, config.size.min_height, config.size.min_pixels).agg(F.min("min_text_height")).first()[0]
        return config if least is None else replace(config, filters=replace(config.filters, min_text_height=max(config.filters.min_text_height, least)))

    return made
