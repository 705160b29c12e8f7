"""Triage of a folder of clips: sweep, confirm, read, as tables of plans joined to frames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Filters, Level, Reading, Scan, Size, Sweep, Thresholds
from ..functions import strings
from . import gates, measures, windows

#: Columns of the report, in order.
REPORT = (
    "clip_id", "verdict", "stage", "total_frames", "swept_frames", "sweep_hits", "frames_scanned", "text_frames", "longest_run",
    "peak_coverage", "tilted_regions", "min_text_px", "hits", "words", "depth_path", "depth_status", "rgb_action", "rgb_dest", "depth_action", "evidence", "elapsed_s", "error",
)


def planned(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Frames inside the windows of a plan (clip_id, start, count), with window_id; a window without count goes on to the end.

    Windows are dealt out to their frame numbers, so frames meet them by an
    equality join and no clip's frames meet all its windows.
    """
    numbered = plan if "window_id" in plan.columns else numbered_windows(plan)
    ends = frames.groupBy("clip_id").agg(F.max("frame_idx").alias("_end"))
    last = F.least(F.col("_end"), F.coalesce(F.col("start") + F.col("count") - 1, F.col("_end")))
    each = numbered.join(ends, "clip_id").where(last >= F.col("start"))
    each = each.select("clip_id", "window_id", F.explode(F.sequence(F.col("start").cast("long"), last.cast("long"))).alias("frame_idx"))
    return frames.drop("window_id").join(each, ["clip_id", "frame_idx"])


def numbered_windows(plan: DataFrame) -> DataFrame:
    """``plan`` with window_id, 1 for a clip's first."""
    return plan.withColumn("window_id", F.row_number().over(Window.partitionBy("clip_id").orderBy("start")).cast("long"))


def first_words(words: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` words (pos, word) of each group, in order; only these are gathered."""
    ranked = words.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("_rank") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "word")))
    return ranked.groupBy(*keys).agg(F.transform(listed, lambda x: x["word"]).alias("words"))


def tilts(ink: DataFrame, dets: DataFrame, level: Level = Level()) -> DataFrame:
    """``dets`` with tilt: the angle at which the ink (clip_id, frame_idx, det_id, x, y, v) of a box runs; null where too little says so."""
    keys = ["clip_id", "frame_idx", "det_id"]
    peak = F.max("v").over(Window.partitionBy(*keys))
    strong = ink.withColumn("_peak", peak).where(F.col("v") >= F.greatest(F.lit(8.0), F.floor(F.col("_peak") / 4))).drop("_peak")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    wide = dets.where((h >= level.min_height) & (w >= level.min_aspect * h)).select(*keys)
    enough = strong.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= level.min_ink).select(*keys)
    judged = strong.join(wide, keys).join(enough, keys)
    scores = measures.tilt_scores(measures.thinned(judged, keys, ["y", "x"], level.max_ink), keys, level.max_tilt, margin=level.margin)
    return dets.join(scores.select(*keys, "tilt"), keys, "left")


def looked_at(frames: DataFrame, dets: DataFrame, filters: Filters = Filters(), level: Level = Level(), size: Size = Size()) -> DataFrame:
    """``frames`` (clip_id, frame_idx, height) with dets, the boxes that count, and tilted, those that run aslope.

    Boxes (y0, y1, tilt) lower than the clip's floor don't count; of a frame
    whose only measurable boxes are sloped none does.
    """
    clips = frames.groupBy("clip_id").agg(F.max("height").alias("height"))
    floors = gates.size_floor(clips, filters, size.min_height, size.min_pixels)
    floors = floors.select("clip_id", F.ceil(F.round(F.col("min_text_height") * F.col("height"), 6)).alias("min_text_px"))
    tall = dets.join(floors, "clip_id").where(F.col("y1") - F.col("y0") >= F.col("min_text_px"))
    keys = ["clip_id", "frame_idx"]
    level_ones = gates.upright(tall, keys, level) if level.require else tall
    kept = level_ones.groupBy(*keys).agg(F.count("*").alias("dets"))
    tilted = tall.groupBy(*keys).agg(F.count_if(F.abs("tilt") > level.max_tilt).alias("tilted"))
    out = frames.drop("dets", "tilted").join(kept, keys, "left").join(tilted, keys, "left")
    return out.fillna({"dets": 0, "tilted": 0}).join(floors, "clip_id")


def triage(
    frames: DataFrame,
    words: DataFrame | None = None,
    pairs: DataFrame | None = None,
    copies: DataFrame | None = None,
    sweep: Sweep | None = Sweep(),
    thresholds: Thresholds = Thresholds(),
    reading: Reading = Reading(),
    scan: Scan = Scan(),
    radius: int = 10,
) -> DataFrame:
    """Report of clips from a table of all their frames (clip_id, frame_idx, coverage, dets; tilted, min_text_px, error and seconds if known).

    A clip whose sweep pays is judged only around what the sweep finds, others
    in evenly spread windows. ``staged.triage`` gives the same report and reads only
    the frames that it needs. ``words`` (clip_id, frame_idx, pos, word,
    confidence) turns a flagged clip into text or rejected; without it flagged
    is text. ``pairs`` (clip_id, depth_path, depth_status) is joined to the report, and so is ``copies``
    (clip_id, rgb_action, rgb_dest, depth_action), what copying the clip did or would do.
    """
    clips = frames.groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("total_frames"))
    worth = worth_sweeping(clips, sweep, scan, radius)
    swept = planned(frames.join(worth, "clip_id", "left_semi"), windows.sweep_plan(clips, sweep or Sweep()))
    close = windows.confirm_plan(swept_hits(swept, sweep or Sweep()), clips, scan.window_len, radius)
    blind = windows.window_plan(clips, scan.windows, scan.window_len, radius, scan.exhaustive).join(worth, "clip_id", "left_anti")
    seen = windows.scanned(planned(frames, close.unionByName(blind)), thresholds)
    best = windows.strongest(seen, reading.max_frames)
    return report(clips, swept, seen, None if words is None else words.join(best.select("clip_id", "frame_idx", "rank"), ["clip_id", "frame_idx"]), pairs, copies, sweep or Sweep(), reading)


def worth_sweeping(clips: DataFrame, sweep: Sweep | None, scan: Scan, radius: int) -> DataFrame:
    """clip_id of the clips (clip_id, total_frames) that a sweep saves frames of; none without a sweep or if all is to be read."""
    if sweep is None or scan.exhaustive:
        return clips.select("clip_id").where(F.lit(False))
    return windows.sweep_is_worth_it(clips, sweep, scan.windows, scan.window_len, radius).where("worth_it").select("clip_id")


def swept_hits(swept: DataFrame, sweep: Sweep) -> DataFrame:
    """(clip_id, frame_idx) of swept frames (window_id, dets) with boxes, of the clusters with enough of them."""
    marked = swept.withColumn("cluster", F.col("window_id")).withColumn("hit", F.col("dets") >= 1)
    found = gates.hit_clusters(marked, ["clip_id"], sweep).select("clip_id", "cluster")
    return marked.where("hit").join(found, ["clip_id", "cluster"], "left_semi").select("clip_id", "frame_idx")


def legible_words(read: DataFrame, reading: Reading) -> DataFrame:
    """clip_id, legible, words from words read (clip_id, rank, pos, word, confidence): the good ones of the first frame that has any, else the first six."""
    good = strings.legible(F.col("word"), F.col("confidence"), reading.min_chars, reading.min_confidence)
    each = read.groupBy("clip_id", "rank").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct("pos", "word")))).alias("good"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("seen")
    )
    first = F.min(F.when(F.size("good") > 0, F.struct("rank", "good")))
    said = each.groupBy("clip_id").agg(first.alias("first"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seen"))), lambda r: r["seen"])).alias("seen"))
    chosen = F.coalesce(F.col("first.good"), F.slice("seen", 1, 6))
    return said.select("clip_id", F.col("first").isNotNull().alias("legible"), F.transform(chosen, lambda w: w["word"]).alias("words"))


def failures(*looked: DataFrame | None) -> DataFrame | None:
    """(clip_id, error): the first that went wrong, in the order of the tables given, which may have ``error``; None if none has."""
    told = [t.where("error is not null").select("clip_id", F.struct(F.lit(k).alias("k"), "window_id", "frame_idx", "error").alias("e")) for k, t in enumerate(looked) if t is not None and "error" in t.columns]
    if not told:
        return None
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    return every.groupBy("clip_id").agg(F.min("e")["error"].alias("error"))


def report(
    clips: DataFrame,
    swept: DataFrame,
    seen: DataFrame,
    read: DataFrame | None,
    pairs: DataFrame | None,
    copies: DataFrame | None,
    sweep: Sweep,
    reading: Reading,
) -> DataFrame:
    """One row per clip from what was swept (window_id, frame_idx, dets), scanned (``windows.scanned``) and read (words with rank).

    A clip of which a frame could not be looked at before it was flagged is an error.
    """
    hits = swept_hits(swept, sweep)
    looked = swept.groupBy("clip_id").agg(F.count("*").alias("swept_frames"))
    looked = looked.join(hits.groupBy("clip_id").agg(F.count("*").alias("sweep_hits")), "clip_id", "left").fillna({"sweep_hits": 0})
    zero, whole = F.lit(0).cast("long"), F.lit(None).cast("long")
    more = seen.groupBy("clip_id").agg(
        (F.sum("tilted") if "tilted" in seen.columns else F.max(zero)).alias("tilted_regions"), (F.max("min_text_px") if "min_text_px" in seen.columns else F.max(whole)).alias("min_text_px")
    )
    out = clips.join(looked, "clip_id", "left").join(windows.counted(seen), "clip_id", "left").join(more, "clip_id", "left")
    out = out.fillna({"flagged": False, "tilted_regions": 0})
    if read is not None:
        out = out.join(legible_words(read, reading), "clip_id", "left").withColumn("words", F.when(F.col("flagged"), F.col("words")))
        text = F.coalesce("legible", F.lit(False)) | F.lit(not reading.require)
    else:
        out, text = out.withColumn("words", F.array().cast("array<string>")), F.lit(True)
    spent = [t.groupBy("clip_id").agg(F.sum("seconds").alias("s")) for t in (swept, seen) if "seconds" in t.columns]
    if spent:
        total = spent[0] if len(spent) == 1 else spent[0].unionByName(spent[1])
        out = out.join(total.groupBy("clip_id").agg(F.sum("s").alias("elapsed_s")), "clip_id", "left")
    else:
        out = out.withColumn("elapsed_s", F.lit(None).cast("double"))
    failed = failures(swept, seen)
    out = out.withColumn("error", F.lit(None).cast("string")) if failed is None else out.join(failed, "clip_id", "left")
    if pairs is not None:
        out = out.join(pairs.select("clip_id", "depth_path", "depth_status"), "clip_id", "left")
    else:
        out = out.withColumns({"depth_path": F.lit(None).cast("string"), "depth_status": F.lit(None).cast("string")})
    done = ("rgb_action", "rgb_dest", "depth_action")
    if copies is not None:
        out = out.join(copies.select("clip_id", *done), "clip_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in done})
    stage = F.when(F.col("frames_scanned").isNull(), "swept").when(F.col("flagged") & F.lit(read is not None), "read").otherwise("confirmed")
    verdict = F.when(F.col("error").isNotNull(), "error").when(~F.col("flagged"), "clean").when(text, "text").otherwise("rejected")
    evidence = F.format_string("%d/%d frames, run %d, peak %.2e", "text_frames", "frames_scanned", "longest_run", "peak_coverage")
    out = out.withColumns({"stage": stage, "verdict": verdict, "evidence": F.when(F.col("frames_scanned").isNotNull(), evidence)})
    return out.select(*REPORT)


def write_report(report: DataFrame, path: str) -> None:
    """The report as CSV with a header; lists are joined by blanks."""
    flat = report.withColumns({c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))) for c in ("hits", "words")})
    flat.write.option("header", True).mode("append").csv(path)


def not_reported(spark: SparkSession, frames: DataFrame, path: str) -> DataFrame:
    """``frames`` of the clips that the report at ``path`` does not have yet, for going on after an end; all if there is none."""
    try:
        done = spark.read.option("header", True).csv(path).select("clip_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return frames
    return gates.not_done(frames, done.select(F.col("clip_id").cast(frames.schema["clip_id"].dataType)), "clip_id")
