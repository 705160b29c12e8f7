"""Pairing of streams and files: zips by position, offsets, depth maps by name, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings

#: Extensions of films; fixed values.
FILM_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".m4v")
#: Extensions of stills; fixed values.
STILL_SUFFIXES = (".png", ".tif", ".tiff", ".ppm", ".pgm")


def zipped(left: DataFrame, right: DataFrame, left_offset: int = 0, right_offset: int = 0) -> DataFrame:
    """Rows of two streams at the same position after dropping ``*_offset`` leading frames; the shorter ends it."""
    a = left.where(F.col("frame_idx") >= left_offset).withColumn("frame_idx", F.col("frame_idx") - left_offset)
    b = right.where(F.col("frame_idx") >= right_offset).withColumn("frame_idx", F.col("frame_idx") - right_offset)
    return a.join(b, ["clip_id", "frame_idx"])


def stretch(frames: DataFrame, start: int = 0, seek: int = 0, most: int | None = None) -> DataFrame:
    """Frames from ``start + seek`` on, ``most`` at most, by their index and not by arrival."""
    first = start + seek
    out = frames.where(F.col("frame_idx") >= first)
    return out if most is None else out.where(F.col("frame_idx") < first + most)


def sampled(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames whose index is among ``wanted`` (clip_id, frame_idx), once each; negative ones are ignored."""
    return frames.join(wanted.where("frame_idx >= 0").distinct(), ["clip_id", "frame_idx"], "left_semi")


def frame_order(files: DataFrame) -> DataFrame:
    """Stills (path) of each folder with frame_idx: by the last number in the stem, then the lower name."""
    still = files.where(strings.suffix(F.col("path")).isin(*STILL_SUFFIXES))
    named = still.select(
        "*",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"),
        strings.last_number(strings.stem(F.col("path"))).alias("number"),
        F.lower(strings.file_name(F.col("path"))).alias("_name"),
    )
    order = Window.partitionBy("folder").orderBy("number", "_name", "path")
    return named.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long")).drop("_name")


def is_sequence(files: DataFrame) -> DataFrame:
    """Folders with at least one still, and how many."""
    return frame_order(files).groupBy("folder").agg(F.count("*").alias("stills"))


def collapsed(files: DataFrame) -> DataFrame:
    """``files`` (path, is_dir) with ``clip``: the folder of a still, which stands for all of its sequence, else the path itself."""
    still = ~F.col("is_dir") & strings.suffix(F.col("path")).isin(*STILL_SUFFIXES)
    return files.withColumn("clip", F.when(still, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.col("path")))


def clip_key(path: Column, is_dir: Column) -> Column:
    return F.lower(F.when(is_dir, strings.file_name(path)).otherwise(strings.stem(path)))


def depth_index(files: DataFrame) -> DataFrame:
    """key -> sorted paths of all files with that key."""
    keyed = files.select(clip_key(F.col("path"), F.col("is_dir")).alias("key"), "path")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n"))


def find_depth(clips: DataFrame, files: DataFrame) -> DataFrame:
    """Clips (path, is_dir) with depth_path and status: found, missing or ambiguous.

    Of several matches a folder goes with a folder and a file with a file,
    then films and folders come before loose stills, then the name decides.
    """
    want = clips.select("*", F.concat(clip_key(F.col("path"), F.col("is_dir")), F.lit("_depth")).alias("_want"))
    have = files.select(
        clip_key(F.col("path"), F.col("is_dir")).alias("_want"), F.col("path").alias("_path"), F.col("is_dir").alias("_dir")
    )
    rank = F.struct(
        F.when(F.col("_dir") == F.col("is_dir"), 0).otherwise(1).alias("shape"),
        F.when(strings.suffix(F.col("_path")).isin(*FILM_SUFFIXES) | F.col("_dir"), 0).otherwise(1).alias("kind"),
        F.lower(strings.file_name(F.col("_path"))).alias("name"),
        F.col("_path").alias("path"),
    )
    best = want.join(have, "_want", "left").groupBy(*clips.columns).agg(
        F.min(F.when(F.col("_path").isNotNull(), rank)).alias("_best"), F.count("_path").alias("_n")
    )
    status = F.when(F.col("_n") == 0, "missing").when(F.col("_n") == 1, "found").otherwise("ambiguous")
    return best.select(*clips.columns, F.col("_best.path").alias("depth_path"), status.alias("status"))


def copy_plan(moves: DataFrame, there: DataFrame, move: bool = False) -> DataFrame:
    """What copying src (src_size, src_dir) to dst would do; nothing is ever overwritten."""
    have = there.select(F.col("path").alias("dst"), F.col("size").alias("_size"), F.col("is_dir").alias("_dir"))
    joined = moves.join(have, "dst", "left")
    action = (
        F.when(F.col("_dir").isNull(), "moved" if move else "copied")
        .when(F.col("_dir") | F.col("src_dir") | (F.col("_size") == F.col("src_size")), "exists")
        .otherwise("exists (differs)")
    )
    return joined.select(*moves.columns, action.alias("action"))


def alignment_notes(pairs: DataFrame) -> DataFrame:
    """Pairs with ``notes``, what is worth knowing about an RGB clip (rgb_*) and its depth map (depth_*)."""
    c = F.col
    size = (c("rgb_width") != c("depth_width")) | (c("rgb_height") != c("depth_height"))
    count = (c("rgb_frames") > 0) & (c("depth_frames") > 0) & (c("rgb_frames") != c("depth_frames"))
    exact = c("rgb_exact") & c("depth_exact")
    rate = c("rgb_fps_num") * c("depth_fps_den") != c("depth_fps_num") * c("rgb_fps_den")
    notes = F.array(
        F.when(size, "resolution differs"),
        F.when(count & exact, "frame count differs"),
        F.when(count & ~exact, "frame counts are estimated"),
        F.when(rate, "fps differs"),
        F.when(c("depth_bits") < 10, F.concat(F.lit("depth map is "), c("depth_bits").cast("string"), F.lit("-bit"))),
    )
    return pairs.withColumn("notes", F.array_compact(notes))
