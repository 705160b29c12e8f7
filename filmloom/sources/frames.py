"""Tables of frames: from folders of stills, from arrays, and the mask cache."""

from __future__ import annotations

import json
import re
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import pairing
from . import files, stills

FRAME = "clip_id string, frame_idx long, name string, height int, width int, channels int, bits int, data binary"


def few_frames(spark: SparkSession, frame_bytes: int, budget: int = 64 << 20) -> None:
    """Bound an Arrow batch of frames by bytes: a record batch holds about ``budget`` bytes of pixels."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, budget // max(1, frame_bytes))))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame_idx, path, length) of the stills below ``path``, which stay unread; a folder is a clip, its order that of the trailing numbers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    order = pairing.frame_order(found.select("path", "length"))
    return order.select(F.col("folder").alias("clip_id"), "frame_idx", "path", "length")


def frame_row(content: bytes, rgb: bool) -> tuple:
    """(height, width, channels, bits, data) of a still."""
    image = stills.decode(content)
    image = stills.as_rgb(image) if rgb else image
    return (*image.shape[:2], 1 if image.ndim == 2 else image.shape[2], image.dtype.itemsize * 8, image.tobytes())


def read_listed(rows: DataFrame, rgb: bool = True, task_bytes: int = 64 << 20, others: tuple[str, ...] = ()) -> DataFrame:
    """The frames of ``rows`` (clip_id, frame_idx, path, length), each file opened in a task, and no other; with error and seconds.

    A still that can't be read or decoded gives a row without pixels that says why. ``others`` are columns to keep.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // task_bytes) * 4, rows.count()), spark.sparkContext.defaultParallelism)
    kinds = dict(rows.dtypes)
    schema = f"{FRAME}, path string, error string, seconds double" + "".join(f", {c} {kinds[c]}" for c in others)
    names = [x.split()[0] for x in FRAME.split(", ")] + ["path", "error", "seconds", *others]

    def run(batches):
        for b in batches:
            out, held = [], 0
            for clip, idx, path, *rest in zip(*(b[c] for c in b.columns)):
                start, failed, made = time.perf_counter(), None, (None,) * 5
                try:
                    made = frame_row(files.whole(path), rgb)
                except (OSError, ValueError) as e:
                    failed = f"{type(e).__name__}: {e}"
                out.append((clip, idx, path.rsplit("/", 1)[-1], *made, path, failed, time.perf_counter() - start, *rest))
                held += len(made[-1] or b"")
                if held > task_bytes:
                    yield frame_table(out, names)
                    out, held = [], 0
            if out:
                yield frame_table(out, names)

    dealt = rows.select("clip_id", "frame_idx", "path", *others).repartition(tasks, "clip_id", "frame_idx")
    few_frames(spark, 8 << 20)
    return dealt.mapInPandas(run, schema)


def frame_table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("height", "width", "channels", "bits")})


def still_sizes(rows: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, height, width) of stills (path): from the first bytes of a file, where its format allows."""

    def run(batches):
        for b in batches:
            sizes = [stills.size_of(files.head(p, 4096), lambda p=p: files.whole(p)) for p in b["path"]]
            yield pd.DataFrame({"clip_id": b["clip_id"], "frame_idx": b["frame_idx"], "height": [h for h, _ in sizes], "width": [w for _, w in sizes]})

    dealt = rows.select("clip_id", "frame_idx", "path").repartition(rows.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.mapInPandas(run, "clip_id string, frame_idx long, height int, width int")


def read_stills(spark: SparkSession, path: str, rgb: bool = True, frame_bytes: int = 8 << 20) -> DataFrame:
    """Frames of every folder of stills below ``path``; a damaged still raises."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.where(strings.suffix(F.col("path")).isin(*pairing.STILL_SUFFIXES))
    order = pairing.frame_order(found.select("path")).select("path", "folder", "frame_idx")
    rows = found.select("path", "content").join(order, "path")

    def run(batches):
        for b in batches:
            out = []
            for folder, idx, p, content in zip(b["folder"], b["frame_idx"], b["path"], b["content"]):
                out.append((folder, idx, p.rsplit("/", 1)[-1], *frame_row(content, rgb)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FRAME.split(", ")])

    few_frames(spark, frame_bytes)
    return rows.select("folder", "frame_idx", "path", "content").mapInPandas(run, FRAME)


def sequence_info(frames: DataFrame) -> DataFrame:
    """Per clip of stills: size, bits, channels, how many there are, and range, which is pc for stills always."""
    first = F.min_by(F.struct("height", "width", "channels", "bits"), "frame_idx").alias("_first")
    each = frames.groupBy("clip_id").agg(first, F.count("*").alias("frames"))
    return each.select("clip_id", "_first.*", "frames", F.lit("pc").alias("range"))


def folder_names(frames: DataFrame) -> DataFrame:
    """clip_id -> folder: the clip's last name; clips that share it get a number as well, in the order of their ids."""
    last = F.regexp_extract("clip_id", r"([^/]+)/*$", 1)
    named = frames.select("clip_id").distinct().withColumn("_last", last)
    k = F.row_number().over(Window.partitionBy("_last").orderBy("clip_id"))
    many = F.count("*").over(Window.partitionBy("_last"))
    return named.select("clip_id", F.when(many > 1, F.concat("_last", F.lit("-"), k.cast("string"))).otherwise(F.col("_last")).alias("folder"))


def write_stills(frames: DataFrame, folder: str) -> DataFrame:
    """(clip_id, name, path): every frame as a still under its own name; an unknown extension becomes .png.

    ``folder`` is a path in Spark's default store or an address, shared by all
    executors; a file appears under its name only when it is whole.
    """
    folder = files.qualified(frames.sparkSession, folder)

    def run(batches):
        store, base = files.located(folder)
        for b in batches:
            out = []
            for clip, name, h, w, c, bits, data, sub in zip(*(b[k] for k in ("clip_id", "name", "height", "width", "channels", "bits", "data", "folder"))):
                image = array_of(data, h, w, c, bits)
                stem, dot, ext = name.rpartition(".")
                ext = f".{ext.lower()}" if dot and f".{ext.lower()}" in (".png", ".pgm", ".ppm") else ".png"
                to = f"{base}/{sub}/{stem or name}{ext}"
                store.create_dir(f"{base}/{sub}", recursive=True)
                with store.open_output_stream(f"{to}.part") as f:
                    f.write(stills.encode(image, ext))
                store.move(f"{to}.part", to)
                out.append((clip, name, to))
            yield pd.DataFrame(out, columns=["clip_id", "name", "path"])

    return frames.join(folder_names(frames), "clip_id").mapInPandas(run, "clip_id string, name string, path string")


def array_of(data: bytes, height: int, width: int, channels: int, bits: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint16 if bits > 8 else np.uint8)
    if a.size != height * width * channels:
        raise ValueError(f"frame of {a.size} values; {height} x {width} x {channels} expected")
    return a.reshape((height, width) if channels == 1 else (height, width, channels))


def write_cache(masks: DataFrame, path: str, meta: dict) -> None:
    """Masks (clip_id, frame_idx, ...) as Parquet by clip, then the sidecar that says what they were made from."""
    masks.write.partitionBy("clip_id").parquet(f"{path}/masks")
    spark = masks.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.text(f"{path}/meta")


def read_cache(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """The cached masks; ValueError if they were made from another source."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if fingerprint is not None and meta.get("fingerprint") != fingerprint:
        raise ValueError("the mask cache belongs to another source")
    return spark.read.parquet(f"{path}/masks")


def synthetic(spark: SparkSession, clips: int | DataFrame = 2, frames: int = 24, width: int = 160, height: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rgb frames, depth frames, detections) of clips (so many, or those of a table) with a burned-in line in the middle half of their frames."""
    if isinstance(clips, int):
        clips = spark.range(clips).select(F.concat(F.lit("clip"), F.col("id").cast("string")).alias("clip_id"))
    base = clips.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))).alias("frame_idx"))
    shown = F.col("frame_idx").between(frames // 4, 3 * frames // 4)
    boxes = base.where(shown).select(
        "clip_id", "frame_idx", F.lit(1).cast("long").alias("det_id"),
        F.lit(width // 4).cast("long").alias("x0"), F.lit(height * 3 // 4 - 2).cast("long").alias("y0"),
        F.lit(width * 3 // 4).cast("long").alias("x1"), F.lit(height * 3 // 4 + 14).cast("long").alias("y1"), F.lit(0.9).alias("score"),
    )

    def draw(depth):
        def run(batches):
            for b in batches:
                out = []
                for clip, i in zip(b["clip_id"], b["frame_idx"]):
                    y, x = np.mgrid[0:height, 0:width]
                    scene = 70 + 30 * np.sin((x + i) / 23.0) + 20 * np.cos(y / 17.0)
                    text = np.zeros((height, width), bool)
                    if frames // 4 <= i <= 3 * frames // 4:
                        for k in range(width // 4 + 4, width * 3 // 4 - 6, 9):
                            text[height * 3 // 4 : height * 3 // 4 + 11, k : k + 3] = True
                    if depth:
                        image = np.where(text, 900, 300 + scene).astype(np.uint16)
                    else:
                        image = np.repeat(np.where(text, 250, scene).astype(np.uint8)[..., None], 3, axis=2)
                    out.append((clip, i, f"f{i:05d}.png", height, width, 1 if depth else 3, 16 if depth else 8, image.tobytes()))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in FRAME.split(", ")])

        return base.mapInPandas(run, FRAME)

    return draw(False), draw(True), boxes


def write_depth(frames: DataFrame, out: str) -> str:
    """Depth frames as ``out`` asks: a folder of stills, or a table if it ends in .parquet; stills or table is returned.

    Any other extension names a film, which nothing here can encode: ValueError.
    """
    ext = re.search(r"\.[A-Za-z][A-Za-z0-9]{1,4}$", out.rstrip("/"))
    if ext and ext[0].lower() != ".parquet":
        raise ValueError(f"{out}: depth goes out as a folder of stills or a .parquet table, not as {ext[0]}")
    if out.rstrip("/").endswith(".parquet"):
        frames.write.partitionBy("clip_id").parquet(out)
        return "table"
    write_stills(frames, out).write.format("noop").mode("overwrite").save()
    return "stills"


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Depth frames from a table that ``write_depth`` wrote, or from folders of stills."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_stills(spark, path, rgb=False)
