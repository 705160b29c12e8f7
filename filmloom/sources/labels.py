"""Glyph labels of clips: made from pixels, written and read as tables, and masks scored against them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..kernels import arrays as A
from . import frames

SCORE = "clip_id string, frame_idx long, iou double, recall double, precision double"
#: Pixels kept round the labelled text where only its window is scored: a fixed value.
AROUND = 60


def gathered(pixels: DataFrame, states: DataFrame, sizes: DataFrame) -> DataFrame:
    """Labels (clip_id, height, width, truth, method, on, off) of clips.

    ``pixels`` (clip_id, y, x) are the glyphs', ``states`` (clip_id,
    frame_idx, state) says which frames show them, ``sizes`` how large a clip
    is. A clip's label is one image, so a task holds no more than one clip's.
    """

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        truth = np.zeros((int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])), np.uint8)
        truth[pdf["y"], pdf["x"]] = 255
        return pd.DataFrame([(pdf["clip_id"].iloc[0], *truth.shape, truth.tobytes())], columns=["clip_id", "height", "width", "truth"])

    images = pixels.select("clip_id", "y", "x").join(sizes.select("clip_id", "height", "width"), "clip_id")
    images = images.groupBy("clip_id").applyInPandas(image, "clip_id string, height int, width int, truth binary")
    numbers = [F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("frame_idx")))).alias(s) for s in ("on", "off")]
    shown = states.groupBy("clip_id").agg(*numbers)
    method = F.when(F.size("off") > 0, "differencing").otherwise("colour").alias("method")
    return images.join(shown, "clip_id").select("clip_id", "height", "width", "truth", method, "on", "off")


def write(labels: DataFrame, path: str) -> None:
    labels.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, frame_idx, height, width, mask: of a mask cache, or of folders of stills numbered by frame."""
    try:
        return frames.read_cache(spark, path).select("clip_id", "frame_idx", "height", "width", "mask")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    stills = frames.read_stills(spark, path)
    number = strings.last_number(strings.stem(F.col("name")))

    def first_plane(batches):
        for b in batches:
            planes = [frames.array_of(d, h, w, 3, 8)[..., 0].tobytes() for d, h, w in zip(b["data"], b["height"], b["width"])]
            yield b[["clip_id", "frame_idx", "height", "width"]].assign(mask=planes)

    rows = stills.withColumn("frame_idx", number).where("frame_idx >= 0")
    return rows.mapInPandas(first_plane, "clip_id string, frame_idx long, height int, width int, mask binary")


def scored(masks: DataFrame, labels: DataFrame, window: bool = False) -> DataFrame:
    """iou, recall on the glyphs' cores and precision of every mask of a frame that shows its clip's labels.

    Masks of another size are brought to the label's; with ``window`` only
    the text's surroundings count. Frames and labels meet by equality joins.
    """
    shown = labels.select("clip_id", F.explode("on").alias("frame_idx"))
    truth = labels.select("clip_id", "truth", F.col("height").alias("_h"), F.col("width").alias("_w"))
    rows = masks.join(shown, ["clip_id", "frame_idx"]).join(truth, "clip_id")

    def run(batches):
        for b in batches:
            out = []
            for clip, i, h, w, mask, true, th, tw in zip(*(b[c] for c in b.columns)):
                true = np.frombuffer(true, np.uint8).reshape(th, tw) > 127
                found = np.frombuffer(mask, np.uint8).reshape(h, w)
                found = (found if found.shape == true.shape else A.resize(found, tw, th, "nearest")) > 127
                if window and true.any():
                    ys, xs = np.nonzero(true)
                    cut = slice(max(0, ys.min() - AROUND), ys.max() + AROUND), slice(max(0, xs.min() - AROUND), xs.max() + AROUND)
                    true, found = true[cut], found[cut]
                core, both = A.erode(true, np.ones((3, 3), bool)), float((found & true).sum())
                shares = both / max((found | true).sum(), 1), (found & core).sum() / max(core.sum(), 1), both / max(found.sum(), 1)
                out.append((clip, i, *map(float, shares)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORE.split(", ")])

    return rows.select("clip_id", "frame_idx", "height", "width", "mask", "truth", "_h", "_w").mapInPandas(run, SCORE)
