"""The persistence gate over a stream of boxes: blocks of frames gathered under watermarks, their boxes compared in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import Filters
from .verdicts import with_event_time

SIDES = ("x0", "y0", "x1", "y1")
#: Pairs of boxes that are compared at once; their arrays stay in a core's cache.
PAIRS = 1 << 16


def stream_persistence(dets: DataFrame, ends: DataFrame, options: Filters = Filters(), start: str = "2000-01-01", fps_num: int = 1, fps_den: int = 1, late_frames: int = 0) -> DataFrame:
    """(clip_id, frame_idx, det_id, hits, required, keep) of a stream (clip_id, frame_idx, det_id, x0, y0, x1, y1), as ``tracks.persistence`` has them.

    ``ends`` is a table (clip_id, first, last) of the clips' frames; boxes of
    other clips are left out. State is a row for each clip and block of as many
    frames as the window has, with the boxes of these frames and of the radius
    on both sides, so a box is held twice at most. It goes once the watermark,
    which trails by the radius, ``late_frames`` and up to a block, has passed
    the block's last frame. A block's boxes come out when no frame of their
    windows can arrive any more; boxes that come a trigger or more after that
    are dropped. At the end of all input a box without area at a later frame
    moves the watermark on; such boxes meet nothing and never come out.
    """
    radius = options.persist_window // 2
    if 2 * radius >= 63:
        raise ValueError("a stream's persistence window is at most 63 frames")
    length = 2 * radius + 1
    # a box moves the watermark by the last frame of the last block that it lies in, at most radius + length - 1 frames on
    delay = -(-(2 * radius + length - 1 + late_frames) * 1_000_000 * fps_den // fps_num) + 1
    at = F.col("frame_idx").cast("long")
    first, last = (at + d - F.pmod(at + d, F.lit(length)) for d in (-radius, radius))
    whole = dets.dropna(subset=["clip_id", "frame_idx", *SIDES])
    box = F.struct(at.alias("frame_idx"), "det_id", *SIDES).alias("_box")
    dealt = whole.select("clip_id", box, F.explode(F.sequence(first, last, F.lit(length).cast("long"))).alias("_block"))
    shown = with_event_time(dealt.withColumn("frame_idx", F.col("_block") + length - 1), start, fps_num, fps_den)
    blocks = shown.withWatermark("ts", f"{delay} microseconds").groupBy("ts", "clip_id", "_block").agg(F.collect_list("_box").alias("_boxes"))
    fields = {f.name: f.dataType for f in dets.schema}
    out = StructType([StructField(c, t) for c, t in (("clip_id", fields["clip_id"]), ("frame_idx", LongType()), ("det_id", fields["det_id"]), ("hits", LongType()))])
    met = _meeting(radius, length, round(100 * options.persist_iou), options.allow_vertical_scroll)
    found = blocks.select("clip_id", "_block", "_boxes").mapInArrow(met, out).withColumn("frame_idx", F.col("frame_idx").cast(fields["frame_idx"]))
    # the last triggers have no input, so Spark takes what comes out of the state for a table small enough to broadcast
    found = found.join(ends.select("clip_id", "first", "last").hint("merge"), "clip_id")
    window = F.least(F.col("frame_idx") + radius, F.col("last")) - F.greatest(F.col("frame_idx") - radius, F.col("first")) + 1
    required = F.least(F.lit(options.min_persist_frames).cast("long"), window)
    always = options.scene_text != "keep" or options.min_persist_frames <= 1
    return found.select("clip_id", "frame_idx", "det_id", "hits", required.alias("required"), (F.lit(True) if always else F.col("hits") >= required).alias("keep"))


def _meeting(radius: int, length: int, percent: int, scrolls: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns blocks (clip_id, _block, _boxes) into their own boxes (clip_id, frame_idx, det_id, hits); boxes that meet nothing are left out."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield _met(rows, radius, length, percent, scrolls)

    return met


def _met(rows: pa.RecordBatch, radius: int, length: int, percent: int, scrolls: bool) -> pa.RecordBatch:
    listed = rows.column("_boxes")
    flat, reach = listed.flatten(), length + 2 * radius
    block = np.repeat(np.arange(len(rows)), listed.value_lengths().to_numpy(zero_copy_only=False))
    frame = flat.field("frame_idx").to_numpy(zero_copy_only=False)
    place = block * reach + frame - rows.column("_block").to_numpy(zero_copy_only=False)[block] + radius
    det = flat.field("det_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((det, place))
    place, det, block = place[order], det[order], block[order]
    sides = [flat.field(c).to_numpy(zero_copy_only=False)[order] for c in SIDES]
    sides = [s.astype(np.int64) if s.dtype.kind in "iu" else s for s in sides]
    starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(rows) * reach))])
    own = np.flatnonzero((place % reach >= radius) & (place % reach < radius + length))
    lo, hi = starts[place[own] - radius], starts[place[own] + radius + 1]
    seen, counts = np.zeros(len(own), np.int64), hi - lo
    upto, i = np.cumsum(counts), 0
    while i < len(own):  # a box meets itself, so no count is 0
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
        n = counts[i:j]
        begin = np.cumsum(n) - n
        b = np.arange(n.sum()) - np.repeat(begin - lo[i:j], n)
        mine, others = [np.repeat(s[own[i:j]], n) for s in sides], [s[b] for s in sides]
        same = _iou_at_least(mine, others, percent)
        if scrolls:
            same |= _scrolled(mine, others)
        bits = np.left_shift(1, place[b] - np.repeat(place[own[i:j]], n) + radius) * same
        seen[i:j] = np.bitwise_or.reduceat(bits, begin)
        i = j
    if len(own):  # rows of one box are one
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place[own]) != 0) | (np.diff(det[own]) != 0)]))
        seen, own = np.bitwise_or.reduceat(seen, new), own[new]
    own, seen = own[seen != 0], seen[seen != 0]
    hits = np.bitwise_count(seen).astype(np.int64)
    columns = [rows.column("clip_id").take(pa.array(block[own])), pa.array(frame[order[own]], pa.int64()), flat.field("det_id").take(pa.array(order[own])), pa.array(hits)]
    return pa.RecordBatch.from_arrays(columns, ["clip_id", "frame_idx", "det_id", "hits"])


def _iou_at_least(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """``boxes.iou_at_least`` of arrays."""
    inter = _length(np.maximum(a[0], b[0]), np.minimum(a[2], b[2])) * _length(np.maximum(a[1], b[1]), np.minimum(a[3], b[3]))
    area = _length(a[0], a[2]) * _length(a[1], a[3]) + _length(b[0], b[2]) * _length(b[1], b[3])
    return (inter > 0) & (100 * inter >= percent * (area - inter))


def _scrolled(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``boxes.scrolled`` of arrays."""
    aw, ah, bw, bh = _length(a[0], a[2]), _length(a[1], a[3]), _length(b[0], b[2]), _length(b[1], b[3])
    shared, tall = _length(np.maximum(a[0], b[0]), np.minimum(a[2], b[2])), np.maximum(ah, bh)
    near = (100 * np.abs(aw - bw) <= 15 * np.maximum(aw, bw)) & (100 * np.abs(ah - bh) <= 20 * tall) & (10 * np.abs(a[1] - b[1]) <= 25 * tall)
    return near & (np.minimum(np.minimum(aw, ah), np.minimum(bw, bh)) > 0) & (10 * shared >= 7 * np.minimum(aw, bw))


def _length(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(high - low, 0)
