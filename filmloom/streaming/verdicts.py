"""Verdicts over streams of frames: state per clip, early stop, look-ahead windows, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import steps
from ..config import Thresholds

VERDICT = "clip_id long, frames_scanned long, text_frames long, longest_run long, peak_coverage double, flagged boolean, late long"
STATE = "scanned long, hits long, run long, longest long, peak double, flagged boolean, late long, newest long"


def _in_order(batches: Iterator[pd.DataFrame], newest: int) -> tuple[pd.DataFrame, int]:
    """Rows of one trigger by frame, and how many come too late: at or before a frame that was counted already."""
    rows = pd.concat(list(batches)).sort_values("frame_idx")
    fresh = rows[rows["frame_idx"] > newest]
    return fresh, len(rows) - len(fresh)


def stream_verdicts(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Running verdict of each clip from a stream (clip_id, frame_idx, coverage, dets).

    Within a trigger frames are sorted. A frame that comes after a later one
    was counted can't be part of a run any more: it is left out and counted as
    ``late``. Once a clip is flagged its later frames are dropped unread.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanned, hits, run, longest, peak, flagged, late, newest = state.get if state.exists else (0, 0, 0, 0, 0.0, False, 0, -1)
        rows, more = _in_order(batches, newest)
        late += more
        for i, coverage, dets in zip(rows["frame_idx"], rows["coverage"], rows["dets"]):
            if flagged:
                break
            scanned, peak, newest = scanned + 1, max(peak, float(coverage)), int(i)
            run = run + 1 if dets >= 1 and coverage >= t.min_coverage else 0
            hits, longest = hits + (run > 0), max(longest, run)
            flagged = hits >= t.min_text_frames and longest >= t.min_run
        state.update((scanned, hits, run, longest, peak, flagged, late, newest))
        yield pd.DataFrame([(key[0], scanned, hits, longest, peak, flagged, late)], columns=[c.split()[0] for c in VERDICT.split(", ")])

    return frames.groupBy("clip_id").applyInPandasWithState(update, VERDICT, STATE, "update", GroupStateTimeout.NoTimeout)


def stream_carry_forward(frames: DataFrame, every: int) -> DataFrame:
    """A stream (clip_id, frame_idx, v) in which frames whose index ``every`` does not divide show what the last such frame did.

    Before the first such frame the value is null. Frames that come late are
    left out, as in ``stream_verdicts``.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, held = state.get if state.exists else (-1, None)
        rows, _ = _in_order(batches, newest)
        out = []
        for i, v in zip(rows["frame_idx"], rows["v"]):
            newest, held = int(i), (None if pd.isna(v) else float(v)) if i % every == 0 else held
            out.append((key[0], newest, held))
        state.update((newest, held))
        yield pd.DataFrame(out, columns=["clip_id", "frame_idx", "v"]).astype({"v": float})

    return frames.groupBy("clip_id").applyInPandasWithState(update, SMOOTH, "newest long, held double", "append", GroupStateTimeout.NoTimeout)


SMOOTH = "clip_id long, frame_idx long, v double"


def stream_medians(frames: DataFrame, radius: int) -> DataFrame:
    """Centred medians (clip_id, frame_idx, v) of a stream (clip_id, frame_idx, v, last).

    A frame comes out when ``radius`` later ones have arrived, or when the
    clip's last frame has; windows are cut off at both ends. State holds at
    most 2 * radius + 1 values of a clip. Frames that come late are left out.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, values, done = state.get if state.exists else ([], [], 0)
        held = list(zip(index, values))  # the first ``done`` of them are out already
        out = []

        def emit(k):
            near = sorted(v for _, v in held[max(0, k - radius) : k + radius + 1])
            n = len(near)
            out.append((key[0], held[k][0], (near[(n - 1) // 2] + near[n // 2]) / 2))

        rows, _ = _in_order(batches, held[-1][0] if held else -1)
        for i, v, last in zip(rows["frame_idx"], rows["v"], rows["last"]):
            held.append((int(i), float(v)))
            while done + radius < len(held):
                emit(done)
                done += 1
            drop = max(0, done - radius)
            held, done = held[drop:], done - drop
            if last:
                for k in range(done, len(held)):
                    emit(k)
                done = len(held)
        state.update(([i for i, _ in held], [v for _, v in held], done))
        yield pd.DataFrame(out, columns=["clip_id", "frame_idx", "v"])

    return frames.groupBy("clip_id").applyInPandasWithState(update, SMOOTH, "index array<long>, held array<double>, done long", "append", GroupStateTimeout.NoTimeout)


def with_event_time(frames: DataFrame, start: str, fps_num: int, fps_den: int) -> DataFrame:
    """``frames`` with ts, the moment at which a frame shows."""
    micros = F.floor(F.col("frame_idx") * 1_000_000 * fps_den / fps_num).cast("long")
    return frames.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + micros))


def hit_sessions(hits: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """Sessions of hits (clip_id, ts): a new one after a pause of ``gap``."""
    s = F.session_window("ts", gap)
    out = hits.withWatermark("ts", late).groupBy("clip_id", s).agg(F.count("*").alias("hits"))
    return out.select("clip_id", F.col("session_window.start").alias("start"), "hits")


def tumbling_hits(hits: DataFrame, length: str, late: str = "0 seconds") -> DataFrame:
    """Hits per clip and window of fixed length; frames later than ``late`` are left out."""
    w = F.window("ts", length)
    out = hits.withWatermark("ts", late).groupBy("clip_id", w).agg(F.count("*").alias("hits"), F.max("coverage").alias("peak"))
    return out.select("clip_id", F.col("window.start").alias("start"), "hits", "peak")


def to_files(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what has arrived, each trigger's rows in a folder of its own; a trigger that is run again replaces its rows.

    Started again with the same ``checkpoint`` it goes on where it ended.
    """

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/trigger={trigger}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint)
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream over finished input gives, as a table of files; of a complete result the last."""
    folder = steps.fresh(spark, "drained")
    run = to_files(stream, f"{folder}/rows", f"{folder}/state", mode)
    if run.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("trigger", "long")).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("trigger") == rows.agg(F.max("trigger")).first()[0])
    return rows.drop("trigger")
