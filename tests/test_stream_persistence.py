import random

import pytest
from pyspark.sql import functions as F

from filmloom.config import Filters
from filmloom.operators import tracks
from filmloom.streaming import verdicts as S
from filmloom.streaming.persistence import stream_persistence

BOXES = "clip_id long, frame_idx long, det_id long, x0 long, y0 long, x1 long, y1 long"


def stream(spark, folder, *batches):
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, BOXES).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if k + 1 < len(batches) else 0)
    return spark.readStream.schema(BOXES).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drawn(clip, rng, n):
    """A caption that stays for some frames, and boxes that come and go."""
    rows = []
    for i in range(n):
        if i % 11 < 5:
            rows.append((clip, i, 0, 10, 10, 60, 20))
        if rng.random() < 0.5:
            x, y = rng.randrange(80), rng.randrange(80)
            rows.append((clip, i, 1, x, y, x + 30, y + 10))
    return rows


@pytest.mark.parametrize("options", [Filters(), Filters(min_persist_frames=2, allow_vertical_scroll=True), Filters(persist_window=3)])
def test_stream_equals_table(spark, tmp_path, options):
    rng = random.Random(3)
    rows = [x for clip in (1, 2) for x in drawn(clip, rng, 30)]
    early, late = [x for x in rows if x[1] < 17], [x for x in rows if x[1] >= 17]
    end = [(0, 1000, 0, 0, 0, 0, 0)]
    frames = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(30)], "clip_id long, frame_idx long")
    ends = frames.groupBy("clip_id").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    made = S.drained(spark, stream_persistence(stream(spark, tmp_path / "in", early, late, end), ends, options), "append")
    want = tracks.persistence(spark.createDataFrame(rows, BOXES), frames, options).select(made.columns)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


def test_late_boxes_are_left_out_and_long_windows_refused(spark, tmp_path):
    at = [(1, i, 0, 10, 10, 60, 20) for i in range(40)]
    batches = [x for x in at if x[1] != 5], [(0, 100, 0, 0, 0, 0, 0)], [at[5]], [(0, 1000, 0, 0, 0, 0, 0)]
    ends = spark.createDataFrame([(1, 0, 39)], "clip_id long, first long, last long")
    made = S.drained(spark, stream_persistence(stream(spark, tmp_path / "in", *batches), ends), "append")
    hits = {r.frame_idx: r.hits for r in made.collect()}
    assert 5 not in hits and len(hits) == 39 and hits[6] == 8 and hits[20] == 9
    with pytest.raises(ValueError):
        stream_persistence(made, ends, Filters(persist_window=101))


def test_state_is_a_row_a_clip_and_block_not_one_a_pair(spark, tmp_path):
    rows = [(clip, i, k, 10, 10, 60, 20) for clip in (1, 2) for i in range(18) for k in range(5)]
    ends = spark.createDataFrame([(1, 0, 17), (2, 0, 17)], "clip_id long, first long, last long")
    made = stream_persistence(stream(spark, tmp_path / "in", rows, [(0, 1000, 0, 0, 0, 0, 0)]), ends)
    run = S.to_files(made, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    held = max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in run.recentProgress)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 180 and held <= 2 * 4 + 2


def test_boxes_of_the_newest_frame_may_come_in_two_triggers(spark, tmp_path):
    early = [(1, i, 0, 10, 10, 60, 20) for i in range(4)] + [(1, 4, 0, 200, 10, 260, 20)]
    more = [(1, 4, 1, 10, 10, 60, 20)]
    ends = spark.createDataFrame([(1, 0, 4)], "clip_id long, first long, last long")
    made = S.drained(spark, stream_persistence(stream(spark, tmp_path / "in", early, more, [(0, 1000, 0, 0, 0, 0, 0)]), ends), "append")
    assert {(r.frame_idx, r.det_id): r.hits for r in made.collect()} == {(0, 0): 5, (1, 0): 5, (2, 0): 5, (3, 0): 5, (4, 0): 1, (4, 1): 5}


def test_rows_of_one_box_are_one_and_boxes_without_sides_meet_nothing(spark, tmp_path):
    rows = [(1, 0, 7, 10, 10, 60, 20), (1, 0, 7, 300, 10, 360, 20), (1, 1, None, 10, 10, 60, 20), (1, 2, 1, 300, 10, 360, 20), (1, 1, 2, None, 10, 60, 20)]
    ends = spark.createDataFrame([(1, 0, 2)], "clip_id long, first long, last long")
    made = S.drained(spark, stream_persistence(stream(spark, tmp_path / "in", rows, [(0, 1000, 0, 0, 0, 0, 0)]), ends), "append")
    assert sorted((r.frame_idx, r.det_id or 0, r.hits) for r in made.collect()) == [(0, 7, 3), (1, 0, 2), (2, 1, 2)]


def test_many_streams_give_what_one_gives(spark, data, monkeypatch):
    from filmloom.plans import queries

    want = queries.persistence_gate(spark, data)
    monkeypatch.setattr(queries, "STREAM_BOXES", 500)
    got = queries.stream_persistence(spark, data).select(want.columns)
    assert want.count() > 2000 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_comparisons_of_arrays_are_those_of_columns(spark):
    import numpy as np

    from filmloom.functions import boxes
    from filmloom.streaming import persistence

    rng = np.random.default_rng(5)
    low, size = rng.integers(0, 4, (2000, 4)), rng.integers(-1, 20, (2000, 4))
    rows = np.stack([low[:, 0], low[:, 1], low[:, 0] + size[:, 0], low[:, 1] + size[:, 1], low[:, 2], low[:, 3], low[:, 2] + size[:, 2], low[:, 3] + size[:, 3]], 1)
    table = spark.createDataFrame(rows.tolist(), ", ".join(f"{c} long" for c in ("x0", "y0", "x1", "y1", "_x0", "_y0", "_x1", "_y1")))
    want = table.select(boxes.iou_at_least(boxes.box(), boxes.box("_"), 30), boxes.scrolled(boxes.box(), boxes.box("_"))).collect()
    a, b = list(rows.T[:4]), list(rows.T[4:])
    assert [tuple(r) for r in want] == list(zip(persistence._iou_at_least(a, b, 30).tolist(), persistence._scrolled(a, b).tolist()))
    assert 20 < sum(r[0] for r in want) < 1980 and 20 < sum(r[1] for r in want) < 1980
