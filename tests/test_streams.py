import pytest

from filmloom.streaming import verdicts as S

FRAMES = "clip_id long, frame_idx long, coverage double, dets long"


def arrived(spark, folder, *batches, schema=FRAMES):
    """A stream of files, one a trigger, in this order."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1 if k + 1 < len(batches) else 0)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_frames_are_left_out_and_counted(spark, tmp_path):
    early = [(1, i, 0.01, 1) for i in range(3)] + [(1, 5, 0.01, 1)]
    late = [(1, 3, 0.01, 1), (1, 4, 0.01, 1), (1, 6, 0.0, 0)]
    rows = S.drained(spark, S.stream_verdicts(arrived(spark, tmp_path / "in", early, late)), "update").collect()
    last = max(rows, key=lambda r: r.frames_scanned)
    assert (last.frames_scanned, last.text_frames, last.longest_run, last.late) == (5, 4, 4, 2)


def test_values_are_carried_over_triggers(spark, tmp_path):
    schema = "clip_id long, frame_idx long, v double"
    batches = [(1, 0, 5.0), (1, 1, 9.0)], [(1, 2, 9.0), (1, 3, None), (1, 4, 1.0)]
    rows = S.drained(spark, S.stream_carry_forward(arrived(spark, tmp_path / "in", *batches, schema=schema), 3), "append").collect()
    assert sorted((r.frame_idx, r.v) for r in rows) == [(0, 5.0), (1, 5.0), (2, 5.0), (3, None), (4, None)]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    schema = "clip_id long, frame_idx long, v double, last boolean"
    for rows in ([(1, i, float(i), False) for i in range(4)], [(1, i, float(i), i == 6) for i in range(4, 7)]):
        S.to_files(S.stream_medians(arrived(spark, tmp_path / "in", rows, schema=schema), 1), out, state)
    got = sorted((r.frame_idx, r.v) for r in spark.read.parquet(out).collect())
    assert got == [(0, 0.5), (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0), (6, 5.5)]


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_an_empty_stream_gives_an_empty_table(spark, tmp_path, mode):
    spark.createDataFrame([], FRAMES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FRAMES).parquet(str(tmp_path / "in"))
    made = S.stream_verdicts(stream) if mode == "update" else stream.groupBy("clip_id").count()
    assert S.drained(spark, made, mode).count() == 0
