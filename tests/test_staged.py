"""Triage in waves, stills as a data source, copies: what is read, and that results are those of a full run."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.config import Config, Reading, Scan, Sweep, build
from filmloom.operators import copies, masks, scan, staged
from filmloom.sources import detectors, files, still_source, stills
from filmloom.sources import frames as source

SCAN = replace(Config(), sweep=Sweep(clusters=6, frames=4, min_cluster_hits=2), scan=Scan(windows=4, window_len=30))


def table(spark, seed=1, clips=12, frames=400):
    """Frames of clips with text in stretches, of noise and of nothing."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(clips):
        start, length = int(rng.integers(0, frames)), int(rng.choice([0, 5, 40, 300]))
        for i in range(frames if c % 4 else 60):
            on = start <= i < start + length
            rows.append((f"c{c}", i, float(rng.choice([1e-6, 0.01, 0.02])) if on else 0.0, int(on), int(i % 7 == 0 and on)))
    return spark.createDataFrame(rows, "clip_id string, frame_idx long, coverage double, dets long, tilted long")


def words_of(frames):
    said = F.when(F.pmod("frame_idx", F.lit(3)) == 0, "Hello").otherwise("1")
    return frames.where("dets > 0").select("clip_id", "frame_idx", F.lit(0).cast("long").alias("pos"), said.alias("word"), F.lit(0.9).alias("confidence"))


def plain(report):
    return sorted(map(str, report.select(*[c for c in report.columns if c != "elapsed_s"]).collect()))


@pytest.mark.parametrize("seed,sweep", [(1, True), (3, False)])
def test_waves_give_the_report_of_a_full_read_and_read_less(spark, seed, sweep):
    frames = table(spark, seed).cache()
    words = words_of(frames)
    asked = spark.sparkContext.accumulator(0)

    def counting(look):
        def run(wanted):
            def count(batches):
                for b in batches:
                    asked.add(b.num_rows)
                    yield b

            return look(wanted.mapInArrow(count, wanted.schema))

        return run

    seen = counting(staged.from_table(frames))
    read = lambda wanted: wanted.select("clip_id", "frame_idx").join(words, ["clip_id", "frame_idx"])
    got = staged.triage(frames.select("clip_id", "frame_idx"), staged.Eyes(seen, seen, read), SCAN, sweep=sweep)
    want = scan.triage(frames, words, sweep=SCAN.sweep if sweep else None, thresholds=SCAN.thresholds, reading=SCAN.reading, scan=SCAN.scan, radius=SCAN.halo)
    assert plain(got) == plain(want) and {r.verdict for r in want.collect()} >= {"clean", "text"}
    assert 0 < asked.value < frames.count() / 2


def test_a_failing_clip_is_an_error_and_the_others_go_on(spark):
    frames = table(spark).withColumn("error", F.when((F.col("clip_id") == "c1") & (F.col("frame_idx") == 0), "ValueError: damaged"))
    look = staged.from_table(frames)
    report = {r.clip_id: r for r in staged.triage(frames.select("clip_id", "frame_idx"), staged.Eyes(look, look), SCAN).collect()}
    assert len(report) == 12 and report["c1"].verdict == "error" and report["c1"].error == "ValueError: damaged"
    assert all(r.error is None and r.verdict != "error" for k, r in report.items() if k != "c1")


def drawn(folder, clips, width=96, height=72, frames=24):
    """Folders of stills: ``text`` has bars in a box from frame 6 on, others have nothing but a slope."""
    ys, xs = np.mgrid[0:height, 0:width]
    for name, text in clips.items():
        (folder / name).mkdir(parents=True)
        for i in range(frames):
            image = np.repeat((70 + 30 * np.sin((xs + i) / 23.0) + 20 * np.cos(ys / 17.0)).astype(np.uint8)[..., None], 3, axis=2)
            if text and i >= 6:
                for k in range(24, 72, 9):
                    image[34:48, k : k + 3] = 250
            (folder / name / f"f{i:03d}.png").write_bytes(stills.encode(image))


@pytest.fixture
def plugins(monkeypatch):
    class Bright:
        """A box round all pixels of 240 and more."""

        def detect(self, pictures):
            out = []
            for p in pictures:
                ys, xs = np.nonzero(p.max(axis=2) >= 240)
                out.append([(xs.min() - 2, ys.min() - 2, xs.max() + 3, ys.max() + 3, 0.9)] if len(ys) else [])
            return out

    class Fails(Bright):
        def detect(self, pictures):
            if any(p[0, 0, 0] == 0 for p in pictures):
                raise RuntimeError("no such scene")
            return super().detect(pictures)

    class Spells:
        def read(self, frame, boxes):
            return [("Bars", 0.9) for _ in boxes]

    monkeypatch.setitem(detectors.BATCH, "bright", Bright)
    monkeypatch.setitem(detectors.BATCH, "fails", Fails)
    monkeypatch.setitem(detectors.READERS, "spells", Spells)


STILLS = build("both", **{"filters.min_text_height": 0.05, "detect.detectors": ("bright",), "scan.window_len": 30, "size.min_pixels": 4, "level.require": False})


def test_stills_in_waves_with_a_batch_detector_and_one_broken_picture(spark, tmp_path, plugins):
    drawn(tmp_path, {"text": True, "bare": False, "other": True, "broken": True})
    (tmp_path / "broken" / "f009.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    eyes = staged.eyes_for_stills(STILLS, reader="spells")
    report = {r.clip_id.rsplit("/", 1)[-1]: r for r in staged.triage(source.listed(spark, str(tmp_path)), eyes, STILLS).collect()}
    assert {k: r.verdict for k, r in report.items()} == {"text": "text", "bare": "clean", "other": "text", "broken": "error"}
    assert report["text"].words == ["Bars"] and report["text"].elapsed_s > 0 and "ValueError" in report["broken"].error
    assert report["text"].frames_scanned < 24 and report["bare"].frames_scanned == 24 and report["text"].min_text_px >= 3


def test_a_table_of_boxes_serves_as_well(spark, tmp_path):
    drawn(tmp_path, {"text": True, "bare": False})
    listing = source.listed(spark, str(tmp_path))
    boxes = listing.where("clip_id like '%/text' and frame_idx >= 6").select("clip_id", "frame_idx", *[F.lit(v).cast("long").alias(k) for k, v in {"det_id": 1, "x0": 22, "y0": 32, "x1": 71, "y1": 50}.items()], F.lit(0.9).alias("score"))
    report = {r.clip_id.rsplit("/", 1)[-1]: r for r in staged.triage(listing, staged.eyes_for_stills(STILLS, boxes), STILLS).collect()}
    assert {k: (r.verdict, r.stage) for k, r in report.items()} == {"text": ("text", "confirmed"), "bare": ("clean", "confirmed")}


def test_batch_detectors_feed_the_masks_and_fail_alone(spark, tmp_path, plugins):
    drawn(tmp_path, {"text": True}, frames=12)
    dark = stills.decode((tmp_path / "text" / "f008.png").read_bytes())
    dark[0, 0] = 0
    (tmp_path / "text" / "f008.png").write_bytes(stills.encode(dark))
    rgb = source.read_listed(source.listed(spark, str(tmp_path)))
    seen = detectors.detect_frames(rgb, ("fails",), batch_size=5).cache()
    assert [r.frame_idx for r in seen.where("error is not null").collect()] == [8]
    assert [len(r.boxes) for r in seen.orderBy("frame_idx").collect()] == [0] * 6 + [1, 1, 0, 1, 1, 1]
    made = masks.run(rgb, detectors.boxes_of(seen), STILLS).where("frame_idx = 10").first()
    assert max(made.mask) > 127
    with pytest.raises(ValueError, match="no batch detector"):
        detectors.detect_frames(rgb, ("nobody",))


def test_the_source_of_masks_is_scanned_once(spark, tmp_path):
    """Pixels are read by one scan in one of the jobs; everything else reads narrow tables."""
    rgb, depth, dets = source.synthetic(spark, 1, 8, 96, 54)
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            looked.add(b.num_rows)
            yield b

    rgb.write.parquet(str(tmp_path / "rgb"))
    counted = spark.read.parquet(str(tmp_path / "rgb")).mapInArrow(count, rgb.schema)
    sizes = spark.read.parquet(str(tmp_path / "rgb")).select("clip_id", "frame_idx", "height", "width")
    config = build("both", **{"filters.min_text_height": 0.05})
    assert any(max(r.mask) for r in masks.run(counted, dets, config, depth, (0.0, 1023.0), sizes=sizes).collect())
    assert looked.value <= 8


# the data source


def test_only_named_frames_are_opened(spark, tmp_path):
    drawn(tmp_path, {"a": True, "b": False}, frames=12)
    (tmp_path / "a" / "f003.png").write_bytes(b"broken")
    load = lambda **o: still_source.load(spark, str(tmp_path), **o)
    a = files.qualified(spark, str(tmp_path / "a"))
    got = load(stretch=4).where((F.col("clip_id") == a) & F.col("frame_idx").between(4, 6))
    assert sorted(r.frame_idx for r in got.collect()) == [4, 5, 6]
    assert sorted((r.clip_id[-1], r.frame_idx) for r in load(frames="1,4-8:4").collect()) == [(c, i) for c in "ab" for i in (1, 4, 8)]
    assert load().where(F.col("frame_idx").isin(0, 11, 99)).count() == 4
    with pytest.raises(Exception, match="neither PNG"):
        load().collect()
    rows = load(on_error="row").collect()
    assert len(rows) == 24 and [(r.frame_idx, r.data) for r in rows if r.error] == [(3, None)]
    want = {(r.clip_id, r.frame_idx): bytes(r.data) for r in source.read_stills(spark, str(tmp_path / "b")).collect()}
    assert want == {(r.clip_id, r.frame_idx): bytes(r.data) for r in rows if r.clip_id.endswith("/b")}
    assert load(rgb="true").where("frame_idx > 500").count() == 0


def test_writes_are_whole_or_leave_nothing(spark, tmp_path):
    _, depth, _ = source.synthetic(spark, 2, 5, 24, 16)
    out = tmp_path / "out"
    still_source.save(depth.repartition(3), str(out))
    assert sorted(p.relative_to(out).as_posix() for p in out.rglob("*.*")) == [f"clip{c}/f{i:05d}.png" for c in range(2) for i in range(5)]
    back = {(r.clip_id[-5:], r.frame_idx): bytes(r.data) for r in still_source.load(spark, str(out), rgb="false").collect()}
    assert back == {(r.clip_id, r.frame_idx): bytes(r.data) for r in depth.collect()}
    with pytest.raises(Exception, match="written twice"):
        still_source.save(depth, str(out))
    bad = depth.withColumn("data", F.when(F.col("frame_idx") == 4, F.lit(b"short")).otherwise(F.col("data")))
    none = tmp_path / "none"
    with pytest.raises(Exception, match="5 values|expected|buffer"):
        still_source.save(bad.repartition(5), str(none))
    assert not [p for p in none.rglob("*") if p.is_file()] and not (out / "_staging").exists()


# sinks and copies


def test_depth_goes_out_as_stills_or_a_table_only(spark, tmp_path):
    _, depth, _ = source.synthetic(spark, 1, 1, 8, 8)
    with pytest.raises(ValueError, match="mkv"):
        source.write_depth(depth, str(tmp_path / "out.mkv"))
    assert source.write_depth(depth, str(tmp_path / "a.b folder")) == "stills"


def test_sizes_come_from_heads(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.png").write_bytes(stills.encode(np.zeros((5, 9, 3), np.uint8))[:64])
    (tmp_path / "c" / "2.pgm").write_bytes(stills.encode(np.zeros((4, 7), np.uint16), ".pgm"))
    got = [(r.height, r.width) for r in source.still_sizes(source.listed(spark, str(tmp_path))).orderBy("frame_idx").collect()]
    assert got == [(5, 9), (4, 7)]


def test_copies_are_gone_on_with_and_nothing_is_overwritten(spark, tmp_path):
    drawn(tmp_path / "in", {"a": False, "b": False}, 16, 8, 3)
    (tmp_path / "in" / "film.mp4").write_bytes(b"x" * 100)
    from filmloom.sources import catalog

    found = catalog.listing(spark, str(tmp_path / "in"))
    clips = spark.createDataFrame([(str(tmp_path / "in" / n), str(tmp_path / "out" / n)) for n in ("a", "b", "film.mp4")], "src string, dst string")
    (tmp_path / "out" / "b").mkdir(parents=True)
    (tmp_path / "out" / "b" / "f001.png").write_bytes(b"other")
    (tmp_path / "out" / "a").mkdir()
    (tmp_path / "out" / "a" / "f000.png").write_bytes((tmp_path / "in" / "a" / "f000.png").read_bytes())  # a run that ended here
    (tmp_path / "out" / "a" / "f001.png.part").write_bytes(b"half")
    moves = spark.createDataFrame(copies.files_of(clips, found).collect())
    done = spark.createDataFrame(copies.carried_out(moves).collect())
    actions = {r.src.rsplit("/", 1)[-1]: r.action for r in copies.clip_actions(done, clips).collect()}
    assert actions == {"a": "copied", "b": "exists (differs)", "film.mp4": "copied"}
    assert (tmp_path / "out" / "b" / "f001.png").read_bytes() == b"other" and not list((tmp_path / "out").rglob("*.part"))
    again = {r.action for r in copies.carried_out(moves).collect()}
    assert again == {"exists", "exists (differs)"}
    only = moves.where(F.endswith("src", F.lit("film.mp4"))).withColumn("dst", F.lit(str(tmp_path / "third" / "film.mp4")))
    assert [r.action for r in copies.carried_out(only, move=True).collect()] == ["moved"] and not (tmp_path / "in" / "film.mp4").exists()
    (gone,) = copies.carried_out(only.withColumn("dst", F.lit(str(tmp_path / "x" / "y.mp4")))).collect()
    assert gone.action.startswith("error")


def test_reading_options_hold_in_waves(spark):
    frames = table(spark, 2)
    look = staged.from_table(frames)
    words = lambda wanted: wanted.select("clip_id", "frame_idx", F.lit(0).cast("long").alias("pos"), F.lit("111").alias("word"), F.lit(0.9).alias("confidence"))
    strict = staged.triage(frames.select("clip_id", "frame_idx"), staged.Eyes(look, look, words), SCAN)
    loose = staged.triage(frames.select("clip_id", "frame_idx"), staged.Eyes(look, look, words), replace(SCAN, reading=Reading(require=False)))
    assert "rejected" in {r.verdict for r in strict.collect()} and "rejected" not in {r.verdict for r in loose.collect()}


def test_no_table_is_broadcast_for_the_size_of_its_files(spark, monkeypatch):
    from filmloom import steps

    monkeypatch.setattr(steps, "BROADCAST_BYTES", 0, raising=False)
    frames, plans = table(spark, clips=6), []

    def look(wanted):
        out = staged.from_table(frames)(wanted)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    threshold, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "64m")  # all of these tables' files are smaller
    try:
        report = staged.triage(frames.select("clip_id", "frame_idx"), staged.Eyes(look, look), SCAN)
        assert {spark.conf.get(threshold), spark.conf.get(measured, None)} == {"64m", None}
        assert len(plans) >= 2 and not any("Broadcast" in p for p in plans)
        assert report.count() == 6 and "Join" not in report._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ZeroDivisionError), steps.joined_by_real_size(spark):
            1 / 0
        assert spark.conf.get(threshold) == "64m"
    finally:
        spark.conf.unset(threshold)


def test_tables_between_steps_are_marked_for_broadcast_by_their_count(spark):
    from filmloom import steps

    rows = spark.range(3).withColumn("n", F.lit(1)).withColumnRenamed("id", "clip_id")
    marked = [steps.few(steps.cut(x))._jdf.queryExecution().analyzed().toString() for x in (rows, spark.range(100_000).withColumnRenamed("id", "clip_id"))]
    assert "broadcast" in marked[0] and "broadcast" not in marked[1]
