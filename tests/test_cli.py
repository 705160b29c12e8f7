import numpy as np
import pytest

from filmloom import cli
from filmloom.sources import stills


def test_options_and_codes(spark, data, tmp_path):
    args = cli.parser().parse_args(["--profile", "credits", "--set", "temporal.window=5", "probe", "/x"])
    assert cli.options(args).temporal.window == 5
    with pytest.raises(SystemExit):
        cli.options(cli.parser().parse_args(["--set", "no.such=1", "probe", "/x"]))
    assert cli.main(["query", "verdict_early_exit", data, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert cli.main(["query", "verdict_early_exit", "/nowhere", str(tmp_path / "none")]) == 1


def test_masks_then_fix(spark, tmp_path):
    from filmloom.sources import frames as source

    rgb, depth, dets = source.synthetic(spark, 1, 12)
    for name, rows in (("rgb", rgb), ("depth", depth)):
        folder = tmp_path / name / "clip0"
        folder.mkdir(parents=True)
        for r in rows.collect():
            (folder / r["name"]).write_bytes(stills.encode(source.array_of(r.data, r.height, r.width, r.channels, r.bits)))
    from pyspark.sql import functions as F

    found = source.read_stills(spark, str(tmp_path / "rgb")).select("clip_id").first().clip_id
    dets.withColumn("clip_id", F.lit(found)).write.parquet(str(tmp_path / "boxes"))
    common = ["--profile", "both", "--set", "filters.min_text_height=0.05"]
    assert cli.main([*common, "masks", str(tmp_path / "rgb"), str(tmp_path / "boxes"), str(tmp_path / "cache")]) == 0
    masks = source.read_cache(spark, str(tmp_path / "cache"))
    assert masks.count() == 12 and any(max(r.mask) for r in masks.collect())
    moved = masks.withColumn("clip_id", F.regexp_replace("clip_id", "/rgb/", "/depth/"))
    source.write_cache(moved, str(tmp_path / "cache2"), {})
    assert cli.main([*common, "fix", str(tmp_path / "depth"), str(tmp_path / "cache2"), str(tmp_path / "fixed")]) == 0
    out = sorted((tmp_path / "fixed" / "clip0").iterdir())
    before = stills.decode((tmp_path / "depth" / "clip0" / out[6].name).read_bytes())
    assert len(out) == 12 and not np.array_equal(stills.decode(out[6].read_bytes()), before)


PLUGIN = """
import numpy as np
from filmloom.sources import detectors


@detectors.register_batch("bright")
class Bright:
    def detect(self, pictures):
        out = []
        for p in pictures:
            ys, xs = np.nonzero(p.max(axis=2) >= 240)
            out.append([(xs.min() - 2, ys.min() - 2, xs.max() + 3, ys.max() + 3, 0.9)] if len(ys) else [])
        return out
"""


def test_scan_reports_copies_and_is_gone_on_with(spark, tmp_path):
    from test_staged import drawn

    drawn(tmp_path / "in", {"text": True, "bare": False})
    (tmp_path / "bright_plugin.py").write_text(PLUGIN)
    options = ["filters.min_text_height=0.05", "detect.detectors=bright", "scan.window_len=30", "size.min_pixels=4", "level.require=false", "thresholds.min_text_frames=4"]
    args = ["--profile", "both", *[x for o in options for x in ("--set", o)], "scan", str(tmp_path / "in"), str(tmp_path / "report"), "--plugins", str(tmp_path / "bright_plugin.py"), "--dest", str(tmp_path / "out")]
    assert cli.main(args) == 0
    rows = {r.clip_id.rsplit("/", 1)[-1]: r for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()}
    assert {k: (r.verdict, r.rgb_action) for k, r in rows.items()} == {"text": ("text", "copied"), "bare": ("clean", None)}
    assert len(list((tmp_path / "out" / "text").iterdir())) == 24 and not (tmp_path / "out" / "bare").exists()
    drawn(tmp_path / "in", {"later": False})
    assert cli.main(args) == 0
    again = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert sorted(r.clip_id.rsplit("/", 1)[-1] for r in again) == ["bare", "later", "text"]


def test_triage_takes_its_options(spark, tmp_path):
    rows = [("a", i, 0.01, 1) for i in range(60)]
    spark.createDataFrame(rows, "clip_id string, frame_idx long, coverage double, dets long").write.parquet(str(tmp_path / "frames"))
    words = [("a", i, 0, "Hello", 0.9) for i in range(60)]
    spark.createDataFrame(words, "clip_id string, frame_idx long, pos long, word string, confidence double").write.parquet(str(tmp_path / "words"))

    def verdict(out, *options):
        sets = [x for o in options for x in ("--set", o)]
        assert cli.main([*sets, "triage", str(tmp_path / "frames"), str(tmp_path / out), "--words", str(tmp_path / "words")]) == 0
        return spark.read.option("header", True).csv(str(tmp_path / out)).first().verdict

    assert verdict("one") == "text"
    assert verdict("two", "thresholds.min_text_frames=61") == "clean"
    assert verdict("three", "reading.min_chars=6") == "rejected"
