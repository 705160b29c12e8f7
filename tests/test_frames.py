import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.config import build
from filmloom.operators import masks, scan
from filmloom.sources import catalog, detectors, frames as source, stills


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("shape", [(7, 9), (7, 9, 3), (5, 4, 4)])
def test_png_round_trip(kind, shape):
    image = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (stills.decode(stills.encode(image)) == image).all()
    if shape[-1] != 4 and (len(shape) == 2 or shape[2] == 3):
        suffix = ".pgm" if len(shape) == 2 else ".ppm"
        assert (stills.decode(stills.encode(image, suffix)) == image).all()


def test_damaged_stills_raise():
    good = stills.encode(np.zeros((4, 4), np.uint8))
    for bad in (b"GIF89a", good[:40], good[:-30] + b"xx" + good[-28:]):
        with pytest.raises(ValueError):
            stills.decode(bad)


def filtered(image, kinds):
    """A PNG whose lines are filtered as asked, by the definition, byte by byte."""
    import struct
    import zlib

    h, w, c = image.shape
    body, above = b"", [0] * (w * c)
    for y in range(h):
        line, out = image[y].ravel().tolist(), []
        for k, v in enumerate(line):
            a, b, d = line[k - c] if k >= c else 0, above[k], above[k - c] if k >= c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) & 255)
        body, above = body + bytes([kinds[y], *out]), line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0] * 9, [1, 2] * 4 + [0], [3] * 9, [4] * 9, [0, 4, 3, 2, 1, 4, 4, 3, 0]])
def test_png_filters(kinds):
    image = np.random.default_rng(8).integers(0, 256, (9, 13, 3)).astype(np.uint8)
    assert (stills.decode(filtered(image, kinds)) == image).all()


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packed", [1, 8, 32773])
@pytest.mark.parametrize("shape,kind", [((5, 7), "u2"), ((4, 6, 3), "u1")])
def test_tiff(order, packed, shape, kind):
    import struct
    import zlib

    image = np.random.default_rng(9).integers(0, 255, shape).astype(kind)
    raw = image.astype(order + kind).tobytes()
    body = {1: raw, 8: zlib.compress(raw), 32773: b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100))}[packed]
    channels = 1 if len(shape) == 2 else 3
    tags = [(256, 4, 1, shape[1]), (257, 4, 1, shape[0]), (258, 3, 1, 16 if kind == "u2" else 8), (259, 3, 1, packed), (273, 4, 1, 8), (277, 3, 1, channels), (279, 4, 1, len(body))]
    entries = b"".join(struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, n, v in tags)
    data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + bytes(4)
    assert (stills.decode(data) == image).all()
    with pytest.raises(ValueError):
        stills.decode(data[:30])


def test_delta_write_leaves_untouched_pixels():
    image = np.random.default_rng(2).integers(0, 65535, (6, 5, 3)).astype(np.uint16)
    plane = stills.plane_of(image)
    assert (stills.with_plane(image, plane) == image).all()
    plane[2, 3] += 10
    changed = stills.with_plane(image, plane) != image
    assert changed[2, 3].any() and not np.delete(changed.reshape(30, 3), 13, axis=0).any()


def test_stills_are_read_in_natural_order_and_written_back(spark, tmp_path):
    folder = tmp_path / "in" / "shot"
    folder.mkdir(parents=True)
    for k in (10, 2, 1):
        (folder / f"f{k}.png").write_bytes(stills.encode(np.full((3, 4), k, np.uint16)))
    got = source.read_stills(spark, str(tmp_path / "in"), rgb=False).orderBy("frame_idx").collect()
    assert [r.name for r in got] == ["f1.png", "f2.png", "f10.png"]
    assert source.array_of(got[2].data, 3, 4, 1, 16).max() == 10
    frames = source.read_stills(spark, str(tmp_path / "in"), rgb=False)
    assert source.write_stills(frames, str(tmp_path / "out")).count() == 3
    (info,) = source.sequence_info(frames).collect()
    assert (info.height, info.width, info.bits, info.frames, info.range) == (3, 4, 16, 3, "pc")
    assert (stills.decode((tmp_path / "out" / "shot" / "f10.png").read_bytes()) == 10).all()


def test_masks_by_segment_equal_masks_of_the_whole(spark):
    rgb, depth, dets = source.synthetic(spark, 1, 24)
    config = build("both", **{"filters.min_text_height": 0.05})
    found = masks.patches(rgb, dets, config)
    part = {r.frame_idx: r.mask for r in masks.masks(rgb, found, config, 5).collect()}
    whole = {r.frame_idx: r.mask for r in masks.masks(rgb, found, config, 1000).collect()}
    assert part == whole and any(max(m) for m in whole.values())
    mask = masks.masks(rgb, found, config)
    fixed = {r.frame_idx: np.frombuffer(r.data, np.uint16) for r in masks.repaired(depth, mask, config).collect()}
    before = {r.frame_idx: np.frombuffer(r.data, np.uint16) for r in depth.collect()}
    assert (fixed[0] == before[0]).all() and (fixed[12] != before[12]).any()


def test_clips_of_one_name_are_kept_apart(spark, tmp_path):
    _, depth, _ = source.synthetic(spark, 1, 3, 12, 8)
    both = depth.withColumn("clip_id", F.lit("/a/shot")).union(depth.withColumn("clip_id", F.lit("/b/shot")))
    paths = {r.path for r in source.write_stills(both, str(tmp_path / "out")).collect()}
    assert len(paths) == 6 and not list((tmp_path / "out").rglob("*.part"))
    assert source.write_depth(both, str(tmp_path / "depth.parquet")) == "table"
    assert source.read_depth(spark, str(tmp_path / "depth.parquet")).count() == 6


@pytest.mark.parametrize("option,value", [("min_contrast", 0.99), ("max_chroma_std", -1.0), ("min_text_height", 0.298), ("roi", "top:0.3"), ("min_persist_frames", 40)])
def test_options_of_the_gates_alter_the_masks(spark, option, value):
    rgb, _, dets = source.synthetic(spark, 1, 12, 96, 54)
    config = build("both", **{"filters.min_text_height": 0.05})
    lit = lambda c: sum(max(r.mask) > 0 for r in masks.run(rgb, dets, c).collect())
    if option == "min_contrast":
        assert lit(config) >= 6
        assert lit(build("both", **{"filters.min_text_height": 0.05, "filters.scene_text": "mask", "filters.min_contrast": 0.99})) >= 6
    if option == "min_persist_frames":  # windows are no longer than 9 frames
        assert lit(config.with_options(**{"filters.min_persist_frames": value, "filters.persist_iou": 1.01})) == 0
    else:
        assert lit(config.with_options(**{f"filters.{option}": value})) == 0


def test_detectors_are_merged_and_sizes_are_each_clips_own(spark):
    rgb, _, dets = source.synthetic(spark, 1, 8, 96, 54)
    config = build("both", **{"filters.min_text_height": 0.05})
    both = dets.withColumn("detector_ord", F.lit(0)).union(dets.withColumns({"x0": F.col("x0") + 1, "score": F.lit(0.95), "detector_ord": F.lit(1)}))
    kept = masks.boxes(rgb, both, config).collect()
    assert len(kept) == dets.count() and {r.score for r in kept} == {0.95} and {r.x0 for r in kept} == {24}
    tall, _, more = source.synthetic(spark, spark.createDataFrame([("tall",)], "clip_id string"), 8, 192, 216)
    narrow = config.with_options(**{"filters.min_text_height": 0.2})
    kept = masks.boxes(rgb.union(tall), dets.union(more), narrow).select("clip_id").distinct().collect()
    assert [r.clip_id for r in kept] == ["clip0"]  # 16 pixels are a third of 54 and little of 216


def test_masks_of_single_frames_equal_a_full_run(spark):
    rgb, depth, dets = source.synthetic(spark, 1, 60, 96, 54)
    config = build("both", **{"filters.min_text_height": 0.05})
    more = {"depth": depth, "codes": (0.0, 1023.0)}
    full = {r.frame_idx: r.mask for r in masks.run(rgb, dets, config, **more).collect()}
    wanted = spark.createDataFrame([("clip0", 3), ("clip0", 30), ("clip0", 44)], "clip_id string, frame_idx long")
    got = {r.frame_idx: r.mask for r in masks.masks_for(rgb, dets, wanted, config, **more).collect()}
    assert set(got) == {3, 30, 44} and all(got[i] == full[i] for i in got) and max(full[30])


def test_depth_vetoes_what_lies_elsewhere(spark):
    rgb, depth, dets = source.synthetic(spark, 1, 8, 160, 90)
    config = build("both", **{"filters.min_text_height": 0.05, "temporal.prior_window": 0})

    def split(batches):  # the last third of the text lies far behind
        for b in batches:
            out = []
            for data, h, w in zip(b["data"], b["height"], b["width"]):
                plane = np.frombuffer(data, np.uint16).reshape(h, w).copy()
                plane[:, 104:] = 60
                out.append(plane.tobytes())
            yield b.assign(data=out)

    far = depth.mapInPandas(split, depth.schema)
    ink = lambda **k: sum(sum(x > 127 for x in r.mask) for r in masks.run(rgb, dets, config, **k).where(F.col("frame_idx") == 4).collect())
    assert ink(depth=far, codes=(0.0, 1023.0)) < ink(depth=depth, codes=(0.0, 1023.0)) == ink()


def test_a_model_of_strokes_is_used(spark):
    rgb, _, dets = source.synthetic(spark, 1, 6, 96, 54)
    config = build("both", **{"filters.min_text_height": 0.05, "strokes.strokes_from": "hisam", "temporal.mode": "none", "temporal.prior_window": 0})

    def model(picture):  # one thick stroke in place of the bars
        plane = np.zeros(picture.shape[:2], np.float32)
        plane[40:50, 30:70] = 1.0
        return plane

    lit = lambda **k: np.frombuffer(masks.run(rgb, dets, config, **k).where("frame_idx = 3").first().mask, np.uint8).reshape(54, 96) > 127
    assert lit(model=model)[41:49, 31:69].all() and not lit()[41:49, 31:69].all()


def test_segments_get_shorter_as_frames_grow(spark):
    size = lambda h, w: masks.segment_length(spark.createDataFrame([(h, w)], "height int, width int"), 11)
    assert size(90, 160) == 64 and size(1080, 1920) < 64 and size(4320, 7680) == 1


def test_labels_are_written_read_and_scored(spark, tmp_path):
    from filmloom.operators import measures
    from filmloom.sources import labels

    glyphs = spark.createDataFrame([("a", y, x) for y in range(2, 7) for x in range(3, 8)], "clip_id string, y long, x long")
    states = spark.createDataFrame([("a", i, "on" if i < 3 else "off") for i in range(5)], "clip_id string, frame_idx long, state string")
    sizes = spark.createDataFrame([("a", 12, 16)], "clip_id string, height int, width int")
    labels.write(labels.gathered(glyphs, states, sizes), str(tmp_path / "labels"))
    made = labels.read(spark, str(tmp_path / "labels"))
    assert made.first().method == "differencing" and made.first().on == [0, 1, 2]
    mask = np.zeros((12, 16), np.uint8)
    mask[2:7, 3:8] = 255
    (tmp_path / "found" / "a").mkdir(parents=True)
    for i, m in ((0, mask), (1, np.zeros_like(mask)), (2, np.repeat(np.repeat(mask, 2, 0), 2, 1)), (4, mask)):
        (tmp_path / "found" / "a" / f"m{i}.png").write_bytes(stills.encode(m))
    found = labels.read_masks(spark, str(tmp_path / "found"))
    named = found.withColumn("clip_id", F.regexp_extract("clip_id", "([^/]+)$", 1))
    for window in (False, True):
        got = {r.frame_idx: (r.iou, r.recall, r.precision) for r in labels.scored(named, made, window).collect()}
        assert got == {0: (1.0, 1.0, 1.0), 1: (0.0, 0.0, 0.0), 2: (1.0, 1.0, 1.0)}
    (r,) = measures.score_summary(labels.scored(named, made), ["clip_id"]).collect()
    assert (r.iou, r.worst, r.frames) == (1.0, 0.0, 3)


def test_mask_cache_refuses_another_source(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, b"x")], "clip_id string, frame_idx long, mask binary")
    source.write_cache(rows, str(tmp_path / "cache"), {"fingerprint": "f1"})
    assert source.read_cache(spark, str(tmp_path / "cache"), "f1").count() == 1
    with pytest.raises(ValueError):
        source.read_cache(spark, str(tmp_path / "cache"), "f2")


def test_catalogue(spark, tmp_path):
    (tmp_path / "seq").mkdir()
    (tmp_path / "seq" / "a1.png").write_bytes(b"1")
    (tmp_path / "seq" / "inner.mp4").write_bytes(b"1")
    (tmp_path / "Film.MKV").write_bytes(b"1")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.mp4").write_bytes(b"1")
    files = catalog.listing(spark, str(tmp_path))
    got = [(r.key, r.is_dir) for r in catalog.clips(files, str(tmp_path), skip=(f"{tmp_path}/out",)).collect()]
    assert got == [("film", False), ("seq", True)]
    assert catalog.fingerprints(spark, str(tmp_path)).where("length(fingerprint) = 16").count() == 4


def test_triage(spark):
    rows = [("talky", i, 0.01 if 20 <= i < 60 else 0.0, 1 if 20 <= i < 60 else 0) for i in range(200)]
    rows += [("street", i, 0.0, 0) for i in range(200)] + [("noise", i, 0.01, 1) for i in range(200)]
    frames = spark.createDataFrame(rows, "clip_id string, frame_idx long, coverage double, dets long")
    words = spark.createDataFrame(
        [("talky", i, 0, "Hello", 0.9) for i in range(200)] + [("noise", i, 0, "111", 0.99) for i in range(200)],
        "clip_id string, frame_idx long, pos long, word string, confidence double",
    )
    got = {r.clip_id: r for r in scan.triage(frames, words).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"talky": "text", "street": "clean", "noise": "rejected"}
    assert got["talky"].words == ["Hello"] and got["talky"].longest_run >= 3
    assert {r.verdict for r in scan.triage(frames).collect()} == {"text", "clean"}


def test_what_counts_in_a_triage(spark):
    frames = spark.createDataFrame([("a", i, 0.01, 1, 100) for i in range(4)], "clip_id string, frame_idx long, coverage double, dets long, height int")
    boxes = [("a", 0, 1, 0, 30, 0.0), ("a", 0, 2, 0, 30, 20.0), ("a", 1, 1, 0, 30, 20.0), ("a", 1, 2, 0, 30, None), ("a", 2, 1, 0, 10, 0.0)]
    dets = spark.createDataFrame(boxes, "clip_id string, frame_idx long, det_id long, y0 long, y1 long, tilt double")
    got = {r.frame_idx: (r.dets, r.tilted, r.min_text_px) for r in scan.looked_at(frames, dets).collect()}
    assert got == {0: (1, 1, 14), 1: (0, 1, 14), 2: (0, 0, 14), 3: (0, 0, 14)}
    report = scan.triage(scan.looked_at(frames, dets)).collect()[0]
    assert report.tilted_regions == 2 and report.min_text_px == 14


def test_tilt_of_drawn_lines(spark):
    rows, dets = [], []
    for k, (slope, thick) in enumerate([(0.0, 4), (0.5, 4), (0.0, 1)]):
        dets.append(("a", 0, k, 0, 0, 100, 60))
        for x in range(0, 100 if thick > 1 else 20, 2):
            rows += [("a", 0, k, x, int(5 + x * slope) + j, 200) for j in range(thick)]
    ink = spark.createDataFrame(rows, "clip_id string, frame_idx long, det_id long, x long, y long, v long")
    boxes = spark.createDataFrame(dets, "clip_id string, frame_idx long, det_id long, x0 long, y0 long, x1 long, y1 long")
    got = {r.det_id: r.tilt for r in scan.tilts(ink, boxes).collect()}
    assert got[0] == 0.0 and abs(got[1] - 26) <= 2 and got[2] is None


def test_a_report_is_gone_on_with(spark, tmp_path):
    rows = [(c, i, 0.01, 1) for c in ("a", "b") for i in range(30)]
    frames = spark.createDataFrame(rows, "clip_id string, frame_idx long, coverage double, dets long")
    path = str(tmp_path / "report")
    scan.write_report(scan.triage(scan.not_reported(spark, frames.where("clip_id = 'a'"), path)), path)
    left = scan.not_reported(spark, frames, path)
    assert {r.clip_id for r in left.select("clip_id").distinct().collect()} == {"b"}
    scan.write_report(scan.triage(left), path)
    assert sorted(r.clip_id for r in spark.read.option("header", True).csv(path).collect()) == ["a", "b"]


def test_detector_registry(spark):
    rows = spark.createDataFrame([(0.1, 0.1, 0.5, 0.3, 0.9), (0.5, 0.1, 0.2, 0.3, 0.9)], "x0 double, y0 double, x1 double, y1 double, score double")
    assert [tuple(r) for r in detectors.from_relative(rows, 100, 50, 0.3).select("x0", "y0", "x1", "y1").collect()] == [(10, 5, 50, 15)]
    assert detectors.detect(("table", "none"), {"table": rows}).count() == 2
    with pytest.raises(ValueError):
        detectors.detect(("none",), {"table": rows})
    with pytest.raises(RuntimeError):
        detectors.detect(("none", "nor"), {})
