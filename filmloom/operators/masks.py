"""Masks and repaired depth from frames: the array stages, run over segments of a clip.

Frames lie in tables as bytes. Extraction and repair need one frame at a
time. The stages in between look at neighbouring frames, so a clip is cut
into segments and every segment gets the frames around it as well, as many as
the stages' radii add up to; it returns only its own. No task ever holds a
whole clip, and frames never meet in an array column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import steps
from ..config import Config
from ..kernels import arrays as A, glyphs as G, repair as R
from ..sources.frames import array_of, few_frames
from . import planes

PATCH = "clip_id string, frame_idx long, det_id long, x0 int, y0 int, h int, w int, level float, alpha binary"
SHAPE = "clip_id string, frame_idx long, height int, width int, shape binary, level binary, peak int"
LOOK = "clip_id string, frame_idx long, det_id long, contrast double, lit long, spread double"
#: Boxes are broadcast up to this many bytes, by their count.
BROADCAST_BYTES = 4 << 20
MASK = "clip_id string, frame_idx long, height int, width int, mask binary, shape binary, level binary"


def boxes(frames: DataFrame, dets: DataFrame, config: Config) -> DataFrame:
    """Boxes that are sure enough and of a plausible shape, those of several detectors merged; det_id is new.

    Sizes are each frame's own, so clips of any resolution go together.
    """
    from . import gates, tracks

    order = ["detector_ord", "det_id"] if "detector_ord" in dets.columns else ["det_id"]
    merged = tracks.merge(gates.confident(dets, config.detect.min_score), ["clip_id", "frame_idx"], order)
    sized = merged.withColumnRenamed("kept_id", "det_id").join(frames.select("clip_id", "frame_idx", "width", "height"), ["clip_id", "frame_idx"])
    return gates.geometry(sized, F.col("width"), F.col("height"), config.filters).drop("width", "height")


def _with_boxes(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """Frames that have boxes, with them. Where all boxes are few, they go to the frames and no pixel moves."""
    listed = dets.groupBy("clip_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("det_id", "x0", "y0", "x1", "y1"))).alias("boxes"))
    size = dets.select("clip_id", "frame_idx").agg(F.count("*") * 160).first()[0]
    return frames.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed.hint("merge"), ["clip_id", "frame_idx"])


def looks(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """contrast, lit and spread of every box, for ``gates.overlaid``."""
    names = [x.split()[0] for x in LOOK.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for clip, i, h, w, data, found in zip(*(b[c] for c in b.columns)):
                rgb = array_of(data, h, w, 3, 8)
                out += [(clip, i, d["det_id"], *(G.appearance(rgb, (d["x0"], d["y0"], d["x1"], d["y1"])) or (None,) * 3)) for d in found]
            yield pd.DataFrame(out, columns=names).astype({"contrast": float, "lit": "Int64", "spread": float})

    few_frames(frames.sparkSession, 8 << 20)
    return _with_boxes(frames, dets).select("clip_id", "frame_idx", "height", "width", "data", "boxes").mapInPandas(run, LOOK)


def patches(
    frames: DataFrame, dets: DataFrame, config: Config, depth: DataFrame | None = None, codes: tuple[float, float] = (64.0, 940.0), model=None, overlaid: bool = False
) -> DataFrame:
    """One row per box, in one pass over the frames: the glyphs it holds, alpha null where there are none.

    With ``overlaid`` boxes that don't look like overlaid writing are left out
    before anything is read from them. ``depth`` frames, whose ``codes`` are the
    ends of their range, veto glyphs off the text's depth.
    """
    rows = _with_boxes(frames, dets)
    if depth is None:
        rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("_dh", "int"), ("_dw", "int"), ("_depth", "binary"))])
    else:
        plane = depth.select("clip_id", "frame_idx", F.col("height").alias("_dh"), F.col("width").alias("_dw"), F.col("data").alias("_depth"))
        rows = rows.join(plane, ["clip_id", "frame_idx"])
    rows = rows.select("clip_id", "frame_idx", "height", "width", "data", "boxes", "_dh", "_dw", "_depth")
    strokes, filters = config.strokes, config.filters

    def run(batches):
        names = [x.split()[0] for x in PATCH.split(", ")]
        for b in batches:
            out = []
            for clip, i, h, w, data, found, dh, dw, plane in zip(*(b[c] for c in b.columns)):
                rgb = array_of(data, h, w, 3, 8)
                asked = [(d["det_id"], (d["x0"], d["y0"], d["x1"], d["y1"])) for d in found]
                if overlaid:
                    asked = [(k, box) for k, box in asked if G.overlaid(G.appearance(rgb, box), filters)]
                guide = None if plane is None else guide_of(plane, int(dh), int(dw), h, w, *codes)
                got = G.extract_frame(rgb, [box for _, box in asked], strokes, guide, model)
                out += [
                    (clip, i, k, *((None,) * 6 if p is None else (p.x0, p.y0, *p.alpha.shape, p.level, p.alpha.tobytes()))) for (k, _), p in zip(asked, got)
                ]
            yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("x0", "y0", "h", "w")} | {"level": "Float32"})

    few_frames(frames.sparkSession, 8 << 20)
    return rows.mapInPandas(run, PATCH)


def guide_of(plane: bytes, height: int, width: int, to_height: int, to_width: int, low: float, high: float) -> np.ndarray:
    """A depth plane as floats in [0, 1] at the size of its frame."""
    codes = np.frombuffer(plane, np.uint16).reshape(height, width).astype(np.float32)
    scaled = np.clip((codes - low) / max(high - low, 1.0), 0, 1).astype(np.float32)
    return A.resize(scaled, to_width, to_height, "linear").astype(np.float32)


def segments(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """Rows for every segment of ``size`` frames that is within ``halo`` of them, with ``own``."""
    first, last = F.floor((F.col("frame_idx") - halo) / size), F.floor((F.col("frame_idx") + halo) / size)
    dealt = rows.withColumn("segment", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return dealt.withColumn("own", F.col("segment") == F.floor(F.col("frame_idx") / size))


def segment_length(frames: DataFrame, halo: int, budget: int = 48 << 20, most: int = 64) -> int:
    """Frames in a segment, so that it and the frames around it, three planes each, fit ``budget`` bytes."""
    pixels = frames.agg(F.max(F.col("height").cast("long") * F.col("width"))).first()[0] or 1
    return max(1, min(most, budget // (3 * pixels) - 2 * halo))


def shapes(frames: DataFrame, found: DataFrame, config: Config, segment: int | None = None) -> DataFrame:
    """Shape, smoothed in time, and level of all frames (clip_id, frame_idx, height, width) from the patches that passed the gates.

    ``peak`` is the greatest level of a frame, before it is spread.
    """
    temporal = config.temporal
    halo = temporal.window // 2 if temporal.mode != "none" else 0
    segment = segment or segment_length(frames, halo)
    listed = found.where("alpha is not null").groupBy("clip_id", "frame_idx").agg(
        F.collect_list(F.struct("det_id", "x0", "y0", "h", "w", "level", "alpha")).alias("patches")
    )
    rows = frames.select("clip_id", "frame_idx", "height", "width").join(listed, ["clip_id", "frame_idx"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        index, made, levels = pdf["frame_idx"].tolist(), [], []
        for h, w, found in zip(pdf["height"], pdf["width"], pdf["patches"]):
            got = [
                G.Patch(p["x0"], p["y0"], np.frombuffer(p["alpha"], np.float32).reshape(p["h"], p["w"]), p["level"], "")
                for p in sorted(found if found is not None else [], key=lambda p: p["det_id"])
            ]
            s, v = G.compose(got, h, w)
            made.append(s)
            levels.append(v)
        out = []
        for k, own in enumerate(pdf["own"]):
            if own:
                shape = A.temporal(made[max(0, k - halo) : k + halo + 1], made[k], temporal.mode)
                level = A.dilate(levels[k], np.ones((5, 5), bool)) if levels[k].any() else levels[k]
                out.append((pdf["clip_id"].iloc[k], index[k], *shape.shape, shape.tobytes(), level.tobytes(), int(levels[k].max())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SHAPE.split(", ")])

    return segments(rows, segment, halo).groupBy("clip_id", "segment").applyInPandas(run, SHAPE)


def scaled(rows: DataFrame) -> DataFrame:
    """Masks from shapes and levels, with ``words``, the bits that may stay, where a frame has lost some (null: all may)."""

    def run(batches):
        for b in batches:
            out = []
            for clip, i, h, w, shape, level, words in zip(*(b[c] for c in b.columns)):
                s, v = (np.frombuffer(x, np.uint8).reshape(h, w) for x in (shape, level))
                if words is not None:
                    s = s * planes.unpacked([(x["y"], x["w"], x["bits"]) for x in words], h, w)
                mask = A.to_u8(s.astype(np.float32) / 255 * (v.astype(np.float32) / 255)) if s.any() else np.zeros((h, w), np.uint8)
                out.append((clip, i, h, w, mask.tobytes(), s.tobytes(), level))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in MASK.split(", ")])

    few_frames(rows.sparkSession, 8 << 20)
    return rows.select("clip_id", "frame_idx", "height", "width", "shape", "level", "words").mapInPandas(run, MASK)


def masks(frames: DataFrame, found: DataFrame, config: Config, segment: int | None = None) -> DataFrame:
    """Masks of all frames from the patches that passed the gates: smoothed in time, held to what is remembered."""
    made = steps.cut(shapes(frames, found, config, segment), "shapes")
    whole = made.withColumn("words", F.lit(None).cast("array<struct<y:int,w:int,bits:long>>"))
    if config.temporal.prior_window // 2 < 1:
        return scaled(whole)
    kept = steps.cut(planes.remembered(made, config.temporal), "kept")
    size = kept.agg(F.sum(F.size("words") * 48 + 64)).first()[0]
    if size is None:  # no frame has lost anything
        return scaled(whole)
    return scaled(made.join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept.hint("merge"), ["clip_id", "frame_idx"], "left"))


def repaired(depth: DataFrame, mask: DataFrame, config: Config, bits: int = 10, source_range: str = "tv") -> DataFrame:
    """Depth frames with the text healed and painted; the shorter stream ends the clip."""
    m = mask.select("clip_id", "frame_idx", F.col("height").alias("mh"), F.col("width").alias("mw"), "mask")
    rows = depth.join(m, ["clip_id", "frame_idx"])
    options, columns = config.composite, depth.columns

    def run(batches):
        for b in batches:
            done = []
            for h, w, data, mh, mw, mask in zip(*(b[c] for c in ("height", "width", "data", "mh", "mw", "mask"))):
                alpha = np.frombuffer(mask, np.uint8).reshape(mh, mw).astype(np.float32) / 255
                plane = np.frombuffer(data, np.uint16).reshape(h, w)
                done.append(R.composite(plane, R.resize_alpha(alpha, w, h), options, bits, source_range).tobytes())
            b = b[columns].copy()
            b["data"] = done
            yield b

    return rows.select(*columns, "mh", "mw", "mask").mapInPandas(run, depth.schema)


def run(
    frames: DataFrame,
    dets: DataFrame,
    config: Config,
    depth: DataFrame | None = None,
    codes: tuple[float, float] = (64.0, 940.0),
    model=None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Masks of clips from their frames and boxes: merging, geometry, appearance, extraction, persistence, time, memory.

    Pixels are read once, to judge boxes and extract glyphs; ``sizes`` (clip_id,
    frame_idx, height, width) spare a scan of the frames' narrow columns.
    ``depth`` planes, whose ``codes`` are the ends of their range, veto glyphs
    off the text's depth; ``model`` gives learned strokes of a frame.
    """
    from . import tracks

    every = config.detect.detect_every
    narrow = ["clip_id", "frame_idx", "height", "width"]
    sizes = sizes if sizes is not None else steps.cut(frames.select(*narrow), "sizes")
    kept = steps.cut(boxes(sizes, dets.where(F.pmod("frame_idx", F.lit(every)) == 0) if every > 1 else dets, config), "boxes")
    held = steps.cut(patches(frames, kept, config, depth, codes, model, config.filters.scene_text == "keep"), "patches")
    kept = kept.join(held.select("clip_id", "frame_idx", "det_id"), ["clip_id", "frame_idx", "det_id"])
    held = held.where("alpha is not null")
    if every > 1:  # a skipped frame shows what the last detected one did
        offsets = F.explode(F.sequence(F.lit(0), F.lit(every - 1)))
        ends = sizes.select("clip_id", "frame_idx")
        kept = kept.withColumn("_o", offsets).withColumn("frame_idx", F.col("frame_idx") + F.col("_o")).drop("_o").join(ends, ["clip_id", "frame_idx"])
        held = held.withColumn("_o", offsets).withColumn("frame_idx", F.col("frame_idx") + F.col("_o")).drop("_o").join(ends, ["clip_id", "frame_idx"])
    stay = tracks.persistence(kept, sizes, config.filters).where("keep").select("clip_id", "frame_idx", "det_id")
    return masks(sizes, held.join(stay, ["clip_id", "frame_idx", "det_id"]), config)


def measured(masks_: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, coverage): the opacity-weighted share of each mask."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"clip_id": b["clip_id"], "frame_idx": b["frame_idx"], "coverage": [np.frombuffer(m, np.uint8).sum(dtype=np.int64) / (255.0 * max(1, len(m))) for m in b["mask"]]})

    few_frames(masks_.sparkSession, 2 << 20)
    return masks_.select("clip_id", "frame_idx", "mask").mapInPandas(run, "clip_id string, frame_idx long, coverage double")


def ink(masks_: DataFrame, dets: DataFrame) -> DataFrame:
    """(clip_id, frame_idx, det_id, x, y, v) of the mask's pixels above 0 inside each box, for ``scan.tilts``."""
    rows = _with_boxes(masks_.select("clip_id", "frame_idx", "height", "width", "mask"), dets)

    def run(batches):
        for b in batches:
            for clip, i, h, w, mask, found in zip(*(b[c] for c in b.columns)):
                plane = np.frombuffer(mask, np.uint8).reshape(h, w)
                for d in found:
                    x0, y0 = max(0, int(d["x0"])), max(0, int(d["y0"]))
                    part = plane[y0 : max(0, int(d["y1"])), x0 : max(0, int(d["x1"]))]
                    ys, xs = np.nonzero(part)
                    yield pd.DataFrame({"clip_id": clip, "frame_idx": i, "det_id": d["det_id"], "x": xs + x0, "y": ys + y0, "v": part[ys, xs].astype(np.int64)})

    few_frames(masks_.sparkSession, 2 << 20)
    return rows.select("clip_id", "frame_idx", "height", "width", "mask", "boxes").mapInPandas(run, "clip_id string, frame_idx long, det_id long, x long, y long, v long")


def masks_for(frames: DataFrame, dets: DataFrame, wanted: DataFrame, config: Config, **more) -> DataFrame:
    """Masks of the ``wanted`` frames (clip_id, frame_idx), from the frames within the halo of them alone.

    The halo is the sum of the stages' radii, so each mask is that of a full run.
    Boxes are looked up in frames so far away alone, masks of frames around the wanted ones serve as memory.
    """
    around = wanted.select("clip_id", F.explode(F.sequence(F.col("frame_idx") - config.halo, F.col("frame_idx") + config.halo)).alias("frame_idx")).distinct()
    near, found = (x.join(around, ["clip_id", "frame_idx"], "left_semi") for x in (frames, dets))
    if more.get("sizes") is not None:
        more["sizes"] = more["sizes"].join(around, ["clip_id", "frame_idx"], "left_semi")
    return run(near, found, config, **more).join(wanted.distinct(), ["clip_id", "frame_idx"], "left_semi")
