"""Bits of frames as rows against the array kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.config import Temporal
from filmloom.kernels import arrays as A
from filmloom.kernels import repair
from filmloom.operators import planes


def frames_of(spark, stack, clip="c", peaks=None):
    rows = [(clip, i, *a.shape, a.tobytes(), int(255 if peaks is None else peaks[i])) for i, a in enumerate(stack)]
    return spark.createDataFrame(rows, "clip_id string, frame_idx long, height int, width int, shape binary, peak int")


def plane_of(rows, n, shape):
    out = np.zeros((n, *shape), bool)
    for i in range(n):
        out[i] = planes.unpacked([(r.y, r.w, r.bits) for r in rows if r.frame_idx == i], *shape)
    return out


def noise(seed, n, h, w, share):
    rng = np.random.default_rng(seed)
    out = (rng.random((n, h, w)) < share) * rng.integers(128, 256, (n, h, w))
    out[:, h // 3 : h // 3 + 3, 50 : w - 3] = 255  # over a word's border
    return out.astype(np.uint8)


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_packing_union_and_dilation(spark, radius):
    stack = noise(radius, 7, 23, 150, 0.02)
    lit = stack >= 128
    plane = planes.packed(frames_of(spark, stack), "shape").cache()
    assert (plane_of(plane.collect(), 7, (23, 150)) == lit).all()
    near = plane_of(planes.around(plane, 2).where("frame_idx < 7").collect(), 7, (23, 150))
    assert (near == [lit[max(0, k - 2) : k + 3].any(axis=0) for k in range(7)]).all()
    foot = A.ellipse(2 * radius + 1)
    assert (plane_of(planes.dilated(plane, foot).collect(), 7, (23, 150)) == [A.dilate(a, foot) for a in lit]).all()
    pixels = planes.pixels_of(plane).where("frame_idx = 3")
    assert {(r.y, r.x) for r in pixels.collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(lit[3]))))
    again = planes.packed_pixels(pixels, F.lit(True)).collect()
    assert (planes.unpacked([(r.y, r.w, r.bits) for r in again], 23, 150) == lit[3]).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_and_their_boxes(spark, diagonal):
    rng = np.random.default_rng(9)
    stack = (np.concatenate([rng.random((3, 30, 140)) < p for p in (0.15, 0.4)]) * 255).astype(np.uint8)
    snake = np.zeros((30, 140), np.uint8)
    snake[::2, 1:-1] = 255
    for y in range(1, 29, 2):
        snake[y, -2 if y % 4 == 1 else 1] = 255
    stack = np.concatenate([stack, snake[None], np.full((1, 30, 140), 255, np.uint8), np.zeros((1, 30, 140), np.uint8)])
    found = planes.components(planes.packed(frames_of(spark, stack), "shape"), diagonal)
    got = {}
    for r in planes.blobs(found).collect():
        got.setdefault(r.frame_idx, []).append((r.area, r.x0, r.y0, r.x1, r.y1))
    for i, a in enumerate(stack):
        labels, n = A.components(a > 0, diagonal)
        s = A.component_stats(labels, n)
        want = sorted(zip(s["area"].tolist(), s["x"].tolist(), s["y"].tolist(), (s["x"] + s["w"]).tolist(), (s["y"] + s["h"]).tolist())) if n else []
        assert sorted(got.get(i, [])) == want


def scene(kind):
    """Frames of a line that stays, with strangers in some; or of one that moves away."""
    n, rng = 26, np.random.default_rng(3)
    stack = np.zeros((n, 40, 150), np.uint8)
    for i in range(n):
        x = 20 + (6 * i if kind == "moves" else 0)
        stack[i, 10:16, x : x + 60] = 200
        stack[i, 30:34, 100:110] = 255 if i % 9 == 0 else 0
        stack[i, rng.integers(20, 40, 3), rng.integers(0, 150, 3)] = 255
    peaks = np.full(n, 250)
    if kind == "fades":
        peaks[:8] = 60
    if kind == "faint":
        peaks[:] = 30
    if kind == "strangers":
        stack[5] = 0
        stack[5, 36:39, 5:9] = 255
    return stack, peaks


@pytest.mark.parametrize("kind,options", [("stays", {}), ("moves", {}), ("fades", {}), ("faint", {}), ("strangers", {}), ("stays", {"prior_min_overlap": 0.0, "prior_window": 3}), ("strangers", {"prior_min_overlap": 0.0, "prior_tolerance": 1})])
def test_memory_is_that_of_the_kernel(spark, kind, options):
    stack, peaks = scene(kind)
    temporal = Temporal(**options)
    p = temporal.prior_window // 2
    seen = list(zip(stack, peaks.tolist()))
    want = [repair.remember(stack[k], seen[max(0, k - p) : k + p + 1], temporal) for k in range(len(stack))]
    held = {r.frame_idx: r.words for r in planes.remembered(frames_of(spark, stack, peaks=peaks), temporal).collect()}
    for k, a in enumerate(stack):
        got = a if held.get(k) is None else a * planes.unpacked([tuple(w) for w in held[k]], *a.shape)
        assert (got == want[k]).all(), k
    if kind == "fades":
        assert any((a != b).any() for a, b in zip(stack, want))


def test_nearest_valid_by_two_passes(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(6):
        mask = rng.random((9, 14)) < (0.3, 0.8, 0.95)[i % 3]
        mask[0, 0] = i == 5
        mask = mask | (i == 5)
        rows += [("c", i, y, x, None if mask[y, x] else 100 * y + x) for y in range(9) for x in range(14)]
        if not mask.all():
            far, _, _ = A.nearest_unset(mask)
            want[i] = np.rint(far**2).astype(int)
    df = spark.createDataFrame(rows, "clip_id string, frame_idx long, y long, x long, v long")
    for r in planes.nearest_valid(df, 20).collect():
        if r.frame_idx == 5:
            assert r.v is None and r.gap is None
        else:
            assert r.gap == want[r.frame_idx][r.y, r.x] == (r.y - r.v // 100) ** 2 + (r.x - r.v % 100) ** 2
    near = planes.nearest_valid(df.where("frame_idx = 2"), 1).collect()
    assert all((r.v is not None) == (want[2][r.y, r.x] <= 2) for r in near)
