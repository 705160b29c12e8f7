import numpy as np
import pytest

from filmloom.config import Composite, Strokes, Temporal
from filmloom.kernels import arrays as A, glyphs as G, repair as R

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("size", [3, 7, 13])
def test_median_blur(size):
    a = RNG.integers(0, 256, (17, 23)).astype(np.uint8)
    p = np.pad(a, size // 2, mode="edge")
    want = np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*a.shape, -1), axis=2)
    assert (A.median_blur(a, size) == want).all()


def flood(mask, diagonal):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        labels[y, x] = n
        while todo:
            b, c = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (diagonal or not (dy and dx)):
                        v, u = b + dy, c + dx
                        if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not labels[v, u]:
                            labels[v, u] = n
                            todo.append((v, u))
    return labels, n


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    for share in (0.1, 0.4, 0.6, 0.9):
        m = RNG.random((14, 19)) < share
        got, n = A.components(m, diagonal)
        want, k = flood(m, diagonal)
        assert n == k and len(set(zip(got.ravel().tolist(), want.ravel().tolist()))) == k + 1
        s = A.component_stats(got, n)
        assert s["area"].sum() == m.sum() and (s["w"] >= 1).all()


def test_nearest_unset_is_exact():
    m = RNG.random((12, 18)) < 0.85
    far, row, column = A.nearest_unset(m)
    ys, xs = np.nonzero(~m)
    for y in range(12):
        for x in range(18):
            assert far[y, x] == pytest.approx(np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()))
    assert (~m[row, column]).all()


def test_morphology_and_holes():
    assert A.ellipse(3).tolist() == [[False, True, False], [True] * 3, [False, True, False]]
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert A.fill_holes(ring)[4, 4] and not A.fill_holes(ring)[0, 0]
    solid = np.ones((5, 5), bool)
    assert A.erode(solid, np.ones((3, 3), bool), outside_set=False).sum() == 9
    assert A.dilate(np.eye(3, dtype=np.uint8), A.ellipse(3)).sum() == 7
    bar = np.zeros((9, 30), bool)
    bar[3:6, 2:28] = True
    assert A.stroke_width(bar) == pytest.approx(2 * 2 * A.STRAIGHT)


def test_temporal_median_of_even_windows_is_floored():
    a, b = np.array([[10]], np.uint8), np.array([[13]], np.uint8)
    assert A.temporal([a, b], a, "median")[0, 0] == 11
    assert A.temporal([a, b], a, "max")[0, 0] == 13
    with pytest.raises(ValueError):
        A.temporal([a, b], a, "mean")


def test_resize_keeps_means():
    a = RNG.random((12, 16)).astype(np.float32)
    assert A.resize(a, 4, 3, "area").mean() == pytest.approx(a.mean(), abs=1e-6)
    assert A.resize(np.ones((3, 4), np.float32), 9, 7, "linear") == pytest.approx(np.ones((7, 9)))


def scene(ink, ground=60, opacity=1.0):
    img = np.full((80, 200, 3), float(ground)) + RNG.integers(0, 12, (80, 200, 1))
    for k in range(6):
        cut = img[25:55, 20 + k * 25 : 26 + k * 25]
        cut[:] = cut * (1 - opacity) + ink * opacity
    return img.astype(np.uint8)


@pytest.mark.parametrize("ink,ground,sign", [(250, 60, "light"), (5, 200, "dark")])
def test_extract_finds_both_polarities(ink, ground, sign):
    p = G.extract(scene(ink, ground), (15, 20, 170, 60))
    assert p.polarity == sign and abs(int((p.alpha > 0.5).sum()) - 1080) < 60


def test_a_fade_keeps_its_opacity_and_its_shape():
    p = G.extract(scene(255, opacity=0.4), (15, 20, 170, 60))
    assert p.level == pytest.approx(0.4, abs=0.1) and (p.shape > 0.5).sum() > 900


def test_flat_crops_give_nothing():
    assert G.extract(np.full((80, 200, 3), 90, np.uint8), (15, 20, 170, 60)) is None
    assert G.extract(np.full((80, 200, 3), 90, np.uint8), (5, 5, 5, 5), Strokes(pad=0)) is None


def test_composite_touches_nothing_but_the_text():
    plane = RNG.integers(200, 300, (60, 90)).astype(np.uint16)
    assert (R.composite(plane, np.zeros((60, 90), np.float32), Composite(), 10, "tv") == plane).all()
    alpha = np.zeros((60, 90), np.float32)
    alpha[28:32, 40:50] = 1
    out = R.composite(plane, alpha, Composite(), 10, "tv")
    far = np.ones((60, 90), bool)
    far[10:50, 20:70] = False
    assert (out[far] == plane[far]).all() and out[30, 45] > 800
    with pytest.raises(ValueError):
        R.composite(plane, alpha[:5], Composite(), 10, "tv")


@pytest.mark.parametrize("smooth", [0.0, 2.0])
def test_healing_by_parts_equals_healing_the_whole(smooth):
    depth = RNG.integers(0, 1000, (150, 160)).astype(np.float32)
    mask = np.zeros((150, 160), bool)
    mask[70:80, 70:95] = True
    mask[60:90, 97:99] = True
    mask[0:4, 0:9] = True
    mask[84:86, 60:96] = True
    mask |= RNG.random(mask.shape) < 0.02
    _, row, column = A.nearest_unset(mask)
    filled = depth[row, column]
    want = np.where(mask, A.gaussian_blur(filled, smooth), depth) if smooth else filled
    assert R.heal(depth, mask, smooth) == pytest.approx(want, abs=1e-2)


def test_strokes_are_judged_as_if_each_were_alone():
    shape = np.zeros((60, 120), np.float32)
    shape[10:40, 10:14] = 1
    shape[10:40, 16:20] = 1
    shape[12:38, 40:80] = 1
    shape[50, 100] = 1
    kept = G.keep_strokes(shape, Strokes(max_stroke=10.0, solidify=False))
    assert kept[20, 11] and kept[20, 17] and not kept[20, 60] and not kept[50, 100]
    assert G.keep_strokes(shape, Strokes(min_cc_area=2000)) is None


def test_blobs_off_the_text_depth_are_dropped():
    shape, depth = np.zeros((60, 200), np.float32), np.full((60, 200), 0.2, np.float32)
    for k in range(6):
        shape[20:40, 10 + 30 * k : 14 + 30 * k] = 1
    depth[:, 158:180] = 0.9
    kept = G.keep_strokes(shape, Strokes(), depth=depth)
    assert kept[30, 11] and kept[30, 131] and not kept[30, 161]
    depth[:, 60:180] = 0.9  # no majority any more at one value
    depth[:, 60:120] = 0.55
    assert G.keep_strokes(shape, Strokes(), depth=depth)[30, 161]
    assert G.keep_strokes(shape, Strokes(depth_tol=0), depth=depth)[30, 161]


def test_medians_of_groups():
    k, v = RNG.integers(0, 7, 300), RNG.random(300)
    got = G.medians(k, v, 9)
    assert got[:7] == pytest.approx([np.median(v[k == g]) for g in range(7)]) and np.isnan(got[7:]).all()


def test_appearance():
    got = G.appearance(scene(250), (15, 20, 170, 60))
    assert got[0] > 0.5 and got[2] < 0.05
    assert G.appearance(scene(250), (15, 20, 17, 60)) is None


def test_memory_drops_specks_and_spares_moved_text():
    solid = np.zeros((40, 60), np.uint8)
    solid[10:20, 10:14] = 255
    faint = solid.copy()
    faint[30:33, 50:53] = 255
    got = R.remember(faint, [(solid, 255), (faint, 80)], Temporal())
    assert got[31, 51] == 0 and (got[10:20, 10:14] == 255).all()
    moved = np.roll(solid, 25, axis=1)
    assert (R.remember(moved, [(solid, 255)], Temporal()) == moved).all()
    assert (R.remember(faint, [(faint, 80)], Temporal()) == faint).all()
