"""Array kernels on numpy alone: morphology, medians, components, distances, blur, resize."""

from __future__ import annotations

import numpy as np


def ellipse(size: int) -> np.ndarray:
    """Elliptic footprint of odd ``size``; 3 is a cross."""
    r = size // 2
    dy = np.arange(-r, r + 1)
    reach = np.rint(r * np.sqrt(np.maximum(r * r - dy * dy, 0)) / r if r else np.zeros(1)).astype(int)
    return np.abs(np.arange(-r, r + 1))[None, :] <= reach[:, None]


def _shifted(a: np.ndarray, foot: np.ndarray, start, fold) -> np.ndarray:
    ry, rx = foot.shape[0] // 2, foot.shape[1] // 2
    h, w = a.shape
    out = np.full(a.shape, start, a.dtype)
    for dy, dx in zip(*(np.nonzero(foot)[0] - ry, np.nonzero(foot)[1] - rx)):
        y0, y1, x0, x1 = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
        if y0 < y1 and x0 < x1:
            view = out[y0:y1, x0:x1]
            fold(view, a[y0 + dy : y1 + dy, x0 + dx : x1 + dx], out=view)
    return out


def dilate(a: np.ndarray, foot: np.ndarray) -> np.ndarray:
    """Greatest value under the footprint; what lies outside the image is ignored."""
    start = False if a.dtype == bool else (np.iinfo(a.dtype).min if a.dtype.kind in "iu" else -np.inf)
    return _shifted(a, foot, start, np.logical_or if a.dtype == bool else np.maximum)


def erode(a: np.ndarray, foot: np.ndarray, outside_set: bool = True) -> np.ndarray:
    """Where the whole footprint is set; pixels outside count as set or not."""
    rest = ~dilate(~a, foot)
    if not outside_set:
        edge = np.ones(a.shape, bool)
        ry, rx = foot.shape[0] // 2, foot.shape[1] // 2
        edge[ry : a.shape[0] - ry, rx : a.shape[1] - rx] = False
        rest &= ~edge
    return rest


def median_blur(u8: np.ndarray, size: int) -> np.ndarray:
    """Median of the size x size window, edges repeated.

    For each value that occurs, a summed-area table counts how many of the
    window are at most that value, so the cost does not grow with the window.
    """
    r, need = size // 2, (size * size + 1) // 2
    padded = np.pad(u8, r, mode="edge")
    values = np.unique(u8)
    out = np.full(u8.shape, values[-1], np.uint8)
    todo = np.ones(u8.shape, bool)
    for v in values[:-1]:
        sums = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1), np.int32)
        np.cumsum(np.cumsum(padded <= v, axis=0, dtype=np.int32), axis=1, out=sums[1:, 1:])
        n = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]
        reached = todo & (n >= need)
        out[reached] = v
        todo &= ~reached
        if not todo.any():
            break
    return out


def otsu(values: np.ndarray) -> float:
    """Otsu's threshold over 256 bins up to the greatest value, in the values' own unit."""
    v = values[np.isfinite(values)]
    top = float(v.max()) if v.size else 0.0
    if top <= 1e-6:
        return 0.0
    n = np.bincount(np.clip(v / top * 255.0, 0, 255).astype(np.uint8).ravel(), minlength=256) / v.size
    share, mean = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = 1 - share
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = share * rest * (mean / share - (mean[-1] - mean) / rest) ** 2
    apart[(np.minimum(share, rest) < np.finfo(np.float32).eps) | ~np.isfinite(apart)] = 0
    return int(apart.argmax()) / 255.0 * top


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels 1 .. n of connected pixels, 0 elsewhere: runs of each row joined with those above."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    parent = list(range(len(row)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if start[i] < stop[j] + reach and start[j] < stop[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    _, names = np.unique(roots, return_inverse=True) if len(row) else (None, np.zeros(0, int))
    labels = np.zeros((h, w), np.int32)
    for y, a, b, k in zip(row, start, stop, names):
        labels[y, a:b] = k + 1
    return labels, int(names.max()) + 1 if len(row) else 0


def component_stats(labels: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """area, x, y, w, h of labels 1 .. n."""
    ys, xs = np.nonzero(labels)
    k = labels[ys, xs] - 1
    area = np.bincount(k, minlength=n)
    lo, hi = {}, {}
    for name, v, size in (("x", xs, labels.shape[1]), ("y", ys, labels.shape[0])):
        lo[name], hi[name] = np.full(n, size), np.full(n, -1)
        np.minimum.at(lo[name], k, v)
        np.maximum.at(hi[name], k, v)
    return {"area": area, "x": lo["x"], "y": lo["y"], "w": hi["x"] - lo["x"] + 1, "h": hi["y"] - lo["y"] + 1}


#: Steps of the 3 x 3 chamfer distance, straight and diagonal: fixed values.
STRAIGHT, DIAGONAL = 0.955, 1.3693


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance of set pixels from the nearest unset one."""
    h, w = mask.shape
    d = np.where(mask, np.float64(h + w) * 2, 0.0)
    ramp = STRAIGHT * np.arange(w)

    def along(row):
        return np.minimum.accumulate(row - ramp) + ramp

    def sweep(rows):
        before = None
        for y in rows:
            row = d[y]
            if before is not None:
                row = np.minimum(row, before + STRAIGHT)
                row[1:] = np.minimum(row[1:], before[:-1] + DIAGONAL)
                row[:-1] = np.minimum(row[:-1], before[1:] + DIAGONAL)
            row = along(row)
            before = d[y] = along(row[::-1])[::-1]

    sweep(range(h))
    sweep(range(h - 1, -1, -1))
    return d


def stroke_width(mask: np.ndarray) -> float:
    return 2.0 * float(chamfer(mask).max()) if mask.any() else 0.0


def nearest_unset(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact distance of every pixel to the nearest unset one, and that pixel's row and column."""
    h, w = mask.shape
    ys, far = np.arange(h)[:, None], 4 * (h + w)
    above = np.maximum.accumulate(np.where(mask, -far, ys), axis=0)
    below = np.minimum.accumulate(np.where(mask, far, ys)[::-1], axis=0)[::-1]
    row = np.where(ys - above <= below - ys, above, below)
    gap = (row - ys).astype(np.float64) ** 2
    xs = np.arange(w)
    across = (xs[:, None] - xs[None, :]).astype(np.float64) ** 2
    dist, column = np.zeros((h, w)), np.tile(xs, (h, 1))
    for y in np.flatnonzero(mask.any(axis=1)):
        cost = across + gap[y][None, :]
        column[y] = cost.argmin(axis=1)
        dist[y] = cost[xs, column[y]]
    return np.sqrt(dist), row[ys, column], column


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """``mask`` with the background it encloses; background hangs together by edges."""
    labels, n = components(~mask, diagonal=False)
    edge = np.unique(np.r_[labels[0], labels[-1], labels[:, 0], labels[:, -1]])
    open_ = np.zeros(n + 1, bool)
    open_[edge] = True
    open_[0] = False
    return ~open_[labels]


def blur_reach(sigma: float) -> int:
    return (round(sigma * 8 + 1) | 1) // 2


def gaussian_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian; the image is mirrored at its edges without repeating them."""
    r = blur_reach(sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.arange(-r, n + r)
        if n > 1:
            at = np.abs(at) % (2 * n - 2)
            at = np.where(at >= n, 2 * n - 2 - at, at)
        else:
            at = np.zeros_like(at)
        wide = np.take(out, at, axis=axis)
        out = sum(w * np.take(wide, np.arange(j, j + n), axis=axis) for j, w in enumerate(k))
    return out.astype(np.float32)


def resize(a: np.ndarray, width: int, height: int, mode: str) -> np.ndarray:
    """``area`` (weighted mean of what a pixel covers), ``linear`` or ``nearest``."""
    out = a
    for axis, n in ((0, height), (1, width)):
        m = out.shape[axis]
        if m == n:
            continue
        scale = m / n
        if mode == "nearest":
            out = np.take(out, np.minimum((np.arange(n) * scale).astype(int), m - 1), axis=axis)
            continue
        weights = np.zeros((n, m))
        for i in range(n):
            if mode == "area" and scale > 1:
                lo, hi = i * scale, (i + 1) * scale
                for j in range(int(lo), min(m, int(np.ceil(hi)))):
                    weights[i, j] = max(0.0, min(hi, j + 1) - max(lo, j)) / scale
            else:
                at = min(max((i + 0.5) * scale - 0.5, 0), m - 1)
                j = min(int(at), m - 2) if m > 1 else 0
                weights[i, j] += 1 - (at - j)
                if m > 1:
                    weights[i, j + 1] += at - j
        out = np.moveaxis(np.tensordot(weights, out.astype(np.float64), axes=(1, axis)), 0, axis)
    return out if mode == "nearest" else out.astype(np.float32)


def to_u8(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a * 255.0), 0, 255).astype(np.uint8)


def temporal(stack: list[np.ndarray], current: np.ndarray, mode: str) -> np.ndarray:
    """Median (even stacks: floor of the middle pair's mean) or maximum over a window of byte frames."""
    if mode not in ("median", "max", "none"):
        raise ValueError(f"unknown temporal mode {mode!r}; use median, max or none")
    if mode == "none" or len(stack) <= 1:
        return current
    if mode == "max":
        return np.maximum.reduce(stack)
    s, n = np.sort(np.stack(stack), axis=0).astype(np.uint16), len(stack)
    return ((s[(n - 1) // 2] + s[n // 2]) // 2).astype(np.uint8)
