"""Text detectors: tables of boxes found elsewhere, and detectors that look at batches of pictures in the tasks."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


class BatchDetector(Protocol):
    """Looks at RGB frames (height x width x 3, 8 bits), several at once."""

    def detect(self, frames: list[np.ndarray]) -> list[list[tuple[float, float, float, float, float]]]:
        """For every frame its boxes: x0, y0, x1, y1 in pixels and score."""


class WordReader(Protocol):
    def read(self, frame: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> list[tuple[str, float]]:
        """A word and its confidence for every box that reads."""


#: name -> makes a ``BatchDetector``; called once in a worker.
BATCH: dict[str, Callable[[], BatchDetector]] = {}
#: name -> makes a ``WordReader``.
READERS: dict[str, Callable[[], WordReader]] = {}
_made: dict[tuple, object] = {}


def register(name: str):
    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


def register_batch(name: str, of: dict | None = None):
    def keep(f):
        (BATCH if of is None else of)[name] = f
        return f

    return keep


def instance(kind: str, name: str, make: Callable[[], object]):
    """The worker's only detector or reader of that name."""
    key = (kind, name, getattr(make, "__qualname__", ""))
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _looked(detectors: list, pictures: list[np.ndarray]) -> list[tuple[list, str | None]]:
    """Boxes (detector_ord, x0, y0, x1, y1, score) of each picture; where a batch fails its pictures are tried one by one."""
    found: list[tuple[list, str | None]] = [([], None) for _ in pictures]

    def add(k: int, d, some: list[int]) -> None:
        for i, boxes in zip(some, d.detect([pictures[i] for i in some])):
            found[i][0].extend((k, *(int(v) for v in (np.floor(b[0]), np.floor(b[1]), np.ceil(b[2]), np.ceil(b[3]))), float(b[4])) for b in boxes)

    for k, d in enumerate(detectors):
        try:
            add(k, d, list(range(len(pictures))))
        except Exception:  # noqa: BLE001  what a plug-in raises is its own
            for i in range(len(pictures)):
                try:
                    add(k, d, [i])
                except Exception as e:  # noqa: BLE001
                    found[i] = (found[i][0], f"{type(e).__name__}: {e}")
    return found


BOXES = "array<struct<detector_ord:int,x0:bigint,y0:bigint,x1:bigint,y1:bigint,score:double>>"
SEEN = f"clip_id string, frame_idx long, height int, width int, boxes {BOXES}, error string, seconds double"


def detect_frames(frames: DataFrame, names: tuple[str, ...], batch_size: int = 4, others: tuple[str, ...] = ()) -> DataFrame:
    """(clip_id, frame_idx, height, width, boxes, error, seconds) of frames, seen by the registered batch detectors in turn.

    A picture at which a detector fails has the boxes of the others and says
    what went wrong; one without pixels keeps its own error.
    """
    unknown = [n for n in names if n not in BATCH]
    if unknown:
        raise ValueError(f"no batch detector named {', '.join(map(repr, unknown))}")
    makers = [(n, BATCH[n]) for n in names]
    from .frames import array_of

    has = {"error", "seconds"} <= set(frames.columns)
    chosen = frames if has else frames.withColumns({"error": F.lit(None).cast("string"), "seconds": F.lit(0.0)})
    kinds = dict(frames.dtypes)

    def run(batches):
        detectors = [instance("detector", n, make) for n, make in makers]
        for b in batches:
            rows = list(zip(*(b[c] for c in b.columns)))
            out = []
            for s in range(0, len(rows), batch_size):
                some, start = rows[s : s + batch_size], time.perf_counter()
                good = [r for r in some if r[4] is not None]
                seen = iter(_looked(detectors, [array_of(r[4], int(r[2]), int(r[3]), 3, 8) for r in good]))
                each = (time.perf_counter() - start) / max(1, len(good))
                for r in some:
                    boxes, failed = ([], r[5]) if r[4] is None else next(seen)
                    out.append((r[0], r[1], r[2], r[3], boxes, failed, r[6] + (each if r[4] is not None else 0.0), *r[7:]))
            table = pd.DataFrame(out, columns=["clip_id", "frame_idx", "height", "width", "boxes", "error", "seconds"] + list(others))
            yield table.astype({"height": "Int32", "width": "Int32"})

    picked = chosen.select("clip_id", "frame_idx", "height", "width", "data", "error", "seconds", *others)
    return picked.mapInPandas(run, SEEN + "".join(f", {c} {kinds[c]}" for c in others))


def boxes_of(seen: DataFrame) -> DataFrame:
    """The boxes that ``detect_frames`` found as rows, with det_id, in the detectors' order."""
    return seen.select("clip_id", "frame_idx", F.posexplode("boxes").alias("at", "b")).select(
        "clip_id", "frame_idx", (F.col("at") + 1).cast("long").alias("det_id"), "b.*"
    )


def read_words(frames: DataFrame, boxes: DataFrame, name: str, others: tuple[str, ...] = ()) -> DataFrame:
    """(clip_id, frame_idx, pos, word, confidence) of what the registered reader makes of the boxes, 8 pixels and more each way, of frames."""
    if name not in READERS:
        raise ValueError(f"no word reader named {name!r}")
    make = READERS[name]
    from .frames import array_of

    listed = boxes.groupBy("clip_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("det_id", "x0", "y0", "x1", "y1"))).alias("boxes"))
    kinds = dict(frames.dtypes)
    names = ["clip_id", "frame_idx", "pos", "word", "confidence", *others]

    def run(batches):
        reader = instance("reader", name, make)
        for b in batches:
            out = []
            for clip, i, h, w, data, found, *rest in zip(*(b[c] for c in b.columns)):
                if data is None:
                    continue
                clipped = [(max(0, int(d["x0"])), max(0, int(d["y0"])), min(int(w), int(d["x1"])), min(int(h), int(d["y1"]))) for d in found]
                good = [c for c in clipped if c[2] - c[0] >= 8 and c[3] - c[1] >= 8]
                words = reader.read(array_of(data, int(h), int(w), 3, 8), good) if good else []
                out += [(clip, i, k, word, float(sure), *rest) for k, (word, sure) in enumerate(words)]
            yield pd.DataFrame(out, columns=names)

    rows = frames.join(listed, ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", "height", "width", "data", "boxes", *others)
    return rows.mapInPandas(run, "clip_id string, frame_idx long, pos long, word string, confidence double" + "".join(f", {c} {kinds[c]}" for c in others))


def from_relative(rows: DataFrame, width: int, height: int, min_score: float) -> DataFrame:
    """Boxes in shares of the frame as whole pixels; weak and inverted ones are dropped."""
    kept = rows.where((F.col("score") >= min_score) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    low = {c: F.floor(F.round(F.col(c) * n, 6)).cast("long") for c, n in (("x0", width), ("y0", height))}
    high = {c: F.ceil(F.round(F.col(c) * n, 6)).cast("long") for c, n in (("x1", width), ("y1", height))}
    return kept.withColumns(low | high)


def from_extents(rows: DataFrame) -> DataFrame:
    """Boxes given as an array (xmin, xmax, ymin, ymax); inverted ones are dropped."""
    e = F.col("extent")
    return rows.select(
        *[c for c in rows.columns if c != "extent"], e[0].alias("x0"), e[2].alias("y0"), e[1].alias("x1"), e[3].alias("y1")
    ).where("x1 > x0 and y1 > y0")


@register("table")
def table_detector(rows: DataFrame) -> DataFrame:
    """Boxes as they are."""
    return rows


def detect(names: tuple[str, ...], rows: dict[str, DataFrame]) -> DataFrame:
    """Union of the named detectors' boxes with detector_ord; a name without a detector or rows is left out unless it is the only one."""
    found = []
    for k, name in enumerate(names):
        if name in REGISTRY and name in rows:
            found.append(REGISTRY[name](rows[name]).withColumn("detector_ord", F.lit(k)))
        elif len(names) == 1:
            raise ValueError(f"no detector named {name!r}")
        else:
            warnings.warn(f"detector {name!r} is left out: it is not known or has no rows", stacklevel=2)
    if not found:
        raise RuntimeError("no detector could be used")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
