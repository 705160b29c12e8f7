"""Options of the pipeline: sections, profiles, and the registry that drives command line and checks."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field


# Names and defaults of the options are fixed values: results mean the same only with the same ones.


@dataclass(frozen=True)
class Detect:
    detectors: tuple[str, ...] = ("table",)
    min_score: float = 0.3
    batch_size: int = 4
    detect_every: int = 1


@dataclass(frozen=True)
class Filters:
    roi: str = "bottom:0.30"
    min_text_height: float = 0.012
    max_text_height: float = 0.3
    max_aspect: float = 80.0
    scene_text: str = "keep"
    min_contrast: float = 0.16
    max_chroma_std: float = 0.14
    min_persist_frames: int = 3
    persist_window: int = 9
    persist_iou: float = 0.3
    allow_vertical_scroll: bool = False


@dataclass(frozen=True)
class Strokes:
    pad: int = 4
    polarity: str = "auto"
    min_cc_area: int = 8
    max_cc_area_frac: float = 0.35
    min_stroke: float = 0.8
    max_stroke: float = 16.0
    max_stroke_frac: float = 0.45
    background_scale: float = 0.9
    min_response: float = 0.05
    min_relative_strength: float = 0.75
    luma_tol: float = 0.2
    enclosure_margin: float = 0.15
    enclosure_min: float = 0.5
    solidify: bool = True
    rim_expand: int = 0
    strokes_from: str = "luma"
    weak_fill: float = 0.32
    depth_strokes: bool = False
    depth_tol: float = 0.15
    chroma_tol: float = 0.08
    cluster_min_agree: float = 0.6


@dataclass(frozen=True)
class Temporal:
    mode: str = "median"
    window: int = 3
    prior_window: int = 21
    prior_min_level: float = 0.6
    prior_tolerance: int = 3
    prior_min_overlap: float = 0.5
    prior_min_support: float = 0.35


@dataclass(frozen=True)
class Composite:
    brightness: float = 0.92
    brightness_mode: str = "absolute"
    relative_offset: float = 0.08
    dilate: int = 2
    feather: float = 1.5
    heal: str = "edt"
    heal_scope: str = "glyph"
    heal_dilate: int = 6
    heal_strokes: float = 1.5
    heal_smooth: float = 2.0
    value_range: str = "auto"


@dataclass(frozen=True)
class Sweep:
    clusters: int = 8
    frames: int = 6
    min_cluster_hits: int = 2


@dataclass(frozen=True)
class Thresholds:
    min_coverage: float = 2e-05
    min_text_frames: int = 6
    min_run: int = 3


@dataclass(frozen=True)
class Reading:
    require: bool = True
    min_chars: int = 3
    min_confidence: float = 0.45
    max_frames: int = 3


@dataclass(frozen=True)
class Level:
    require: bool = True
    max_tilt: float = 8.0
    margin: float = 1.2
    min_aspect: float = 0.8
    min_height: int = 8
    min_ink: int = 60
    max_ink: int = 4000


@dataclass(frozen=True)
class Size:
    min_height: float = 0.02
    min_pixels: int = 14


@dataclass(frozen=True)
class Scan:
    windows: int = 8
    window_len: int = 45
    exhaustive: bool = False


@dataclass(frozen=True)
class Config:
    detect: Detect = field(default_factory=Detect)
    filters: Filters = field(default_factory=Filters)
    strokes: Strokes = field(default_factory=Strokes)
    temporal: Temporal = field(default_factory=Temporal)
    composite: Composite = field(default_factory=Composite)
    sweep: Sweep = field(default_factory=Sweep)
    thresholds: Thresholds = field(default_factory=Thresholds)
    reading: Reading = field(default_factory=Reading)
    level: Level = field(default_factory=Level)
    size: Size = field(default_factory=Size)
    scan: Scan = field(default_factory=Scan)

    @property
    def halo(self) -> int:
        """Frames of context either side that make a segment's result exact: the stages' radii add up."""
        radii = (self.filters.persist_window // 2, self.temporal.window // 2, self.temporal.prior_window // 2)
        return max(1, sum(radii)) + self.detect.detect_every - 1

    def with_options(self, **options) -> Config:
        """A copy with dotted options, as in ``with_options(**{"filters.roi": "full"})``."""
        sections: dict[str, dict] = {}
        for name, value in options.items():
            section, _, key = name.partition(".")
            sections.setdefault(section, {})[key] = value
        changed = {s: dataclasses.replace(getattr(self, s), **v) for s, v in sections.items()}
        return dataclasses.replace(self, **changed)


#: Named sets of options; options given one by one win over them.
PROFILES = {
    "subtitles": {"detect.detect_every": 2},
    "credits": {
        "filters.roi": "full",
        "filters.min_persist_frames": 2,
        "filters.allow_vertical_scroll": True,
        "filters.min_contrast": 0.12,
        "temporal.mode": "max",
        "composite.brightness_mode": "relative",
    },
    "both": {"filters.roi": "full", "filters.min_persist_frames": 2, "filters.allow_vertical_scroll": True},
}


def build(profile: str | None = None, **options) -> Config:
    if profile is not None and profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; use one of {', '.join(PROFILES)}")
    return Config().with_options(**(PROFILES.get(profile, {}) | options))


def option_names() -> dict[str, type]:
    """Every dotted option with the type of its default."""
    found = {}
    for section in dataclasses.fields(Config):
        for f in dataclasses.fields(section.default_factory):
            found[f"{section.name}.{f.name}"] = type(getattr(section.default_factory(), f.name))
    return found


def coerce(name: str, value: str):
    """A command-line value as its option's type; whole numbers are rounded."""
    kind = option_names()[name]
    if kind is bool:
        return value.lower() in ("1", "true", "yes", "on")
    if kind is int:
        return round(float(value))
    if kind is tuple:
        return tuple(x for x in value.split(",") if x)
    return kind(value)


def parse_roi(text: str) -> tuple[float, float, float, float]:
    """(x0, y0, x1, y1) in shares of the frame: full, all, bottom:F, top:F or four numbers."""
    plain = text.strip().lower()
    if plain in ("", "full", "all"):
        return 0.0, 0.0, 1.0, 1.0
    try:
        if plain.startswith(("bottom:", "top:")):
            side, _, number = plain.partition(":")
            share = float(number)
            if not 0 < share <= 1:
                raise ValueError
            return (0.0, 1 - share, 1.0, 1.0) if side == "bottom" else (0.0, 0.0, 1.0, share)
        x0, y0, x1, y1 = (float(v) for v in plain.split(","))
        if not (0 <= x0 < x1 <= 1 and 0 <= y0 < y1 <= 1):
            raise ValueError
        return x0, y0, x1, y1
    except ValueError:
        raise ValueError(f"roi {text!r}: use full, bottom:F, top:F or x0,y0,x1,y1 in shares of the frame") from None


def parse_frames(text: str) -> list[int]:
    """Frame numbers of ``12,40`` and ``0-120:20``, sorted, once each."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+)(?::(\d+))?)?", part)
        if not m:
            raise ValueError(f"frames {part!r}: use numbers, A-B or A-B:STEP")
        first, last, step = int(m[1]), int(m[2] or m[1]), int(m[3] or 1)
        found.update(range(first, last + 1, max(1, step)))
    return sorted(found)
