"""Column functions over pixel values: all native, none rounds other than half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0


def chromaticity(r: Column, g: Column, b: Column, least: int = 48) -> tuple[Column, Column, Column]:
    """(red share, green share, whether the pixel is bright enough to have a hue)."""
    total = r + g + b
    return r / F.greatest(total, F.lit(1)), g / F.greatest(total, F.lit(1)), total >= least


def to_u8(a: Column) -> Column:
    return clip(F.rint(a * 255.0), 0.0, 255.0).cast("long")


def from_u8(v: Column) -> Column:
    return v / 255.0


def code_range(bit_depth: Column, value_range: Column) -> tuple[Column, Column]:
    """Least and greatest legal luma code for ``tv`` or ``pc``; null for any other range."""
    unit = F.pow(F.lit(2.0), bit_depth - 8)
    low = F.when(value_range == "pc", 0.0).when(value_range == "tv", 16.0 * unit)
    high = F.when(value_range == "pc", 256.0 * unit - 1.0).when(value_range == "tv", 235.0 * unit)
    return low, high


def resolve_range(wanted: Column, source: Column) -> Column:
    return F.when(wanted == "auto", source).otherwise(wanted)


def brightness_to_code(brightness: Column, bit_depth: Column, value_range: Column) -> Column:
    low, high = code_range(bit_depth, value_range)
    return low + clip(brightness, 0.0, 1.0) * (high - low)


def depth_guide(plane: Column, low: Column, high: Column) -> Column:
    return clip((plane - low) / F.greatest(high - low, F.lit(1.0)), 0.0, 1.0)


def normalised(alpha: Column, level: Column) -> Column:
    return F.when(level <= 1e-6, alpha).otherwise(clip(alpha / level, 0.0, 1.0))


def scale_by(shape: Column, level: Column) -> Column:
    """Both in 0..255; the product of the shares, back in 0..255."""
    return to_u8(from_u8(shape) * from_u8(level))


def over_127(v: Column) -> Column:
    return F.when(v > 127, 255).otherwise(0)


def blend(depth: Column, alpha: Column, value: Column, max_code: Column) -> Column:
    mixed = depth * (1.0 - alpha) + value * alpha
    return clip(F.rint(mixed), F.lit(0.0), max_code.cast("double")).cast("long")


def text_coloured(r: Column, g: Column, b: Column, min_bright: float, min_sat: float, warm: bool = True) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    hit = (top > min_bright) & ((top - low) / F.greatest(top, F.lit(1)) > min_sat)
    return hit & (r > g) & (g > b) if warm else hit


def residual_opacity(signal: Column, background: Column, light: bool, least: float) -> Column:
    """Share of the text colour in a pixel, from what it stands out by over the background."""
    reference = 1.0 if light else 0.0
    return clip(signal / F.greatest(F.abs(reference - background), F.lit(least)), 0.0, 1.0)


def depth_to_display(code: Column, max_code: Column) -> Column:
    return clip(code / max_code * 255.0, 0.0, 255.0)
