"""Column functions over names, paths and recognised words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def last_number(name: Column) -> Column:
    """The last run of digits as a number; -1 if there is none."""
    digits = F.regexp_extract(name, r"(\d+)\D*$", 1)
    return F.when(digits == "", F.lit(-1)).otherwise(digits.cast("long")).cast("long")


def pixel_format(fmt: Column) -> tuple[Column, Column]:
    """(chroma, bit depth) of names such as yuv420p10le or gray16be; 420 and 10 if unknown."""
    planar, gray = r"^yuvj?a?(420|422|444)p(\d+)?(?:le|be)?$", r"^gray(\d+)?(?:le|be)?$"
    chroma = F.when(fmt.rlike(planar), F.regexp_extract(fmt, planar, 1)).when(fmt.rlike(gray), "400").otherwise("420")
    digits = F.when(fmt.rlike(planar), F.regexp_extract(fmt, planar, 2)).when(fmt.rlike(gray), F.regexp_extract(fmt, gray, 1))
    depth = F.when(digits.isNull(), 10).when(digits == "", 8).otherwise(digits.try_cast("long"))
    return chroma, depth.cast("long")


def letters(word: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def one_character(word: Column) -> Column:
    return letters(word).rlike(r"^(.)\1+$")


def legible(word: Column, confidence: Column, min_chars: int = 3, min_confidence: float = 0.45) -> Column:
    """Long and sure enough to be writing, and not one character over and over."""
    sure = confidence >= min_confidence  # first, for the rest is expressions over letters
    return sure & (F.length(letters(word)) >= max(1, min_chars)) & ~one_character(word)


def frame_numbers(text: Column) -> Column:
    """Sorted distinct numbers of lists such as ``12,40`` and ``0-120:20``, as an array."""
    form = r"^\s*(\d+)(?:-(\d+))?(?::(\d+))?\s*$"
    parts = F.filter(F.split(text, ","), lambda p: F.length(F.trim(p)) > 0)

    def numbers(p):
        def part(k, other):
            got = F.regexp_extract(p, form, k)
            return F.when(got == "", other).otherwise(got.try_cast("long"))

        first = F.regexp_extract(p, form, 1).try_cast("long")
        last = part(2, first)
        return F.when(last >= first, F.sequence(first, last, F.greatest(part(3, F.lit(1).cast("long")), F.lit(1).cast("long")))).otherwise(
            F.array().cast("array<bigint>")
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def destination(path: Column, source_root: str, dest_root: str) -> Column:
    """``path`` under ``dest_root`` as it lies under ``source_root``; its name alone if it lies elsewhere."""
    inside = F.startswith(path, F.lit(source_root.rstrip("/") + "/"))
    rest = F.substring(path, len(source_root.rstrip("/")) + 2, 1 << 30)
    return F.concat(F.lit(dest_root.rstrip("/") + "/"), F.when(inside, rest).otherwise(file_name(path)))


def fingerprint(size: Column, modified: Column, head: Column) -> Column:
    """16 hex digits of size, whole second of change and leading bytes of a file."""
    text = F.concat(size.cast("string"), F.lit("|"), modified.cast("string"), F.lit("|"), head)
    return F.substring(F.sha2(text, 256), 1, 16)


def depth_destination(depth: Column, clip: Column, source_root: str, dest_root: str) -> Column:
    """A depth map beside its clip's place under ``dest_root``, under its own name."""
    return F.concat(F.regexp_replace(destination(clip, source_root, dest_root), r"[^/]*$", ""), file_name(depth))


def suggested_output(path: Column, is_dir: Column, mark: str = "_fixed") -> Column:
    """Where a repaired ``path`` goes by default: beside it, a folder for a folder, a film without extension as .mp4."""
    ext = F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)
    film = F.concat(F.regexp_replace(path, r"[^/]*$", ""), stem(path), F.lit(mark), F.when(ext == "", ".mp4").otherwise(ext))
    return F.when(is_dir, F.concat(path, F.lit(mark))).otherwise(film)
