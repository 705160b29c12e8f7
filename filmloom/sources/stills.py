"""Stills as bytes: PNG, PGM, PPM and plain TIFF in 8 or 16 bits, read with the standard library; all but TIFF are written too.

Palettes, 1 to 4 bits, interlaced PNGs, and TIFFs in tiles or packed otherwise
than by Deflate or PackBits are refused.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_PNM = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """H x W or H x W x C array as stored, 8 or 16 bits; damaged files raise ValueError."""
    if data[:8] == _SIGNATURE:
        return _decode_png(data)
    if data[:2] in (b"P5", b"P6"):
        return _decode_pnm(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _decode_tiff(data)
    raise ValueError("neither PNG nor PGM nor PPM nor TIFF")


def size_of(head: bytes, whole) -> tuple[int, int]:
    """(height, width) of a still from its first bytes; ``whole`` gives all of a file of another format."""
    if head[:8] == _SIGNATURE and len(head) >= 24:
        w, h = struct.unpack_from(">II", head, 16)
        return h, w
    found = _PNM.match(head)
    if found:
        return int(found[3]), int(found[2])
    return decode(whole()).shape[:2]


def encode(image: np.ndarray, suffix: str = ".png") -> bytes:
    if suffix in (".pgm", ".ppm"):
        h, w = image.shape[:2]
        kind = b"P5" if image.ndim == 2 else b"P6"
        top = 255 if image.dtype == np.uint8 else 65535
        return b"%s\n%d %d\n%d\n" % (kind, w, h, top) + image.astype(">u2" if top > 255 else "u1").tobytes()
    return _encode_png(image)


def _decode_pnm(data: bytes) -> np.ndarray:
    head = _PNM.match(data)
    if not head:
        raise ValueError("damaged PNM header")
    w, h, top = int(head[2]), int(head[3]), int(head[4])
    shape = (h, w) if head[1] == b"P5" else (h, w, 3)
    kind = np.dtype(">u2" if top > 255 else "u1")
    if len(data) - head.end() < int(np.prod(shape)) * kind.itemsize:
        raise ValueError("PNM ends early")
    return np.frombuffer(data, kind, int(np.prod(shape)), head.end()).reshape(shape).astype(kind.newbyteorder("="))


def _chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        yield kind, body
        at += 12 + n


def _decode_png(data: bytes) -> np.ndarray:
    header, packed = None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or header[2] not in (8, 16) or header[3] not in _CHANNELS or header[6]:
        raise ValueError("PNG of a kind that is not read: 8 or 16 bits, no palette, not interlaced")
    w, h, depth, colour = header[:4]
    unit = _CHANNELS[colour] * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"damaged PNG: {e}") from None
    if raw.size < h * (w * unit + 1):
        raise ValueError("PNG ends early")
    lines = raw[: h * (w * unit + 1)].reshape(h, w * unit + 1)
    out = _unfiltered(lines[:, 0], lines[:, 1:].reshape(h, w, unit)).reshape(h, w * unit)
    if depth == 16:
        out = out.view(">u2").astype(np.uint16)
    return out.reshape((h, w) if _CHANNELS[colour] == 1 else (h, w, _CHANNELS[colour]))


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines (h, w, bytes of a pixel) with their filters undone.

    Lines that hang on pixels beside and above at once are done along
    diagonals: all pixels with the same x + y need only earlier ones.
    """
    if (kinds > 4).any():
        raise ValueError(f"PNG filter {kinds.max()}")
    h, w, unit = lines.shape
    out = np.zeros((h + 1, w + 1, unit), np.uint8)  # one line above and one pixel to the left, all 0
    if (kinds < 3).all():
        for y, kind in enumerate(kinds):
            line = np.cumsum(lines[y], axis=0, dtype=np.uint8) if kind == 1 else lines[y]
            out[y + 1, 1:] = line + out[y, 1:] if kind == 2 else line
        return out[1:, 1:]
    for s in range(h + w - 1):
        y = np.arange(max(0, s - w + 1), min(h, s + 1))
        x, kind = s - y, kinds[y][:, None]
        left, up, corner = (out[a, b].astype(np.int16) for a, b in ((y + 1, x), (y, x + 1), (y, x)))
        far = [np.abs(left + up - corner - v) for v in (left, up, corner)]
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = lines[y, x] + guess.astype(np.uint8)
    return out[1:, 1:]


#: Numbers of TIFF tags: fixed values.
_WIDTH, _HEIGHT, _BITS, _PACKED, _STRIPS, _SAMPLES, _SIZES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 279, 284, 317


def _decode_tiff(data: bytes) -> np.ndarray:
    order = "<" if data[:2] == b"II" else ">"
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter:
                form = f"{order}{count}{letter}"
                place = at + 10 + 12 * k
                place = place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(form, data, place)
        w, h, samples = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
        bits, packed = set(tags.get(_BITS, (1,))), tags.get(_PACKED, (1,))[0]
        parts = [data[a : a + size] for a, size in zip(tags[_STRIPS], tags[_SIZES])]
    except (struct.error, KeyError) as e:
        raise ValueError(f"damaged TIFF: {e}") from None
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}.get(packed)
    if unpack is None or bits not in ({8}, {16}) or (samples > 1 and tags.get(_PLANAR, (1,))[0] != 1):
        raise ValueError("TIFF of a kind that is not read")
    kind = np.dtype(f"{order}u2" if bits == {16} else "u1")
    try:
        raw = b"".join(map(unpack, parts))
    except zlib.error as e:
        raise ValueError(f"damaged TIFF: {e}") from None
    if len(raw) < h * w * samples * kind.itemsize:
        raise ValueError("TIFF ends early")
    image = np.frombuffer(raw, kind, h * w * samples).reshape(h, w, samples).astype(kind.newbyteorder("="))
    if tags.get(_PREDICTOR, (1,))[0] == 2:
        image = np.cumsum(image, axis=1, dtype=image.dtype)
    return image[..., 0] if samples == 1 else image


def _unpacked_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _encode_png(image: np.ndarray) -> bytes:
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    h, w = image.shape[:2]
    wide = image.dtype == np.uint16
    rows = image.astype(">u2" if wide else "u1").reshape(h, -1).view(np.uint8).reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 16 if wide else 8, colour, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def as_rgb(image: np.ndarray) -> np.ndarray:
    """Three bytes a pixel: gray repeated, alpha dropped, 16 bits cut to the upper 8."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    if image.ndim == 2:
        return np.repeat(image[..., None], 3, axis=2)
    return image[..., :1].repeat(3, axis=2) if image.shape[2] < 3 else image[..., :3]


def plane_of(image: np.ndarray) -> np.ndarray:
    """One plane of 16 bits: the mean of the channels, half to even."""
    return image.astype(np.uint16) if image.ndim == 2 else np.rint(image.mean(axis=2)).astype(np.uint16)


def with_plane(image: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The still with what changed in its plane added to every channel, so untouched pixels stay as they were."""
    change = plane.astype(np.int32) - plane_of(image).astype(np.int32)
    if image.ndim == 3:
        change = change[..., None]
    return np.clip(image.astype(np.int32) + change, 0, np.iinfo(image.dtype).max).astype(image.dtype)
