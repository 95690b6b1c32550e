"""Image kernels on pixel buffers and JPEG headers."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.images import DARK, LIGHT, qualities
from .objects import Name


def resolve_space(doc, x) -> tuple[int, bool]:
    """(components, whether CMYK); 0 components if the colour space isn't supported."""
    x = doc.get(x)
    if isinstance(x, list) and len(x) >= 2 and doc.get(x[0]) == "/ICCBased":
        n = doc.get(doc.dict_of(x[1]).get("/N"))
        return (n, n == 4) if n in (1, 3, 4) else (0, False)
    return {"/DeviceRGB": (3, False), "/DeviceGray": (1, False), "/DeviceCMYK": (4, True)}.get(x if isinstance(x, Name) else "", (0, False))


def is_gray(pixels: bytes) -> bool:
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 3)
    return bool((p[:, 0] == p[:, 1]).all() and (p[:, 0] == p[:, 2]).all())


def is_bitonal(pixels: bytes) -> bool:
    p = np.frombuffer(pixels, np.uint8)
    return not ((p > DARK) & (p < LIGHT)).any()


def pack_bits(pixels: bytes, width: int, height: int) -> bytes:
    p = np.frombuffer(pixels, np.uint8).reshape(height, width)
    return np.packbits(p >= LIGHT, axis=1).tobytes()


def cmyk_to_rgb(pixels: bytes) -> bytes:
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 4) / 255.0
    return np.floor(255 * (1 - p[:, :3]) * (1 - p[:, 3:]) + 0.5).astype(np.uint8).tobytes()


def bilinear(pixels: bytes, width: int, height: int, comps: int, to_w: int, to_h: int) -> bytes:
    """Top-left aligned, edges clamped, rounded half up."""
    p = np.frombuffer(pixels, np.uint8).reshape(height, width, comps).astype(float)
    ys, xs = np.arange(to_h) * (height / to_h), np.arange(to_w) * (width / to_w)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8).tobytes()


def zigzag() -> np.ndarray:
    """For each place in zigzag order, its place row by row: along diagonals, turning at each."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


_ZIG = zigzag().tolist()


def luminance_table(jpeg: bytes) -> list[int] | None:
    """Quantisation table 0, row by row, from the markers before the first scan."""
    if jpeg[:2] != b"\xff\xd8":
        return None
    at, found = 2, None
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        mark = jpeg[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        if mark in (0xD9, 0xDA):
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        if mark == 0xDB:
            low, end = at + 4, at + 2 + size
            while low < end:
                wide, slot = jpeg[low] >> 4, jpeg[low] & 15
                step = 128 if wide else 64
                body = jpeg[low + 1 : low + 1 + step]
                if len(body) == step and slot == 0:
                    values = struct.unpack(">64H" if wide else "64B", body)
                    table = [0] * 64
                    for v, place in zip(values, _ZIG):
                        table[place] = v
                    found = table
                low += 1 + step
        at += 2 + size
    return found


def estimate_quality(jpeg: bytes) -> int:
    """``functions.images.qualities`` of a file's table; -1 if there is none."""
    table = luminance_table(jpeg)
    return -1 if table is None else int(qualities(np.array([table]))[0])
