"""Image decisions as column expressions: colours, sizes, JPEG quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the luminance table of the public JPEG standard (annex K), row by row
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
SKIP_QUALITY, TARGET_QUALITY, MAX_DPI = 65, 75, 72  # fixed values
TINY, SIDE = 2500, 16384  # fixed values: pixels below which, sides above which images stay
DARK, LIGHT = 32, 224  # fixed values: gray levels that count as black and white
POOR_FIT = 128  # fixed value: sum of differences above which a table has no quality


def components(space: Column, icc_n: Column) -> Column:
    """Components of a colour space; 0 if it isn't supported."""
    return F.when(space == "/DeviceRGB", 3).when(space == "/DeviceGray", 1).when(space == "/DeviceCMYK", 4).when((space == "/ICCBased") & icc_n.isin(1, 3, 4), icc_n).otherwise(0)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    light = 1 - k / F.lit(255.0)
    return [F.floor(255 * (1 - x / F.lit(255.0)) * light + 0.5).cast("int") for x in (c, m, y)]


def target_size(width: Column, height: Column, drawn_w: Column, drawn_h: Column, max_dpi: float = MAX_DPI) -> tuple[Column, Column, Column]:
    """(dpi, new width, new height); the new ones equal the old where the image stays."""
    dpi = F.greatest(width / (drawn_w / 72.0), height / (drawn_h / 72.0))
    scale = F.lit(float(max_dpi)) / dpi
    w, h = (F.greatest(F.lit(1), F.floor(x * scale + 0.5)) for x in (width, height))
    go = (dpi > max_dpi) & ~((width - w <= 1) & (height - h <= 1))
    return dpi, F.when(go, w).otherwise(width).cast("long"), F.when(go, h).otherwise(height).cast("long")


def qualities(tables: np.ndarray) -> np.ndarray:
    """Of quantisation tables (rows of 64 numbers): the quality whose standard table is nearest,
    the lowest on ties; -1 if none is near."""
    q = np.arange(1, 101)[:, None]
    want = np.clip((np.array(LUMINANCE)[None] * np.where(q < 50, 5000 // q, 200 - 2 * q) + 50) // 100, 1, 255)
    out = np.empty(len(tables), np.int32)
    for at in range(0, len(tables), 256):
        error = np.abs(tables[at : at + 256, None] - want[None]).sum(2)
        out[at : at + 256] = np.where(error.min(1) > POOR_FIT, -1, error.argmin(1) + 1)
    return out


def estimate_quality(table: Column) -> Column:
    """``qualities`` of an array column, a batch at a time; null for null."""

    def each(tables: pd.Series) -> pd.Series:
        known = tables.notna()
        out = pd.Series(None, index=tables.index, dtype="Int32")
        if known.any():
            out[known] = qualities(np.array(tables[known].tolist(), np.int64).reshape(-1, 64))
        return out

    return F.pandas_udf(each, "int")(table)


def is_bitonal(pixels: Column) -> Column:
    return ~F.exists(pixels, lambda v: (v > DARK) & (v < LIGHT))


def pack_row(pixels: Column) -> Column:
    """Eight gray pixels as one byte, the first in the highest bit."""
    return F.aggregate(pixels, F.lit(0), lambda a, v: a * 2 + F.when(v >= LIGHT, 1).otherwise(0))


def only_if_smaller(new: Column, old: Column) -> Column:
    return F.when(F.octet_length(new) < F.octet_length(old), new).otherwise(old)


def bilinear(pixels: Column, width: int, height: int, to_w: int, to_h: int) -> Column:
    """A gray image (array, row by row) at a smaller size: top-left aligned, edges clamped."""
    out = []
    for y in range(to_h):
        for x in range(to_w):
            sx, sy = x * width / to_w, y * height / to_h
            x0, y0 = int(sx), int(sy)
            x1, y1 = min(x0 + 1, width - 1), min(y0 + 1, height - 1)
            fx, fy = sx - x0, sy - y0
            p = lambda yy, xx: F.get(pixels, yy * width + xx)
            top, low = p(y0, x0) * (1 - fx) + p(y0, x1) * fx, p(y1, x0) * (1 - fx) + p(y1, x1) * fx
            out.append(F.floor(top * (1 - fy) + low * fy + 0.5).cast("int"))
    return F.array(*out)
