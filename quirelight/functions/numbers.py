"""Numbers as PDF content writes them, and affine matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def trim_number(s: Column) -> Column:
    """The shortest spelling: no zeros at the end, no bare dot, no zero before the dot."""
    cut = F.regexp_replace(F.regexp_replace(s, "0+$", ""), "[.]$", "")
    return F.when(F.instr(s, ".") == 0, s).when(cut.isin("", "-"), F.lit("0")).otherwise(F.regexp_replace(cut, r"^(-?)0[.]", r"$1."))


def parse_number(s: Column) -> Column:
    """The number that a string begins with; 0 if none."""
    found = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.when(found != "", found).try_cast("double"), F.lit(0.0))


def matrix(a, b, c, d, e, f) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[as_column(v).cast("double") for v in (a, b, c, d, e, f)])


def multiply(m: Column, n: Column) -> Column:
    """m then n, for row vectors."""
    x, y = (lambda i: F.get(m, i)), (lambda i: F.get(n, i))
    return F.array(
        x(0) * y(0) + x(1) * y(2), x(0) * y(1) + x(1) * y(3), x(2) * y(0) + x(3) * y(2), x(2) * y(1) + x(3) * y(3),
        x(4) * y(0) + x(5) * y(2) + y(4), x(4) * y(1) + x(5) * y(3) + y(5),
    )


_USE = "array<struct<name:string,w:double,h:double>>"


def fold_matrix(ops: Column) -> Column:
    """ops: array of (op, name, m) in order -> uses of objects, each with the size it is
    drawn at. q saves the matrix, Q restores it if one is saved, cm applies m, Do draws name."""
    start = F.struct(F.array(*[F.lit(v) for v in IDENTITY]).alias("ctm"), F.array().cast("array<array<double>>").alias("saved"), F.array().cast(_USE).alias("uses"))

    def step(acc: Column, op: Column) -> Column:
        ctm, saved, uses = acc["ctm"], acc["saved"], acc["uses"]
        back = (op["op"] == "Q") & (F.size(saved) > 0)
        at = lambda i: F.get(ctm, i)
        drawn = F.struct(op["name"].alias("name"), F.sqrt(at(0) * at(0) + at(2) * at(2)).alias("w"), F.sqrt(at(1) * at(1) + at(3) * at(3)).alias("h"))
        return F.struct(
            F.when(op["op"] == "cm", multiply(op["m"], ctm)).when(back, F.element_at(saved, -1)).otherwise(ctm).alias("ctm"),
            F.when(op["op"] == "q", F.array_append(saved, ctm)).when(back, F.slice(saved, 1, F.greatest(F.size(saved) - 1, F.lit(0)))).otherwise(saved).alias("saved"),
            F.when(op["op"] == "Do", F.array_append(uses, drawn)).otherwise(uses).alias("uses"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["uses"])


def largest_use(uses: Column) -> Column:
    """name -> (w, h) of the use with the largest area, the first on ties."""
    names = F.array_distinct(F.transform(uses, lambda u: u["name"]))

    def best(name: Column) -> Column:
        mine = F.filter(uses, lambda u: u["name"] == name)
        top = F.array_max(F.transform(mine, lambda u: u["w"] * u["h"]))
        return F.get(F.filter(mine, lambda u: u["w"] * u["h"] == top), 0)

    return F.transform(names, best)


def widget_matrix(box: tuple[Column, ...], rect: tuple[Column, ...], m: tuple[Column, ...] | None = None) -> list[Column]:
    """The matrix that maps an appearance's box (x0, y0, x1, y1) onto a widget's rect (its
    corners in any order): the inverse of its own matrix, then scale and shift. Null where
    a side has no length; a matrix that can't be inverted counts as none."""
    rect = (F.least(rect[0], rect[2]), F.least(rect[1], rect[3]), F.greatest(rect[0], rect[2]), F.greatest(rect[1], rect[3]))
    bw, bh, rw, rh = box[2] - box[0], box[3] - box[1], rect[2] - rect[0], rect[3] - rect[1]
    sx, sy = rw / F.nullif(bw, F.lit(0.0)), rh / F.nullif(bh, F.lit(0.0))
    some = (F.abs(bw) >= 1e-10) & (F.abs(bh) >= 1e-10) & (rw > 0) & (rh > 0)
    plain = [sx, F.lit(0.0), F.lit(0.0), sy, rect[0] - box[0] * sx, rect[1] - box[1] * sy]
    if m is None:
        return [F.when(some, v) for v in plain]
    a, b, c, d, e, f = m
    det = a * d - b * c
    solid = F.abs(det) >= 1e-10
    by = F.when(solid, det)
    inverse = [d / by, -b / by, -c / by, a / by, (c * f - d * e) / by, (b * e - a * f) / by]
    full = multiply(F.array(*inverse), F.array(*plain))
    return [F.when(some, F.when(solid, F.get(full, i)).otherwise(plain[i])) for i in range(6)]
