"""Content streams: tokens, operators, minifying. Every function ends on every input."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .objects import Name, Operator, Ref, Real, number, parse, skip, string_end

_SPACE = re.compile(rb"[\x00\t\n\x0b\x0c\r ]+")
_COMMENT = re.compile(rb"%[^\r\n]*")
_WORD = re.compile(rb"/?[^\x00\t\n\x0b\x0c\r ()<>\[\]{}/%]*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)")
_START = re.compile(rb"[\x00\t\n\x0c\r ]*(?:[A-Za-z'\"/\[(<%.0-9+-]|\Z)")


def trim_number(t: bytes) -> bytes:
    """The shortest spelling of a number; the same rule as functions.numbers.trim_number."""
    if b"." not in t:
        return t
    t = t.rstrip(b"0").removesuffix(b".")
    if t in (b"", b"-"):
        return b"0"
    return re.sub(rb"^(-?)0\.", rb"\1.", t)


def _image_end(data: bytes, at: int) -> int:
    """Where an inline image's data that begins at ``at`` ends, before its EI."""
    for m in _END.finditer(data, at):
        if _START.match(data, m.end()):
            return m.start() + 1
    return len(data)


def tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, bytes): ``word``, ``name``, ``string``, ``hex``, ``mark`` for delimiters, and
    ``image`` for an inline image's data. Stray bytes are marks."""
    at, n = 0, len(data)
    while at < n:
        if m := _SPACE.match(data, at) or _COMMENT.match(data, at):
            at = m.end()
            continue
        c = data[at]
        if c == 40:
            end = string_end(data, at)
            yield "string", data[at:end]
        elif c == 60 and data[at + 1 : at + 2] == b"<" or c == 62 and data[at + 1 : at + 2] == b">":
            end = at + 2
            yield "mark", data[at:end]
        elif c == 60 and (end := data.find(b">", at) + 1):
            yield "hex", _SPACE.sub(b"", data[at:end])
        elif c in b"<>[]{})":
            end = at + 1
            yield "mark", data[at:end]
        else:
            end = max(at + 1, _WORD.match(data, at).end())
            word = data[at:end]
            yield ("name" if c == 47 else "word"), word
            if word == b"ID":
                end = min(n, end + 1)
                stop = _image_end(data, end)
                yield "image", data[end:stop]
                end = stop
        at = end


def minify(data: bytes) -> bytes:
    """The same tokens with as little space as separates them, or the data if that isn't shorter."""
    out = []
    glued = True  # what follows needs no space
    for kind, t in tokens(data):
        if kind == "image":
            out.append(b" " + t)  # ends with the space before EI
            glued = True
            continue
        if kind == "word" and _NUMBER.match(t):
            t = trim_number(t)
        if not (glued or t in (b">>", b"]") or kind in ("string", "hex")) or out and out[-1].endswith(b"<") and t.startswith(b"<"):
            out.append(b" ")
        out.append(t)
        glued = kind in ("string", "hex") or kind == "mark"
    small = b"".join(out)
    return small if len(small) < len(data) else data


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) in order. Inline images are one operation, BI."""
    at, operands, n = 0, [], len(data)
    while True:
        at = skip(data, at)
        if at >= n:
            return
        before = at
        try:
            x, at = parse(data, at, refs=False)
        except ValueError:
            at = before + 1
            continue
        at = max(at, before + 1)
        if not isinstance(x, Operator):
            operands.append(x)
            continue
        if x == "ID":
            stop = _image_end(data, min(n, at + 1))
            at = min(n, stop + 2)
            yield "BI", operands
        elif x != "BI":
            yield str(x), operands
        operands = []


def _numbers(operands: list, k: int) -> list[float] | None:
    v = [number(x) for x in operands[-k:]]
    return v if len(v) == k and None not in v else None


def drawn_sizes(data: bytes) -> dict[str, tuple[float, float]]:
    """Name -> (width, height) at the largest area that each XObject is drawn with, from
    the norms of the matrix's columns; the first on ties."""
    ctm, saved, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], {}
    for op, operands in operations(data):
        if op == "q":
            saved.append(ctm)
        elif op == "Q" and saved:
            ctm = saved.pop()
        elif op == "cm" and (m := _numbers(operands, 6)):
            a, b, c, d, e, f = m
            x = ctm
            ctm = (a * x[0] + b * x[2], a * x[1] + b * x[3], c * x[0] + d * x[2], c * x[1] + d * x[3], e * x[0] + f * x[2] + x[4], e * x[1] + f * x[3] + x[5])
        elif op == "Do" and operands and isinstance(operands[-1], Name):
            w, h = (ctm[0] ** 2 + ctm[2] ** 2) ** 0.5, (ctm[1] ** 2 + ctm[3] ** 2) ** 0.5
            old = out.get(operands[-1])
            if old is None or w * h > old[0] * old[1]:
                out[operands[-1]] = (w, h)
    return out


_NAMING = {"Do", "gs", "sh", "cs", "CS", "scn", "SCN", "Tf", "BDC", "DP"}


def used_names(data: bytes) -> set[str]:
    """Resource names that content uses, of whatever category."""
    out: set[str] = set()
    for op, operands in operations(data):
        if op == "Tf" and len(operands) >= 2 and isinstance(operands[-2], Name):
            out.add(operands[-2])
        elif op in _NAMING and operands and isinstance(operands[-1], Name):
            out.add(operands[-1])
        elif op == "BI":
            out |= {x for x in operands if isinstance(x, Name)}
    return out


def font_codes(data: bytes, font: str | None = None) -> tuple[dict[str, list[bytes]], str | None]:
    """Strings shown with each font name, and the font that is current at the end."""
    out: dict[str, list[bytes]] = {}
    for op, operands in operations(data):
        if op == "Tf" and len(operands) >= 2 and isinstance(operands[-2], Name):
            font = operands[-2]
        elif op in ("Tj", "TJ", "'", '"') and operands and font is not None:
            x = operands[-1]
            out.setdefault(font, []).extend(s for s in (x if isinstance(x, list) else [x]) if isinstance(s, bytes))
    return out, font


__all__ = ["Ref", "Real", "drawn_sizes", "font_codes", "minify", "operations", "tokens", "trim_number", "used_names"]
