"""PDF values in Python, and their lexer. Every function ends on every input."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

WHITE = b"\x00\t\n\x0c\r "
DEEPEST = 100  # nested arrays and dictionaries


class PdfError(ValueError):
    pass


class Name(str):
    """A name with its slash."""

    __slots__ = ()


class Real(str):
    """A real number as it was written."""

    __slots__ = ()

    def __float__(self) -> float:
        try:
            return float(str(self))
        except ValueError:
            return 0.0


class Operator(str):
    """A bare word, in content or out of place."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream:
    """image: (raw bytes, what they decode to, whether they are as short as it can be written),
    kept for passes that follow."""

    __slots__ = ("dict", "image", "raw")

    def __init__(self, d: dict, raw: bytes):
        self.dict, self.raw, self.image = d, raw, None

    def __eq__(self, other):
        return isinstance(other, Stream) and (self.dict, self.raw) == (other.dict, other.raw)

    __hash__ = None


_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
# what is to be skipped, then a name, a whole number or reference, or another word
_TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(?:/([^W]*+)|(\d++)(?:[\x00\t\n\x0c\r ]++(\d++)[\x00\t\n\x0c\r ]++R(?![^W])|(?![^W]))|([^W]++)|)".replace(b"W", rb"\x00\t\n\x0c\r ()<>\[\]{}/%"))
_READABLE = re.compile(rb"[ -'*-\[\]-~]*")
_SHORT = 64  # names below this length are kept
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
_INT = re.compile(rb"[+-]?\d+\Z")
_REAL = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?\Z|[+-]?\.\Z")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_PLAIN = re.compile(rb"[^()\\\r]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def skip(buf: bytes, at: int) -> int:
    return _SKIP.match(buf, at).end()


def string_end(buf: bytes, at: int) -> int:
    """Where the literal string that begins at ``at`` ends."""
    depth, n = 0, len(buf)
    while at < n:
        c = buf[at]
        if c == 92:
            at += 1
        elif c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return n


def _literal(body: bytes) -> bytes:
    out, at = [], 0
    while at < len(body):
        if m := _PLAIN.match(body, at):
            out.append(m[0])
            at = m.end()
        elif body[at] == 92:
            if m := re.compile(rb"\\([0-7]{1,3})").match(body, at):
                out.append(bytes([int(m[1], 8) & 255]))
                at = m.end()
            elif body[at + 1 : at + 3] == b"\r\n":
                at += 3
            else:
                c = body[at + 1 : at + 2]
                out.append(b"" if c in (b"\n", b"\r") else _ESCAPES.get(c, c))
                at += 2
        elif body[at] == 13:
            out.append(b"\n")
            at += 2 if body[at + 1 : at + 2] == b"\n" else 1
        else:
            out.append(body[at : at + 1])
            at += 1
    return b"".join(out)


def _spelt(raw: bytes) -> Name:
    return Name("/" + (re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw).decode("latin-1"))


_known = lru_cache(1 << 12)(_spelt)


def _unname(raw: bytes) -> Name:
    return _known(raw) if len(raw) < _SHORT else _spelt(raw)


def _word(buf: bytes, m: re.Match, refs: bool):
    """Of a match of _TOKEN that has a group: (value, where it ends)."""
    kind = m.lastindex
    if kind == 1:
        return _unname(m[1]), m.end()
    if kind == 3 and refs:
        return Ref(int(m[2][:12]), int(m[3][:12])), m.end()
    if kind != 4:
        return int(m[2][:18]), m.end(2)
    word, end = m[4], m.end()
    if _INT.match(word):
        if refs and (r := _REF.match(buf, end)):
            return Ref(int(word[:12]), int(r[1][:12])), r.end()
        return int(word[:18]), end
    if _REAL.match(word):
        return Real(word.decode()), end
    return _CONSTANTS[word] if word in _CONSTANTS else Operator(word.decode("latin-1")), end


def _items(buf: bytes, at: int, depth: int, refs: bool, closing: str) -> tuple[list, int]:
    """What an array or a dictionary holds; stray operators are skipped."""
    items = []
    while True:
        m = _TOKEN.match(buf, at)
        kind = m.lastindex
        if kind and depth < DEEPEST:
            if kind < 3:  # most are names and whole numbers
                items.append(_unname(m[1]) if kind == 1 else int(m[2][:18]))
                at = m.end()
                continue
            x, at = _word(buf, m, refs)
        else:
            x, at = parse(buf, m.start(), depth + 1, refs)
        if isinstance(x, Operator):
            if x in (closing, "", "endobj", "stream"):
                return items, at - (len(x) if x in ("endobj", "stream") else 0)
            continue  # not a value
        items.append(x)


def parse(buf: bytes, at: int = 0, depth: int = 0, refs: bool = True):
    """(value, where it ends). At the end of input the value is an empty operator; a stray
    delimiter is an operator of one byte."""
    m = _TOKEN.match(buf, at)
    if m.lastindex and depth <= DEEPEST:
        return _word(buf, m, refs)
    at = m.end() if not m.lastindex else skip(buf, at)
    if at >= len(buf):
        return Operator(""), at
    c = buf[at]
    if depth > DEEPEST:
        raise PdfError("nested too deep")
    if c == 40:
        end = string_end(buf, at)
        return _literal(buf[at + 1 : end - (buf[end - 1 : end] == b")")]), end
    if c == 60 and buf[at + 1 : at + 2] != b"<":
        end = buf.find(b">", at)
        end = len(buf) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", buf[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), min(end + 1, len(buf))
    if c == 91:
        return _items(buf, at + 1, depth, refs, "]")
    if c == 60:
        items, at = _items(buf, at + 2, depth, refs, ">>")
        return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name) and v is not None}, at
    two = buf[at : at + 2] == b">>"
    return Operator(">>" if two else chr(c)), at + 1 + two


def number(x) -> float | None:
    return float(x) if isinstance(x, (int, Real)) and not isinstance(x, bool) else None


def _named(x: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], x[1:].encode("latin-1"))


_known_named = lru_cache(1 << 12)(_named)


def unparse(x) -> bytes:
    """The value in PDF syntax; dictionaries in order of their keys."""
    if type(x) is int:
        return b"%d" % x
    if isinstance(x, Name):
        return _known_named(x) if len(x) < _SHORT else _named(x)
    if isinstance(x, dict):
        return b"<<" + b" ".join([unparse(v) for pair in sorted(x.items()) for v in pair]) + b">>"
    if isinstance(x, list):
        return b"[" + b" ".join([unparse(v) for v in x]) + b"]"
    if isinstance(x, str):
        return x.encode("latin-1")
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        return (f"{x:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(x, bytes):
        return b"(" + x + b")" if _READABLE.fullmatch(x) else b"<" + x.hex().encode() + b">"
    raise TypeError(type(x).__name__)
