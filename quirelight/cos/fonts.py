"""Font kernels: CMaps, encodings, widths, and subsets of TrueType files."""

from __future__ import annotations

import re
import struct

from ..functions.encodings import glyph_names, macroman, winansi
from .objects import Name, Operator, number, parse

_AGL = glyph_names()


def glyph_unicode(name: str) -> int:
    """Unicode of a glyph name (without slash); 0 if it says nothing."""
    base = name.split(".")[0]
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u(?!n)([0-9A-Fa-f]{4,6})", base):
        value = int(m[1] or m[2], 16)
        if 0 < value <= 0xFFFF:
            return value
    if len(base) == 1 and base >= " ":
        return ord(base)
    return _AGL.get(base, 0)


def _values(data: bytes):
    at = 0
    while at < len(data):
        before = at
        try:
            x, at = parse(data, at, refs=False)
        except ValueError:
            return
        at = max(at, before + 1)
        yield x


def to_unicode(data: bytes, codes: set[int]) -> dict[int, int]:
    """code -> the low 16 bits of its Unicode value, for the codes asked for."""
    out: dict[int, int] = {}
    section, held = None, []
    low = lambda b: int.from_bytes(b[-2:], "big")
    for x in _values(data):
        if isinstance(x, Operator):
            if x in ("beginbfchar", "beginbfrange"):
                section, held = str(x)[5:], []
            elif x in ("endbfchar", "endbfrange"):
                section = None
            continue
        if section is None:
            continue
        held.append(x)
        if section == "bfchar" and len(held) == 2:
            src, dst = held
            held = []
            if isinstance(src, bytes) and isinstance(dst, bytes) and low(src) in codes:
                out[low(src)] = low(dst)
        elif section == "bfrange" and len(held) == 3:
            a, b, dst = held
            held = []
            if not (isinstance(a, bytes) and isinstance(b, bytes)):
                continue
            first, last = low(a), low(b)
            for code in (c for c in codes if first <= c <= last):
                if isinstance(dst, bytes):
                    out[code] = (low(dst) + code - first) & 0xFFFF
                elif isinstance(dst, list) and code - first < len(dst) and isinstance(dst[code - first], bytes):
                    out[code] = low(dst[code - first])
    return out


def differences(array: list) -> dict[int, str]:
    """code -> glyph name without slash. A number sets the counter, a name takes the next."""
    out, at = {}, 0
    for x in array:
        if isinstance(x, Name):
            out[at] = x[1:]
            at += 1
        elif isinstance(x, int):
            at = x
    return out


def base_unicode(code: int, encoding: str | None) -> int:
    if encoding == "/WinAnsiEncoding" and code < 256:
        return winansi(code)
    if encoding == "/MacRomanEncoding" and code < 256:
        return macroman(code)
    return code


def trimmed_widths(widths: list, first: int, used: set[int]) -> tuple[list, int] | None:
    """Widths with those of unused codes zeroed and zeros at the end cut, and the last
    code; None if no width changes."""
    new, changed = [], False
    for i, w in enumerate(widths):
        v = number(w)
        keep = first + i in used or v is None or v == 0
        changed |= not keep
        new.append(w if keep else 0)
    if not changed:
        return None
    while new and number(new[-1]) == 0:
        new.pop()
    return new, first + len(new) - 1


def read_w(w: list) -> dict[int, object]:
    """A CID font's /W as cid -> width."""
    out, at = {}, 0
    while at < len(w):
        first = w[at]
        if not isinstance(first, int) or at + 1 >= len(w):
            break
        if isinstance(w[at + 1], list):
            out.update((first + i, v) for i, v in enumerate(w[at + 1]))
            at += 2
        elif at + 2 < len(w) and isinstance(w[at + 1], int):
            out.update((c, w[at + 2]) for c in range(first, min(w[at + 1], first + 65535) + 1))
            at += 3
        else:
            break
    return out


def write_w(widths: dict[int, object]) -> list:
    """Runs of consecutive cids: first [widths ...]."""
    out: list = []
    last = None
    for cid in sorted(widths):
        if last is None or cid != last + 1:
            out += [cid, []]
        out[-1].append(widths[cid])
        last = cid
    return out


class TrueType:
    """Tables of a TrueType file. Raises ValueError or struct.error on what isn't one."""

    DROPPED = ("GPOS", "GSUB", "GDEF", "DSIG", "kern", "name", "gasp", "hdmx", "LTSH", "VDMX")

    def __init__(self, data: bytes):
        if data[:4] not in (b"\0\1\0\0", b"true"):
            raise ValueError("not TrueType outlines")
        self.tables: dict[str, bytes] = {}
        for i in range(struct.unpack_from(">H", data, 4)[0]):
            tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
            self.tables[tag.decode("latin-1")] = data[at : at + size]
        self.version = data[:4]
        self.glyphs = struct.unpack_from(">H", self.tables["maxp"], 4)[0]
        wide = struct.unpack_from(">h", self.tables["head"], 50)[0]
        form = f">{self.glyphs + 1}{'I' if wide else 'H'}"
        self.loca = [v * (1 if wide else 2) for v in struct.unpack_from(form, self.tables["loca"])]

    def cmap(self) -> dict[int, int]:
        """Character -> glyph through all subtables of formats 0, 4, 6 and 12."""
        t, out = self.tables.get("cmap", b""), {}
        if len(t) < 4:
            return out
        for i in range(struct.unpack_from(">H", t, 2)[0]):
            at = struct.unpack_from(">HHI", t, 4 + 8 * i)[2]
            try:
                for c, g in self._subtable(t, at):
                    if g:
                        out.setdefault(c, g)
            except struct.error:
                continue
        return out

    def names(self) -> dict[str, int]:
        """Name -> glyph of the names that the `post` table spells out (version 2). Its standard
        names are left to ``glyph_unicode`` and the cmap."""
        t = self.tables.get("post", b"")
        if len(t) < 34 or t[:4] != b"\0\2\0\0":
            return {}
        n = struct.unpack_from(">H", t, 32)[0]
        places, at, spelt = struct.unpack_from(f">{n}H", t, 34), 34 + 2 * n, []
        while at < len(t):
            spelt.append(t[at + 1 : at + 1 + t[at]].decode("latin-1"))
            at += 1 + t[at]
        out: dict[str, int] = {}
        for g, k in enumerate(places):
            if 258 <= k < 258 + len(spelt):
                out.setdefault(spelt[k - 258], g)
        return out

    @staticmethod
    def _subtable(t: bytes, at: int):
        form = struct.unpack_from(">H", t, at)[0]
        if form == 0:
            yield from enumerate(t[at + 6 : at + 262])
        elif form == 6:
            first, n = struct.unpack_from(">HH", t, at + 6)
            yield from ((first + i, g) for i, g in enumerate(struct.unpack_from(f">{n}H", t, at + 10)))
        elif form == 12:
            for i in range(struct.unpack_from(">I", t, at + 12)[0]):
                a, b, g = struct.unpack_from(">III", t, at + 16 + 12 * i)
                yield from ((c, g + c - a) for c in range(a, min(b, a + 0xFFFF) + 1))
        elif form == 4:
            n = struct.unpack_from(">H", t, at + 6)[0] // 2
            ends = struct.unpack_from(f">{n}H", t, at + 14)
            starts = struct.unpack_from(f">{n}H", t, at + 16 + 2 * n)
            deltas = struct.unpack_from(f">{n}H", t, at + 16 + 4 * n)
            low = at + 16 + 6 * n
            offsets = struct.unpack_from(f">{n}H", t, low)
            for i in range(n):
                for c in range(starts[i], ends[i] + 1):
                    if c == 0xFFFF:
                        continue
                    if offsets[i] == 0:
                        yield c, (c + deltas[i]) & 0xFFFF
                    else:
                        g = struct.unpack_from(">H", t, low + 2 * i + offsets[i] + 2 * (c - starts[i]))[0]
                        yield c, (g + deltas[i]) & 0xFFFF if g else 0

    def closure(self, gids: set[int]) -> set[int]:
        """With the parts of composite glyphs, and glyph 0."""
        found, todo, glyf = set(), [0, *gids], self.tables["glyf"]
        while todo:
            g = todo.pop()
            if g in found or not 0 <= g < self.glyphs:
                continue
            found.add(g)
            body = glyf[self.loca[g] : self.loca[g + 1]]
            if len(body) >= 10 and struct.unpack_from(">h", body)[0] < 0:
                at, more = 10, True
                while more and at + 4 <= len(body):
                    flags, part = struct.unpack_from(">HH", body, at)
                    todo.append(part)
                    at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 64 else 8 if flags & 128 else 0)
                    more = bool(flags & 32)
        return found

    def subset(self, gids: set[int], keep_cmap: bool) -> bytes:
        """The file with outlines of other glyphs emptied; numbers of glyphs stay."""
        kept, glyf, loca, body = self.closure(gids), self.tables["glyf"], [0], []
        for g in range(self.glyphs):
            part = glyf[self.loca[g] : self.loca[g + 1]] if g in kept else b""
            part += b"\0" * (-len(part) % 4)
            body.append(part)
            loca.append(loca[-1] + len(part))
        tables = {k: v for k, v in self.tables.items() if k not in self.DROPPED and (keep_cmap or k != "cmap")}
        tables["glyf"], tables["loca"] = b"".join(body), struct.pack(f">{len(loca)}I", *loca)
        head = bytearray(tables["head"])
        head[8:12], head[50:52] = bytes(4), b"\0\1"
        tables["head"] = bytes(head)
        n = len(tables)
        power = 1 << (n.bit_length() - 1)
        out = self.version + struct.pack(">HHHH", n, power * 16, power.bit_length() - 1, (n - power) * 16)
        at, entries, data, head_at = 12 + 16 * n, [], [], 0
        for tag in sorted(tables):
            t = tables[tag]
            padded = t + b"\0" * (-len(t) % 4)
            if tag == "head":
                head_at = at
            entries.append(struct.pack(">4sIII", tag.encode("latin-1"), _sum(padded), at, len(t)))
            data.append(padded)
            at += len(padded)
        whole = bytearray(out + b"".join(entries) + b"".join(data))
        struct.pack_into(">I", whole, head_at + 8, (0xB1B0AFBA - _sum(bytes(whole))) & 0xFFFFFFFF)
        return bytes(whole)


def _sum(padded: bytes) -> int:
    return sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF
