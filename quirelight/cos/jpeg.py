"""A JPEG codec, baseline and progressive, and a lossless rewrite with the best Huffman tables.

The entropy code is read symbol by symbol, through tables of 16 bits, and written from arrays
of a scan's symbols; coefficients are what both ends share. Arithmetic and 12-bit files are left to others: ValueError.
"""

from __future__ import annotations

import heapq
import struct
from copy import copy
from functools import lru_cache

import numpy as np

from ..functions.images import LUMINANCE
from .filters import filters_of
from .images import zigzag

_ZIG = zigzag()


def _basis() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None]
    m = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


_DCT = _basis()


class Component:
    def __init__(self, cid: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table = cid, h, v, table
        self.blocks = np.zeros((0, 0, 64), np.int32)  # by row and column, in zigzag order


class Image:
    def __init__(self, width: int, height: int, comps: list[Component], tables: dict[int, np.ndarray], markers: list[bytes], restart: int = 0):
        self.width, self.height, self.comps, self.tables, self.markers, self.restart = width, height, comps, tables, markers, restart
        self.hmax, self.vmax = max(c.h for c in comps), max(c.v for c in comps)
        self.cols, self.rows = -(-width // (8 * self.hmax)), -(-height // (8 * self.vmax))
        for c in comps:
            c.blocks = np.zeros((self.rows * c.v, self.cols * c.h, 64), np.int32)

    def units(self, chosen: list[int]):
        """The blocks of each unit of a scan: lists of (component number, row, column)."""
        if len(chosen) == 1:
            c = self.comps[chosen[0]]
            high, wide = -(-self.height * c.v // (8 * self.vmax)), -(-self.width * c.h // (8 * self.hmax))
            yield from ([(chosen[0], y, x)] for y in range(high) for x in range(wide))
            return
        for my in range(self.rows):
            for mx in range(self.cols):
                yield [(i, my * self.comps[i].v + v, mx * self.comps[i].h + h) for i in chosen for v in range(self.comps[i].v) for h in range(self.comps[i].h)]

    def pixels(self) -> bytes:
        """Interleaved samples of the components as stored; colour is not converted."""
        planes = []
        for c in self.comps:
            table = self.tables[c.table].astype(float)
            natural = np.zeros(c.blocks.shape)
            natural[:, :, _ZIG] = c.blocks * table
            b = _DCT.T @ natural.reshape(*c.blocks.shape[:2], 8, 8) @ _DCT
            plane = b.transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * 8, -1) + 128
            plane = np.repeat(np.repeat(plane, self.vmax // c.v, 0), self.hmax // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        return np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8).tobytes()


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code += 1
            at += 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits, length << 8 | symbol of the code that they begin with; 0 if none."""
    codes = sorted(_codes(counts, symbols).items(), key=lambda x: x[0][1] << (16 - x[0][0]))
    found: list[int] = []
    for (length, _), s in codes:
        found += [length << 8 | s] * (1 << (16 - length))
    if len(found) > 1 << 16:
        raise ValueError("too many codes")
    return found + [0] * ((1 << 16) - len(found))


class _Bits:
    """Bits of a run of the scan. What lies beyond its end reads as zeros; ``check`` tells."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def _more(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = self.held << 48 | int.from_bytes(part.ljust(6, b"\0"), "big")
        self.count += 48

    def bits(self, n: int) -> int:
        if self.count < n:
            self._more()
        self.count -= n
        v = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return v

    def symbol(self, table: list[int]) -> int:
        if self.count < 16:
            self._more()
        found = table[self.held >> (self.count - 16)]
        if not found:
            raise ValueError("not a code")
        self.count -= found >> 8
        self.held &= (1 << self.count) - 1
        return found & 255

    def value(self, size: int) -> int:
        v = self.bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def check(self) -> None:
        if 8 * self.at - self.count > 8 * len(self.data):
            raise ValueError("the scan ends early")


def _sequential(bits: _Bits, block: list[int], ac: list[int], first: int, last: int, shift: int, run: int) -> int:
    """AC coefficients first to last of a block; blocks that end here, this one left out."""
    if run:
        return run - 1
    k = first
    while k <= last:
        s = bits.symbol(ac)
        zeros, size = s >> 4, s & 15
        if not size:
            if zeros < 15:
                return (1 << zeros) - 1 + bits.bits(zeros)
            k += 16
            continue
        k += zeros
        if k > last:
            raise ValueError("a block is too long")
        block[k] = bits.value(size) << shift
        k += 1
    return 0


def _refined(bits: _Bits, block: list[int], ac: list[int], first: int, last: int, shift: int, run: int) -> int:
    """One more bit of coefficients that are there, and new ones of that size."""
    k, one = first, 1 << shift

    def pass_over(zeros: int) -> int:
        """The place of the zero coefficient after so many; those between are refined."""
        nonlocal k
        while k <= last:
            v = block[k]
            if v:
                if bits.bits(1) and not abs(v) & one:
                    block[k] = v + one if v > 0 else v - one
            elif zeros:
                zeros -= 1
            else:
                break
            k += 1
        return k

    while not run and k <= last:
        s = bits.symbol(ac)
        zeros, new = s >> 4, 0
        if s & 15:
            new = one if bits.bits(1) else -one
        elif zeros < 15:
            run = (1 << zeros) + bits.bits(zeros)
            break
        at = pass_over(zeros)
        if new:
            if at > last:
                raise ValueError("a block is too long")
            block[at] = new
        k += 1
    if run:
        pass_over(64)
        run -= 1
    return run


def _runs(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The parts of a scan between restart markers, and where the next marker is."""
    out, low = [], at
    while True:
        stop = data.find(b"\xff", low)
        while stop >= 0 and data[stop + 1 : stop + 2] == b"\0":
            stop = data.find(b"\xff", stop + 2)
        if stop < 0 or stop + 1 >= len(data):
            raise ValueError("the scan ends early")
        out.append(data[at:stop].replace(b"\xff\0", b"\xff"))
        if not 0xD0 <= data[stop + 1] <= 0xD7:
            return out, stop
        at = low = stop + 2


def _scan(image: Image, body: bytes, runs: list[bytes], huffman: dict, blocks: list[list[list[list[int]]]], progressive: bool) -> None:
    n, known = body[0], [c.id for c in image.comps]
    chosen = [known.index(body[1 + 2 * i]) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if not progressive:
        first, last, high, low = 0, 63, 0, 0
    if not n or first > last or last > 63 or first and n > 1:
        raise ValueError("unsupported scan")
    with_dc, with_ac = first == 0, last > 0
    dc = {i: huffman[body[2 + 2 * k] >> 4] for k, i in enumerate(chosen)} if with_dc and not high else {}
    ac = {i: huffman[16 | body[2 + 2 * k] & 15] for k, i in enumerate(chosen)} if with_ac else {}
    more = _refined if high else _sequential
    bits, before, at, ended = _Bits(runs[0]), [0] * len(known), 0, 0
    for u, unit in enumerate(image.units(chosen)):
        if image.restart and u and u % image.restart == 0:
            at += 1
            if at >= len(runs):
                raise ValueError("a restart marker is missing")
            bits.check()
            bits, before, ended = _Bits(runs[at]), [0] * len(known), 0
        for i, y, x in unit:
            block = blocks[i][y][x]
            if with_dc and high:
                block[0] |= bits.bits(1) << low
            elif with_dc:
                before[i] += bits.value(bits.symbol(dc[i]))
                block[0] = before[i] << low
            if with_ac:
                ended = more(bits, block, ac[i], max(1, first), last, low, ended)
        if u % 64 == 0:
            bits.check()
    bits.check()


def read(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, tables, huffman, markers, image, restart, blocks = 2, {}, {}, [], None, 0, []
    progressive, scans = False, 0
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at : at + 2] == b"\xff\xd9" and scans:
            break
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            low = 0
            while low < len(body):
                wide = body[low] >> 4
                values = struct.unpack_from(">64H" if wide else "64B", body, low + 1)
                tables[body[low] & 15] = np.array(values)
                low += 129 if wide else 65
        elif mark == 0xC4:
            low = 0
            while low < len(body):
                n = sum(body[low + 1 : low + 17])
                huffman[body[low]] = _lookup(body[low + 1 : low + 17], body[low + 17 : low + 17 + n])
                low += 17 + n
        elif mark in (0xC0, 0xC1, 0xC2):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if image or bits != 8 or not width or not height or not 1 <= n <= 4:
                raise ValueError("unsupported frame")
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if any(not (1 <= c.h <= 4 and 1 <= c.v <= 4) for c in comps) or sum(c.h * c.v for c in comps) > 10 and n > 1:
                raise ValueError("unsupported frame")
            image, progressive = Image(width, height, comps, tables, markers), mark == 0xC2
            if any(image.hmax % c.h or image.vmax % c.v for c in comps):
                raise ValueError("unsupported frame")
            blocks = [[[[0] * 64 for _ in range(c.blocks.shape[1])] for _ in range(c.blocks.shape[0])] for c in comps]
        elif 0xC3 <= mark <= 0xCF:
            raise ValueError("only Huffman-coded 8-bit files are supported")
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            if image is None:
                raise ValueError("a scan without a frame")
            runs, at = _runs(data, at)
            image.restart = restart
            _scan(image, body, runs, huffman, blocks, progressive)
            scans += 1
        elif 0xE0 <= mark <= 0xEF:
            markers.append(b"\xff" + bytes([mark]) + struct.pack(">H", size) + body)
    if any(c.table not in tables for c in image.comps):
        raise ValueError("a table is missing")
    for c, found in zip(image.comps, blocks):
        c.blocks = np.array(found, np.int32)
    return image


def _best_lengths(counts: dict[int, int]) -> tuple[bytes, bytes]:
    """(codes of each length, symbols): Huffman, of at most 16 bits, none all ones."""
    heap = [(n, s, [s]) for s, n in sorted(counts.items())] + [(0, 256, [256])]  # 256 takes the code of all ones
    heapq.heapify(heap)
    depth = dict.fromkeys([s for _, _, (s,) in heap], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    of = [0] * 300
    for d in depth.values():
        of[d] += 1
    for i in range(299, 16, -1):  # move pairs of too long codes up
        while of[i]:
            j = i - 2
            while not of[j]:
                j -= 1
            of[i] -= 2
            of[i - 1] += 1
            of[j + 1] += 2
            of[j] -= 1
    last = max(i for i in range(17) if of[i])
    of[last] -= 1
    symbols = sorted((s for s in depth if s < 256), key=lambda s: (depth[s], s))
    return bytes(of[1:17]), bytes(symbols)


def _sizes(v: np.ndarray) -> np.ndarray:
    """The number of bits of each magnitude."""
    return np.frexp(np.abs(v).astype(float))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << size) - 1)


def _ends(with_ac: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a progressive scan: the blocks after which a run of ended blocks is said, and the runs' lengths."""
    at = np.flatnonzero(ended)
    if not len(at):
        return at, at
    fresh = with_ac[at] | ~np.r_[False, ended[:-1]][at]  # a block with coefficients, or after one without an end, begins a run
    begin = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    last = np.r_[fresh[1:], True] | (place % 0x7FFF == 0x7FFE)
    return at[last], place[last] % 0x7FFF + 1


def _symbols(image: Image, chosen: list[int], first: int, last: int, progressive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table << 8 | symbol, extra bits, their number) of a scan. Tables are 0 and 1 for DC, 16 and
    17 for AC; the second ones are those of the components after the first."""
    units = np.array([b for u in image.units(chosen) for b in u], np.int64).reshape(-1, 3)
    of, v = units[:, 0], np.zeros((len(units), 64), np.int64)
    parts = []  # (place in the scan, table and symbol, extra bits, their number)
    for i in chosen:
        here = of == i
        v[here] = image.comps[i].blocks[units[here, 1], units[here, 2]]
        if not first:
            at = np.flatnonzero(here)
            diff = np.diff(v[at, 0], prepend=0)
            size = _sizes(diff)
            parts.append((at << 10, (256 if i else 0) | size, _extra(diff, size), size))
    low = max(1, first)
    if low <= last:
        table = (16 | (of > 0)) << 8
        row, k = np.nonzero(v[:, low : last + 1])
        k = k + low
        before = np.where(np.r_[False, row[1:] == row[:-1]], np.r_[0, k[:-1]], low - 1)
        gap, x = k - before - 1, v[row, k]
        size = _sizes(x)
        parts.append((row << 10 | k << 3 | 7, table[row] | (gap & 15) << 4 | size, _extra(x, size), size))
        for step in range(3):  # sixteen zeros each
            far = np.flatnonzero(gap >> 4 > step)
            parts.append((row[far] << 10 | k[far] << 3 | step, table[row[far]] | 0xF0, np.zeros(len(far), np.int64), np.zeros(len(far), np.int64)))
        if len(size) and size.max() > 15:
            raise ValueError("a coefficient is too large")
        final = np.zeros(len(v), np.int64)
        final[row] = k  # the last one counts
        at, run = _ends(final > 0, final < last) if progressive else (np.flatnonzero(final < last), np.array(1))
        size = np.broadcast_to(_sizes(run) - 1, at.shape)
        parts.append((at << 10 | 1023, table[at] | size << 4, np.broadcast_to(run, at.shape) - (1 << size), size))
    place, symbol, extra, size = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(place, kind="stable")
    return symbol[order], extra[order], size[order]


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Values of so many bits each, one after the other, filled up with ones."""
    bits = []
    for at in range(0, len(size), 1 << 16):
        n = size[at : at + (1 << 16)]
        ends = np.cumsum(n)
        left = np.repeat(ends, n) - np.arange(ends[-1]) - 1
        bits.append((np.repeat(value[at : at + (1 << 16)], n) >> left & 1).astype(np.uint8))
    whole = sum(map(len, bits))
    return np.packbits(np.concatenate([*bits, np.ones(-whole % 8, np.uint8)])).tobytes()


def write(image: Image, progressive: bool = False) -> bytes:
    """A file with Huffman tables made for its coefficients, without restarts: one scan, or
    (progressive) all DC coefficients and then each component's low and high frequencies."""
    whole = list(range(len(image.comps)))
    out = [b"\xff\xd8", *image.markers]
    for i, t in sorted(image.tables.items()):
        wide = t.max() > 255
        out.append(b"\xff\xdb" + struct.pack(">HB", 131 if wide else 67, wide << 4 | i) + struct.pack(">64H" if wide else "64B", *t.tolist()))
    frame = struct.pack(">BHHB", 8, image.height, image.width, len(image.comps)) + b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in image.comps)
    out.append(b"\xff" + (b"\xc2" if progressive else b"\xc0") + struct.pack(">H", len(frame) + 2) + frame)
    scans = [(whole, 0, 0), *(([i], a, b) for a, b in ((1, 5), (6, 63)) for i in whole)] if progressive else [(whole, 0, 63)]
    for chosen, first, last in scans:
        symbols, extra, size = _symbols(image, chosen, first, last, progressive)
        counts: dict[int, dict[int, int]] = {}
        for x, n in zip(*(c.tolist() for c in np.unique(symbols, return_counts=True))):
            counts.setdefault(x >> 8, {})[x & 255] = n
        tables = {t: _best_lengths(c) for t, c in counts.items()}
        code, length = np.zeros(18 << 8, np.int64), np.zeros(18 << 8, np.int64)
        for t, (n, sym) in tables.items():
            for (bits, c), x in _codes(n, sym).items():
                code[t << 8 | x], length[t << 8 | x] = c, bits
        scan = _packed(code[symbols] << size | extra, length[symbols] + size).replace(b"\xff", b"\xff\0")
        for t, (n, sym) in sorted(tables.items()):
            out.append(b"\xff\xc4" + struct.pack(">HB", 19 + len(sym), t) + n + sym)
        head = bytes([len(chosen)]) + b"".join(bytes([image.comps[i].id, 17 if i else 0]) for i in chosen) + bytes([first, last, 0])
        out.append(b"\xff\xda" + struct.pack(">H", len(head) + 2) + head + scan)
    return b"".join(out) + b"\xff\xd9"


def smallest(image: Image) -> bytes:
    """The shorter of the two ways to write it."""
    return min(write(image), write(image, True), key=len)


def lossless(data: bytes, image: Image | None = None) -> bytes:
    """The same coefficients with the best Huffman tables; application markers but the
    colour ones (JFIF, Adobe) go. ``image``: what reading the data gave, where that is known."""
    image = copy(image or read(data))
    image.markers = [m for m in image.markers if m[1] in (0xE0, 0xEE)]
    return smallest(image)


def of(s) -> Image:
    """The image of a JPEG stream; kept with the stream while its bytes stay."""
    if not s.image or s.image[0] is not s.raw:
        s.image = s.raw, read(s.raw), False
    return s.image[1]


def quality_table(quality: int) -> np.ndarray:
    """The standard's luminance table at a quality, row by row."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(LUMINANCE) * scale + 50) // 100, 1, 255)


def encode(pixels: bytes, width: int, height: int, comps: int, quality: int) -> bytes:
    """Gray or RGB pixels as a JPEG file; colour as YCbCr, all planes with one table."""
    return smallest(coefficients(pixels, width, height, comps, quality))


def coefficients(pixels: bytes, width: int, height: int, comps: int, quality: int) -> Image:
    p = np.frombuffer(pixels, np.uint8).reshape(height, width, comps).astype(float)
    if comps == 3:
        r, g, b = p[:, :, 0], p[:, :, 1], p[:, :, 2]
        p = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], 2)
    elif comps != 1:
        raise ValueError("gray or RGB only")
    p = np.pad(p, ((0, -height % 8), (0, -width % 8), (0, 0)), "edge") - 128
    table = quality_table(quality)[_ZIG]
    jfif = b"\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0"
    image = Image(width, height, [Component(i + 1, 1, 1, 0) for i in range(comps)], {0: table}, [jfif])
    for i, c in enumerate(image.comps):
        b = p[:, :, i].reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        c.blocks = np.rint((_DCT @ b @ _DCT.T).reshape(*b.shape[:2], 64)[:, :, _ZIG] / table).astype(np.int32)
    return image


def to_rgb(pixels: bytes) -> bytes:
    """YCbCr samples, three to a pixel, as RGB."""
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 3).astype(float)
    y, cb, cr = p[:, 0], p[:, 1] - 128, p[:, 2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8).tobytes()


def samples(doc, s) -> bytes | None:
    """Decoded samples of an image, JPEG colour as RGB; None if its codec is not read."""
    data = doc.data(s)
    if data is None and filters_of(s.dict) == ["/DCTDecode"]:
        try:
            image = of(s)
            data = image.pixels()
            if len(image.comps) == 3:
                data = to_rgb(data)
        except (ValueError, KeyError, IndexError, struct.error):
            return None
    return data
