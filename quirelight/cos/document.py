"""A PDF document as objects: reading with recovery, walking, writing."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from .filters import decode
from .objects import Name, Operator, PdfError, Ref, Stream, number, parse, skip, unparse

_OBJ = re.compile(rb"(?<!\d)(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![a-zA-Z])")
_STREAM = re.compile(rb"stream(\r\n|\n|\r)?")
_ENDSTREAM = re.compile(rb"\s*endstream")
_START = re.compile(rb"startxref\s+(\d+)")
_ENTRY = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
_SECTION = re.compile(rb"\s*(\d{1,10})\s+(\d{1,8})(?=\s)")


class Document:
    """objects: (num, gen) -> value; trailer; status: ``ok``, ``repaired``, ``encrypted``."""

    def __init__(self):
        self.objects: dict[Ref, object] = {}
        self.trailer: dict = {}
        self.status = "ok"

    # -- reading

    @classmethod
    def read(cls, data: bytes) -> Document:
        """Raises PdfError if nothing is there that could be a document."""
        doc = cls()
        start = data.find(b"%PDF-", 0, 1024)
        data = data[start:] if start > 0 else data
        try:
            doc._by_index(data)
            ok = isinstance(doc.get(doc.trailer.get("/Root")), dict) and bool(doc.pages())
        except (PdfError, RecursionError, ValueError, KeyError, IndexError, TypeError, zlib.error):
            ok = False
        if not ok:
            doc.objects, doc.trailer, doc.status = {}, {}, "repaired"
            doc._by_scan(data)
        if "/Encrypt" in doc.trailer:
            doc.status = "encrypted"
        elif not isinstance(doc.get(doc.trailer.get("/Root")), dict):
            raise PdfError("not a PDF document")
        return doc

    def _object_at(self, data: bytes, at: int, lengths: dict | None = None):
        """The value whose ``N G obj`` begins at ``at``."""
        m = _OBJ.match(data, at)
        if not m:
            raise PdfError("no object here")
        value, end = parse(data, m.end())
        if isinstance(value, Operator):
            value = None
        if isinstance(value, dict):
            s = _STREAM.match(data, skip(data, end))
            if s:
                low, size = s.end(), value.get("/Length")
                if isinstance(size, Ref) and lengths is not None and size in lengths:
                    try:
                        size = parse(data, _OBJ.match(data, lengths[size]).end())[0]
                    except (AttributeError, PdfError):
                        size = None
                if not (isinstance(size, int) and 0 <= size <= len(data) - low and _ENDSTREAM.match(data, low + size)):
                    stop = data.find(b"endstream", low)
                    stop = len(data) if stop < 0 else stop
                    size = stop - low - (2 if data[stop - 2 : stop] == b"\r\n" else 1 if data[stop - 1 : stop] in (b"\n", b"\r") else 0)
                value = Stream(value, data[low : low + max(0, size)])
        return value

    def _by_index(self, data: bytes) -> None:
        at = data.rfind(b"startxref")
        m = _START.match(data, at) if at >= 0 else None
        if not m:
            raise PdfError("no startxref")
        offsets: dict[Ref, int] = {}
        packed: dict[int, tuple[int, int]] = {}
        taken: set[int] = set()
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(data):
                if not seen:
                    raise PdfError("startxref points nowhere")
                continue
            seen.add(at)
            at = skip(data, at)
            if data[at : at + 4] == b"xref":
                at += 4
                while s := _SECTION.match(data, at):
                    first, at = int(s[1]), s.end()
                    for i in range(int(s[2])):
                        e = _ENTRY.match(data, at)
                        if not e:
                            raise PdfError("broken cross-reference table")
                        at = e.end()
                        if first + i not in taken:
                            taken.add(first + i)
                            if e[3] == b"n":
                                offsets[Ref(first + i, int(e[2]))] = int(e[1])
                at = skip(data, at)
                if data[at : at + 7] != b"trailer":
                    raise PdfError("no trailer")
                trailer, _ = parse(data, at + 7)
            else:
                s = self._object_at(data, at)
                if not isinstance(s, Stream):
                    raise PdfError("no cross-reference stream")
                trailer = s.dict
                widths = trailer["/W"]
                rows, _ = decode(trailer, s.raw)
                index = trailer.get("/Index") or [0, trailer["/Size"]]
                nums = (n for a, k in zip(index[::2], index[1::2]) for n in range(a, a + k))
                width = sum(widths)
                for n, low in zip(nums, range(0, len(rows) - width + 1, width)):
                    cells = []
                    for w in widths:
                        cells.append(int.from_bytes(rows[low : low + w], "big") if w else None)
                        low += w
                    kind = 1 if cells[0] is None else cells[0]
                    if n not in taken:
                        taken.add(n)
                        if kind == 1:
                            offsets[Ref(n, cells[2] or 0)] = cells[1]
                        elif kind == 2:
                            packed[n] = (cells[1], cells[2] or 0)
            if not isinstance(trailer, dict):
                raise PdfError("broken trailer")
            self.trailer = trailer | self.trailer
            todo += [x for k in ("/XRefStm", "/Prev") if isinstance(x := trailer.get(k), int)]
        for ref, at in offsets.items():
            m = _OBJ.match(data, skip(data, at)) if at < len(data) else None
            if not m or (int(m[1]), int(m[2])) != ref:
                raise PdfError("the cross-reference table is wrong")
            self.objects[ref] = self._object_at(data, m.start(), offsets)
        for holder in dict.fromkeys(h for h, _ in packed.values()):
            for num, value in self._unpacked(self.objects.get(Ref(holder, 0))):
                if packed.get(num, (None,))[0] == holder:
                    self.objects[Ref(num, 0)] = value
        self._tidy()

    @staticmethod
    def _unpacked(s) -> Iterator[tuple[int, object]]:
        if not isinstance(s, Stream) or s.dict.get("/Type") != "/ObjStm":
            return
        data, left = decode(s.dict, s.raw)
        n, first = s.dict.get("/N"), s.dict.get("/First")
        if left or not isinstance(n, int) or not isinstance(first, int):
            return
        head = data[:first].split()
        for num, at in zip(head[: 2 * n : 2], head[1 : 2 * n : 2]):
            value, _ = parse(data, first + int(at))
            yield int(num), None if isinstance(value, Operator) else value

    def _by_scan(self, data: bytes) -> None:
        """The last definition of each object, and the last trailer that names a root."""
        found = {Ref(int(m[1]), int(m[2])): m.start() for m in _OBJ.finditer(data)}
        for ref, at in found.items():
            try:
                self.objects[ref] = self._object_at(data, at, found)
            except (PdfError, RecursionError):
                continue
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.dict.get("/Type") == "/ObjStm":
                try:
                    for num, inner in self._unpacked(value):
                        self.objects.setdefault(Ref(num, 0), inner)
                except (PdfError, ValueError):
                    continue
        trailers = [s.dict for s in self.objects.values() if isinstance(s, Stream) and s.dict.get("/Type") == "/XRef"]
        for m in re.finditer(rb"trailer", data):
            try:
                t, _ = parse(data, m.end())
            except PdfError:
                continue
            if isinstance(t, dict):
                trailers.append(t)
        for t in trailers:
            if isinstance(self.get(t.get("/Root")), dict):
                self.trailer = self.trailer | t
        if "/Root" not in self.trailer:
            for ref, x in self.objects.items():
                if isinstance(x, dict) and x.get("/Type") == "/Catalog":
                    self.trailer = self.trailer | {Name("/Root"): ref}
        self._tidy()

    def _tidy(self) -> None:
        for k in ("/Prev", "/XRefStm", "/W", "/Index", "/Filter", "/DecodeParms", "/Length", "/Type", "/Size"):
            self.trailer.pop(k, None)
        for ref in [r for r, x in self.objects.items() if isinstance(x, Stream) and x.dict.get("/Type") in ("/XRef", "/ObjStm")]:
            del self.objects[ref]

    # -- walking

    def get(self, x):
        """The value behind a reference, or the value itself."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x)
        return None

    def dict_of(self, x) -> dict:
        x = self.get(x)
        return x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    def root(self) -> dict:
        return self.dict_of(self.trailer.get("/Root"))

    def pages(self) -> list[tuple[Ref | None, dict]]:
        """Pages in order, each with what it inherits."""
        out, seen = [], set()
        todo = [(self.root().get("/Pages"), {})]
        while todo:
            ref, given = todo.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            given = given | {k: node[k] for k in INHERITED if k in node}
            if isinstance(kids := self.get(node.get("/Kids")), list):
                todo += [(k, given) for k in reversed(kids)]
            else:
                out.append((ref if isinstance(ref, Ref) else None, node, given))
        return [(r, given | node) for r, node, given in out]

    def push_inherited(self) -> None:
        """Inherited attributes move to the pages, and the page tree becomes flat."""
        pages = self.pages()
        top = self.root().get("/Pages")
        node = self.get(top)
        if not isinstance(node, dict) or not isinstance(top, Ref) or any(r is None for r, _ in pages):
            return
        for ref, page in pages:
            self.objects[ref] = page | {Name("/Parent"): top}
        kept = {k: v for k, v in node.items() if k not in INHERITED}
        self.objects[top] = kept | {Name("/Kids"): [r for r, _ in pages], Name("/Count"): len(pages)}

    def contents(self, page: dict) -> bytes:
        """A page's content: its streams joined by newlines; what can't be decoded is left out."""
        x = self.get(page.get("/Contents"))
        parts = []
        for s in x if isinstance(x, list) else [x]:
            s = self.get(s)
            if isinstance(s, Stream):
                parts.append(self.data(s) or b"")
        return b"\n".join(parts)

    def data(self, s: Stream) -> bytes | None:
        """Decoded data, or None if an image codec or damage is in the way."""
        d = {k: self.get(v) for k, v in s.dict.items()}
        for k in ("/Filter", "/DecodeParms"):
            if isinstance(d.get(k), list):
                d[k] = [self.get(x) for x in d[k]]
        try:
            data, left = decode(d, s.raw)
        except (PdfError, ValueError, TypeError, zlib.error):
            return None
        return None if left else data

    def reachable(self) -> list[Ref]:
        """References that the trailer reaches, in order of discovery."""
        found: dict[Ref, None] = {}
        todo: list = [self.trailer]
        while todo:
            x = todo.pop()
            if isinstance(x, Ref):
                if x not in found and x in self.objects:
                    found[x] = None
                    todo.append(self.objects[x])
            else:
                todo += [v for v in children(x) if isinstance(v, (Ref, dict, list, Stream))][::-1]
        return list(found)

    # -- writing

    def write(self, seed: bytes = b"") -> bytes:
        """A file with object streams, a cross-reference stream, Flate at its strongest,
        reachable objects only, and an /ID that follows from ``seed``."""
        order = self.reachable()
        number_of = {r: i + 1 for i, r in enumerate(order)}

        def renumbered(x):
            if isinstance(x, Ref):
                return Ref(number_of[x], 0) if x in number_of else None
            if isinstance(x, list):
                return [renumbered(v) for v in x]
            if isinstance(x, dict):
                return {k: r for k, v in x.items() if (r := renumbered(v)) is not None}
            return x

        out, size = [b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"], 15
        rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}

        def put(num: int, body: bytes) -> None:
            nonlocal size
            rows[num] = (1, size, 0)
            whole = b"%d 0 obj\n" % num + body + b"\nendobj\n"
            out.append(whole)
            size += len(whole)

        plain: list[tuple[int, bytes]] = []
        for ref in order:
            x = self.objects[ref]
            if isinstance(x, Stream):
                d, raw = self._squeezed(x)
                d = renumbered(d) | {Name("/Length"): len(raw)}
                put(number_of[ref], unparse(d) + b"\nstream\n" + raw + b"\nendstream")
            else:
                plain.append((number_of[ref], unparse(renumbered(x))))
        free = len(order) + 1
        for at in range(0, len(plain), 100):
            part = plain[at : at + 100]
            head, body = [], b""
            for i, (num, text) in enumerate(part):
                head.append(b"%d %d" % (num, len(body)))
                rows[num] = (2, free, i)
                body += text + b"\n"
            first = b" ".join(head) + b"\n"
            raw = zlib.compress(first + body, 9)
            d = {Name("/Type"): Name("/ObjStm"), Name("/N"): len(part), Name("/First"): len(first), Name("/Filter"): Name("/FlateDecode"), Name("/Length"): len(raw)}
            put(free, unparse(d) + b"\nstream\n" + raw + b"\nendstream")
            free += 1
        at, digest = size, hashlib.md5(seed or b"".join(out), usedforsecurity=False).digest()
        rows[free] = (1, at, 0)
        w = max(2, (size.bit_length() + 7) // 8, (free.bit_length() + 7) // 8)
        table = b"".join(bytes([k]) + a.to_bytes(w, "big") + b.to_bytes(2, "big") for k, a, b in (rows.get(n, (0, 0, 0)) for n in range(free + 1)))
        raw = zlib.compress(table, 9)
        trailer = {k: v for k, v in renumbered(self.trailer).items() if k in ("/Root", "/Info")}
        trailer |= {Name("/Type"): Name("/XRef"), Name("/Size"): free + 1, Name("/W"): [1, w, 2], Name("/ID"): [digest, digest], Name("/Filter"): Name("/FlateDecode"), Name("/Length"): len(raw)}
        out.append(b"%d 0 obj\n" % free + unparse(trailer) + b"\nstream\n" + raw + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at)
        return b"".join(out)

    def _squeezed(self, s: Stream) -> tuple[dict, bytes]:
        """Recompressed with Flate where that is smaller or the stream isn't compressed;
        image codecs stay."""
        data = self.data(s)
        if data is None:
            return s.dict, s.raw
        packed = zlib.compress(data, 9)
        if len(packed) >= len(s.raw) and "/Filter" in s.dict or len(packed) >= len(data):
            if "/Filter" in s.dict and len(s.raw) <= len(data):
                return s.dict, s.raw
            return {k: v for k, v in s.dict.items() if k not in ("/Filter", "/DecodeParms")}, data
        return {k: v for k, v in s.dict.items() if k != "/DecodeParms"} | {Name("/Filter"): Name("/FlateDecode")}, packed


INHERITED = ("/Resources", "/MediaBox", "/CropBox", "/Rotate")


def children(x) -> Iterator:
    if isinstance(x, Stream):
        x = x.dict
    if isinstance(x, dict):
        for k in sorted(x):
            yield x[k]
    elif isinstance(x, list):
        yield from x


def edges(x, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Ref]]:
    """(path, reference) of all references in a value."""
    if isinstance(x, Ref):
        yield path, x
    elif isinstance(x, Stream):
        yield from edges(x.dict, path)
    elif isinstance(x, dict):
        for k in sorted(x):
            yield from edges(x[k], (*path, str(k)))
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from edges(v, (*path, str(i)))


def rect(doc: Document, x) -> list[float] | None:
    x = doc.get(x)
    if isinstance(x, list) and len(x) >= 4:
        v = [number(doc.get(i)) for i in x[:4]]
        if None not in v:
            return v
    return None
