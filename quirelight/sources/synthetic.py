"""Small PDF files made from text, for queries and tests."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cos.objects import Name, Ref, Stream, unparse


def plain_file(objects: dict[int, object], trailer: dict) -> bytes:
    """A file with a classic cross-reference table, written as given."""
    out, at = b"%PDF-1.4\n", {}
    for n, x in sorted(objects.items()):
        at[n] = len(out)
        if isinstance(x, Stream):
            body = unparse(x.dict | {Name("/Length"): len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
        else:
            body = unparse(x)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    size = max(objects) + 1
    table = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size))
    return out + b"xref\n0 %d\n" % size + table + b"trailer\n" + unparse(trailer | {Name("/Size"): size}) + b"\nstartxref\n%d\n%%%%EOF\n" % len(out)


def entries(**more) -> dict:
    """A dictionary of PDF: entries(Type=...) is /Type and so on."""
    return {Name(f"/{k}"): v for k, v in more.items()}


def one_page(content: bytes | list[bytes], objects: dict | None = None, page: dict | None = None, root: dict | None = None, trailer: dict | None = None) -> bytes:
    """A file with one page; further objects have numbers from 20 on. A list of contents becomes
    as many streams, with the numbers 4 to 19 at most."""
    parts = content if isinstance(content, list) else [content]
    refs = [Ref(4 + i, 0) for i in range(len(parts))]
    whole = {
        1: entries(Type=Name("/Catalog"), Pages=Ref(2, 0)) | (root or {}),
        2: entries(Type=Name("/Pages"), Kids=[Ref(3, 0)], Count=1),
        3: entries(Type=Name("/Page"), Parent=Ref(2, 0), MediaBox=[0, 0, 612, 792], Contents=refs if isinstance(content, list) else refs[0]) | (page or {}),
    }
    whole |= {r.num: Stream({}, x) for r, x in zip(refs, parts)}
    return plain_file(whole | (objects or {}), entries(Root=Ref(1, 0)) | (trailer or {}))


def image(width: int, height: int, space, raw: bytes, bits: int = 8, **more) -> Stream:
    return Stream(entries(Type=Name("/XObject"), Subtype=Name("/Image"), Width=width, Height=height, ColorSpace=space, BitsPerComponent=bits, **more), raw)


def true_type(first: int, last: int, names: dict[int, str] | None = None) -> bytes:
    """A TrueType file in which glyph 1 + k is that of the character first + k, of 20 bytes each;
    names spells the names of some glyphs."""
    n, spelt = last - first + 1, sorted((names or {}).items())
    place = {g: 258 + i for i, (g, _) in enumerate(spelt)}
    post = b"\0\2\0\0" + bytes(28) + struct.pack(f">H{n + 1}H", n + 1, *(place.get(g, 0) for g in range(n + 1))) + b"".join(bytes([len(x)]) + x.encode() for _, x in spelt)
    outline = lambda k: struct.pack(">hhhhh", 1, 0, 0, 9, 9) + bytes([k % 256]) * 10
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHH", 6, 10 + 2 * n, 0, first, n) + struct.pack(f">{n}H", *range(1, n + 1))
    tables = {
        "cmap": cmap, "glyf": b"".join(map(outline, range(n))), "head": bytes(54), "loca": struct.pack(f">{n + 2}H", 0, *(10 * k for k in range(n + 1))),
        "maxp": struct.pack(">IH", 0x10000, n + 1),
    } | ({"post": post} if spelt else {})
    out, data, at = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, t in tables.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at + len(data), len(t))
        data += t + b"\0" * (-len(t) % 4)
    return out + data


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores, evenly. A row is few bytes and much work: a table that is a task's
    to read (one row group has a million rows) would be one core's for the whole query."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def made(df: DataFrame, build: Callable[..., bytes], *columns: str) -> DataFrame:
    """(doc_id, content): a file a row, build(*columns) of it; the first column is its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            files = [build(*values) for values in zip(*(c.to_pylist() for c in x.columns))]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    kind = df.schema[columns[0]].dataType.simpleString()
    return dealt(df.select(*columns)).mapInArrow(run, f"doc_id {kind}, content binary")


def of_texts(texts: list[str], info: bool, packed: bool) -> bytes:
    """A page a text, shown as hexadecimal strings of its UTF-8 bytes; with an unused
    object, a /ProcSet, and (info) metadata."""
    n, kids, objects = 4, [], {}
    for t in texts:
        data = t.encode()
        body = b"BT\n  /F1 12.00 Tf\n" + b"".join(b"<%s>   Tj  %% a line\n" % data[i : i + 200].hex().encode() for i in range(0, len(data), 200)) + b"ET\n"
        d = {Name("/Filter"): Name("/FlateDecode")} if packed else {}
        objects[n] = {Name("/Type"): Name("/Page"), Name("/Parent"): Ref(2, 0), Name("/Contents"): Ref(n + 1, 0)}
        objects[n + 1] = Stream(d, zlib.compress(body, 1) if packed else body)
        kids.append(Ref(n, 0))
        n += 2
    resources = {Name("/Font"): {Name("/F1"): Ref(3, 0)}, Name("/ProcSet"): [Name("/PDF"), Name("/Text")]}
    objects |= {
        1: {Name("/Type"): Name("/Catalog"), Name("/Pages"): Ref(2, 0), Name("/PageMode"): Name("/UseNone")},
        2: {Name("/Type"): Name("/Pages"), Name("/Kids"): kids, Name("/Count"): len(kids), Name("/MediaBox"): [0, 0, 612, 792], Name("/Resources"): resources},
        3: {Name("/Type"): Name("/Font"), Name("/Subtype"): Name("/Type1"), Name("/BaseFont"): Name("/Helvetica")},
        n: {Name("/Type"): Name("/Unused")},
    }
    trailer = {Name("/Root"): Ref(1, 0)}
    if info:
        objects[n + 1] = {Name("/Title"): b"A title", Name("/Producer"): b"A producer"}
        trailer[Name("/Info")] = Ref(n + 1, 0)
    return plain_file(objects, trailer)


def pdf_per_row(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content): a file a row; ids divisible by 2 have metadata, by 3 packed streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column(0).to_pylist()
            files = [of_texts([t or ""], i % 2 == 0, i % 3 == 0) for i, t in zip(ids, x.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, content binary")


def pdf_per_group(df: DataFrame, group: str, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """(doc_id, content): a file a group, with a page a row. Groups are of bounded size."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("o")
        return pa.table({"doc_id": t["g"][:1], "content": pa.array([of_texts([x or "" for x in t["t"].to_pylist()], True, False)], pa.binary())})

    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(text_col).alias("t"))
    return rows.groupBy("g").applyInArrow(run, f"doc_id {kind}, content binary")
