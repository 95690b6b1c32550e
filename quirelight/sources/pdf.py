"""PDF documents as tables.

Input is any table with an id and a BINARY column, such as ``read_pdfs`` gives. Each table
below is one narrow pass over it: documents are parsed where they lie, nothing is shuffled,
and columns a query doesn't ask for (payloads above all) are left out of the rows. Several
tables of a document come from one such pass through ``per_document``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from ..cos import content, fonts, images, jpeg
from ..cos.document import Document, edges, rect
from ..cos.filters import filters_of
from ..cos.objects import Name, PdfError, Ref, Stream, number, unparse

BATCH = 16  # documents taken from Arrow at a time; files may be large


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, length, content) of all files *.pdf under a path. doc_id is a hash of
    the path, the same in every run."""
    if not path:
        raise ValueError("a path is asked for")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def from_table(df: DataFrame, content_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, content) of a table; raises if the column isn't BINARY."""
    if dict(df.dtypes).get(content_col) != "binary":
        raise TypeError(f"{content_col} is not a BINARY column")
    return df.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))


def _kind(x) -> str:
    return {Stream: "stream", dict: "dictionary", list: "array", Name: "name", bytes: "string", bool: "boolean", int: "integer"}.get(type(x), "null" if x is None else "real")


def _objects(doc: Document) -> Iterator[tuple]:
    for i, (r, x) in enumerate(doc.objects.items()):
        s = isinstance(x, Stream)
        yield r.num, r.gen, i, _kind(x), unparse(x.dict if s else x).decode("latin-1"), len(x.raw) if s else None, x.raw if s else None, _filter_text(doc, x, "/Filter"), _filter_text(doc, x, "/DecodeParms")


def _filter_text(doc: Document, x, key: str) -> str | None:
    return unparse(doc.get(x.dict.get(key))).decode("latin-1") if isinstance(x, Stream) and key in x.dict else None


def _edges(doc: Document) -> Iterator[tuple]:
    for path, to in edges(doc.trailer):
        yield 0, 65535, list(path), len(path), to.num, to.gen  # the trailer is object 0
    for r, x in doc.objects.items():
        for path, to in edges(x):
            yield r.num, r.gen, list(path), len(path), to.num, to.gen


def _pages(doc: Document) -> Iterator[tuple]:
    for i, (r, page) in enumerate(doc.pages()):
        yield i, *(r or (None, None)), rect(doc, page.get("/MediaBox"))


def _resources(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for category, d in sorted(doc.dict_of(page.get("/Resources")).items()):
            for name, x in sorted(doc.dict_of(d).items()):
                yield i, category, name, *(x if isinstance(x, Ref) else (None, None))


def _images(doc: Document) -> Iterator[tuple]:
    for r, s in doc.objects.items():
        if isinstance(s, Stream) and s.dict.get("/Subtype") == "/Image":
            d = s.dict
            comps, cmyk = images.resolve_space(doc, d.get("/ColorSpace"))
            whole = lambda k: v if isinstance(v := doc.get(d.get(k)), int) else None  # noqa: E731, B023
            of = lambda k: v.num if isinstance(v := d.get(k), Ref) else None  # noqa: E731, B023
            quality = images.estimate_quality(s.raw) if "/DCTDecode" in filters_of(d) else None
            yield *r, whole("/Width"), whole("/Height"), whole("/BitsPerComponent"), unparse(doc.get(d.get("/ColorSpace"))).decode("latin-1"), comps, cmyk, filters_of(d), of("/SMask"), of("/Mask"), quality, len(s.raw), s.raw


def _pixels(doc: Document) -> Iterator[tuple]:
    for r, s in doc.objects.items():
        if isinstance(s, Stream) and s.dict.get("/Subtype") == "/Image":
            yield *r, jpeg.samples(doc, s)


def _glyphs(doc: Document) -> Iterator[tuple]:
    files = {d["/FontFile2"] for x in doc.objects.values() if isinstance(x, dict) and isinstance((d := doc.dict_of(x.get("/FontDescriptor"))).get("/FontFile2"), Ref)}
    for r in sorted(files):
        s = doc.get(r)
        try:
            font = fonts.TrueType(doc.data(s) or b"") if isinstance(s, Stream) else None
        except (ValueError, KeyError, IndexError, struct.error):
            continue
        for g in range(font.glyphs if font else 0):
            yield *r, g, font.loca[g + 1] - font.loca[g]


def _fonts(doc: Document) -> Iterator[tuple]:
    for r, d in doc.objects.items():
        if isinstance(d, dict) and d.get("/Type") == "/Font":
            w = doc.get(d.get("/Widths"))
            first, last = doc.get(d.get("/FirstChar")), doc.get(d.get("/LastChar"))
            desc = doc.dict_of(d.get("/FontDescriptor"))
            file = next((desc[k] for k in ("/FontFile", "/FontFile2", "/FontFile3") if isinstance(desc.get(k), Ref)), None)
            widths = [number(doc.get(v)) for v in w] if isinstance(w, list) else None
            yield *r, d.get("/Subtype"), str(d.get("/BaseFont") or ""), first if isinstance(first, int) else None, last if isinstance(last, int) else None, widths, file.num if file else None, str(d.get("/Subtype", "")).startswith("/CIDFont")


def _annots(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        a = doc.get(page.get("/Annots"))
        for k, x in enumerate(a if isinstance(a, list) else []):
            d = doc.dict_of(x)
            flags, look = doc.get(d.get("/F", 0)), doc.dict_of(d.get("/AP")).get("/N")
            yield i, k, d.get("/Subtype"), flags if isinstance(flags, int) else None, d.get("/FT"), rect(doc, d.get("/Rect")), look.num if isinstance(look, Ref) else None, doc.dict_of(d.get("/A")).get("/S"), "/AA" in d


def _ops(doc: Document) -> Iterator[tuple]:
    done: set[int] = set()
    for i, (r, page) in enumerate(doc.pages()):
        for k, (op, operands) in enumerate(content.operations(doc.contents(page))):
            yield "page", r.num if r else None, i, k, op, [unparse(x).decode("latin-1") for x in operands]
    for r, s in doc.objects.items():
        if isinstance(s, Stream) and s.dict.get("/Subtype") == "/Form" and r.num not in done:
            done.add(r.num)
            for k, (op, operands) in enumerate(content.operations(doc.data(s) or b"")):
                yield "form", r.num, None, k, op, [unparse(x).decode("latin-1") for x in operands]


def _drawn(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for name, (w, h) in content.drawn_sizes(doc.contents(page)).items():
            yield i, name, w, h


def _unreferenced(doc: Document) -> Iterator[tuple]:
    reached = set(doc.reachable())
    return ((r.num, r.gen) for r in doc.objects if r not in reached)


TABLES: dict[str, tuple[Callable[[Document], Iterator[tuple]], str]] = {
    "objects": (_objects, "obj int, gen int, ord int, kind string, value string, stream_len long, raw binary, filter string, decode_parms string"),
    "edges": (_edges, "src_obj int, src_gen int, path array<string>, depth int, dst_obj int, dst_gen int"),
    "pages": (_pages, "page_no int, obj int, gen int, media_box array<double>"),
    "page_resources": (_resources, "page_no int, category string, name string, dst_obj int, dst_gen int"),
    "images": (_images, "obj int, gen int, width int, height int, bpc int, colorspace string, n_comp int, is_cmyk boolean, filter array<string>, smask_obj int, mask_obj int, quality int, stream_len long, raw binary"),
    "pixels": (_pixels, "obj int, gen int, samples binary"),
    "glyphs": (_glyphs, "obj int, gen int, glyph int, size int"),
    "fonts": (_fonts, "obj int, gen int, subtype string, base_font string, first_char int, last_char int, widths array<double>, file_obj int, is_cid boolean"),
    "annots": (_annots, "page_no int, idx int, subtype string, flags int, ft string, rect array<double>, ap_obj int, action_s string, has_aa boolean"),
    "content_ops": (_ops, "owner_kind string, owner_obj int, page_no int, seq long, op string, operands array<string>"),
    "drawn": (_drawn, "page_no int, name string, width double, height double"),
    "unreferenced": (_unreferenced, "obj int, gen int"),
    "status": (lambda doc: [(doc.status, len(doc.objects), len(doc.pages()))], "status string, n_objects int, n_pages int"),
}


def _rows(data: bytes | None, wanted: list[tuple[str, Callable, list[int]]]) -> list[list[tuple]]:
    """The chosen columns of each wanted table of a file, from one reading of it."""
    try:
        doc = Document.read(data or b"")
    except (PdfError, RecursionError):
        return [[tuple(("not_pdf", 0, 0)[i] for i in at)] if name == "status" else [] for name, _, at in wanted]
    out = []
    for name, rows_of, at in wanted:
        try:
            found = [] if doc.status == "encrypted" and name != "status" else [tuple(r[i] for i in at) for r in rows_of(doc)]
        except (PdfError, RecursionError):
            found = []
        out.append(found)
    return out


def _wanted(name: str, columns: list[str] | None) -> tuple[StructType, tuple[str, Callable, list[int]]]:
    rows_of, ddl = TABLES[name]
    whole = StructType.fromDDL(ddl)
    chosen = columns or whole.names
    return StructType([whole[c] for c in chosen]), (name, rows_of, [whole.names.index(c) for c in chosen])


def table(pdfs: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of TABLES: doc_id and its columns, or the chosen ones. Documents that can't
    be read, or are encrypted, have rows in ``status`` only."""
    fields, wanted = _wanted(name, columns)
    schema = StructType([pdfs.schema["doc_id"], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            rows = [(doc_id, *r) for doc_id, data in zip(x.column(0).to_pylist(), x.column(1).to_pylist()) for r in _rows(data, [wanted])[0]]
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return pdfs.select("doc_id", "content").mapInArrow(run, schema)


def per_document(pdfs: DataFrame, tables: dict[str, list[str]]) -> DataFrame:
    """A row a document: doc_id, and for each table of TABLES an array of its chosen columns, in
    the table's order. Questions about single documents need no shuffle then, and a file is read
    once whatever the number of tables. Documents that ``table`` leaves out have empty arrays."""
    wanted = {name: _wanted(name, columns) for name, columns in tables.items()}
    schema = StructType([pdfs.schema["doc_id"], *(StructField(name, ArrayType(fields)) for name, (fields, _) in wanted.items())])
    arrow, each = to_arrow_schema(schema), [w for _, w in wanted.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            found = [_rows(data, each) for data in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array([f[i] for f in found], arrow.field(i + 1).type) for i in range(len(each)))], schema=arrow)

    return pdfs.select("doc_id", "content").mapInArrow(run, schema)
