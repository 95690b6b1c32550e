"""Queries that run the rewrite passes over real files, one made from each row of a table.

What a pass should leave follows from the row, so SQL can tell it without reading a file.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cos import jpeg
from ..cos.objects import Name, Ref, Stream
from ..cos.passes import Options
from ..sources import pdf
from ..sources.synthetic import entries, image, made, one_page, true_type
from ..staging import stage
from . import compress as api
from .registry import Registry

c = F.col
_all = Registry()
query, queries, oracle_sql = _all.query, _all.queries, _all.oracle_sql
GRAY, RGB, CMYK = Name("/DeviceGray"), Name("/DeviceRGB"), Name("/DeviceCMYK")


def _rewritten(files: DataFrame, **options) -> DataFrame:
    return api.compress(files, Options(**options)).select("doc_id", c("output").alias("content"))


def _named(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumnRenamed("doc_id", id_col)


# ---- reading, page tree, forms


def _state(key: int) -> bytes:
    good = one_page(b"BT /F1 12 Tf (%d) Tj ET" % key)
    bad = good[: good.rindex(b"startxref")] + b"startxref\n999999\n%%EOF\n"
    locked = good.replace(b"trailer\n<<", b"trailer\n<</Encrypt<</Filter/Standard>>")
    return [good, bad, b"", b"this is no file of that kind", locked][key % 5]


@query("SELECT c_custkey, ['ok', 'repaired', 'empty', 'not_pdf', 'encrypted'][c_custkey % 5 + 1] AS status, c_custkey % 5 < 2 AS written FROM customer")
def file_status(t):
    done = api.compress(made(t("customer"), _state, "c_custkey"))
    return _named(done.select("doc_id", "status", c("output").isNotNull().alias("written")), "c_custkey")


def _tree(key: int) -> bytes:
    leaf = lambda up, **more: entries(Type=Name("/Page"), Parent=Ref(up, 0), **more)
    inner = entries(Type=Name("/Pages"), Parent=Ref(2, 0), Kids=[Ref(21, 0), Ref(22, 0)], Count=2, MediaBox=[0, 0, 100 + key % 50, 200])
    objects = {20: inner, 21: leaf(20), 22: leaf(20, MediaBox=[0, 0, 10, 20 + key % 7]), 23: leaf(2)}
    top = entries(Type=Name("/Pages"), Kids=[Ref(20, 0), Ref(23, 0)], Count=3, MediaBox=[0, 0, 612, 792])
    return one_page(b"", objects | {2: top})


@query("""SELECT c_custkey, page_no, CASE page_no WHEN 0 THEN 100 + c_custkey % 50 WHEN 1 THEN 10 ELSE 612 END::DOUBLE AS w, CASE page_no WHEN 0 THEN 200 WHEN 1 THEN 20 + c_custkey % 7 ELSE 792 END::DOUBLE AS h, 1 AS nodes
          FROM customer, (SELECT unnest([0, 1, 2])::INT AS page_no)""")
def flat_page_tree(t):
    done = pdf.per_document(_rewritten(made(t("customer"), _tree, "c_custkey")), {"objects": ["obj", "value"], "pages": ["page_no", "obj", "media_box"]})
    holds = lambda x, key: x["value"].contains(key)
    nodes = F.size(F.filter("objects", lambda x: holds(x, "/Kids")))
    own = F.transform(F.filter("objects", lambda x: holds(x, "/MediaBox") & ~holds(x, "/Kids")), lambda x: x["obj"])
    pages = done.select("doc_id", nodes.alias("nodes"), own.alias("own"), F.inline("pages")).where(F.array_contains("own", c("obj")))  # boxes that are the page's own
    return _named(pages.select("doc_id", "page_no", F.get("media_box", 2).alias("w"), F.get("media_box", 3).alias("h"), "nodes"), "c_custkey")


def _form(key: int, size: int) -> bytes:
    x, y, w, h = key % 90, size, 2 + key % 7, 3 + size % 5
    box = [x, y, x + w * (1 + key % 4), y + h * (1 + size % 3)]
    look = Stream(entries(BBox=[3, 4, 3 + w, 4 + h]) | (entries(Matrix=[0, 1, -1, 0, 0, 0]) if key % 3 == 0 else {}), b"0 0 1 1 re f")
    field = entries(Subtype=Name("/Link" if size % 5 == 0 else "/Widget"), FT=Name("/Sig" if size % 7 == 0 else "/Tx"), F=key % 64, AP=entries(N=Ref(20, 0)))
    field[Name("/Rect")] = [*box[2:], *box[:2]] if key % 2 else box  # corners may be the other way round
    return one_page(b"BT ET", {20: look}, entries(Annots=[field]), entries(AcroForm=entries(Fields=[])))


@query("""SELECT p_partkey, go AS stamped, NOT go AS kept, false AS has_form, CASE WHEN go AND turned THEN 0 WHEN go THEN sx END::DOUBLE AS a, CASE WHEN go AND turned THEN -sy WHEN go THEN 0 END::DOUBLE AS b,
            CASE WHEN go AND turned THEN sx WHEN go THEN 0 END::DOUBLE AS c, CASE WHEN go AND turned THEN 0 WHEN go THEN sy END::DOUBLE AS d, CASE WHEN go THEN x - 3 * sx END::DOUBLE AS e, CASE WHEN go THEN y - 4 * sy END::DOUBLE AS f
          FROM (SELECT p_partkey, p_size % 5 <> 0 AND p_size % 7 <> 0 AND (p_partkey % 64) & 35 = 0 AS go, p_partkey % 3 = 0 AS turned, 1 + p_partkey % 4 AS sx, 1 + p_size % 3 AS sy, p_partkey % 90 AS x, p_size AS y FROM part)""")
def flat_forms(t):
    done = pdf.per_document(_rewritten(made(t("part"), _form, "p_partkey", "p_size")), {"content_ops": ["op", "operands", "owner_kind"], "annots": ["idx"], "objects": ["value"]})
    cm = F.filter("content_ops", lambda x: (x["owner_kind"] == "page") & (x["op"] == "cm"))
    m = F.transform(F.get(cm, 0)["operands"], lambda v: v.cast("double"))
    form = F.exists("objects", lambda x: x["value"].contains("/AcroForm"))
    found = done.select("doc_id", (F.size(cm) > 0).alias("stamped"), (F.size("annots") > 0).alias("kept"), form.alias("has_form"), m.alias("m"))
    return _named(found.select("doc_id", "has_form", "stamped", "kept", *[F.get("m", i).alias(n) for i, n in enumerate("abcdef")]), "p_partkey")


# ---- what is stripped. Bit k of the row's key says whether a file has the entry k.


def _bits(key: int, at: int, parts: dict) -> dict:
    return {Name(f"/{k}"): v for i, (k, v) in enumerate(parts.items()) if key >> (at + i) & 1}


def _left(done: DataFrame, names: list[str], id_col: str) -> DataFrame:
    """The names, in order, that objects or the trailer of a file still have as keys; a name
    tree that is empty doesn't count."""
    found = pdf.per_document(done, {"objects": ["value"], "edges": ["src_obj", "path"]})
    trailer = F.transform(F.filter("edges", lambda x: x["src_obj"] == 0), lambda x: F.get(x["path"], 0))
    text = F.regexp_replace(F.array_join(F.concat(F.transform("objects", lambda x: x["value"]), trailer), " "), r"/Names\s*<<\s*>>", "")
    hits = [F.when(c("text").rlike(f"/{n}(?![A-Za-z])"), F.lit(n)) for n in names]
    return _named(found.select("doc_id", text.alias("text")).select("doc_id", F.array_join(F.array(*hits), ",").alias("names")), id_col)


def _overhead(key: int) -> bytes:
    root = _bits(key, 0, {"StructTreeRoot": {}, "PageMode": Name("/UseNone"), "OutputIntents": [], "ViewerPreferences": {}, "Lang": b"en"})
    page = _bits(key, 5, {"Tabs": Name("/S"), "StructParents": 0, "Rotate": 90})
    return one_page(b"BT /F1 9 Tf (a) Tj ET", {20: entries(Type=Name("/Font"), Subtype=Name("/Type1"), BaseFont=Name("/Helvetica"))}, page | entries(Resources=entries(Font=entries(F1=Ref(20, 0))) | _bits(key, 8, {"ProcSet": [Name("/PDF")]})), root)


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey & 16 > 0 THEN 'Lang' END, CASE WHEN c_custkey & 128 > 0 THEN 'Rotate' END], lambda v: v IS NOT NULL), ',') AS names FROM customer")
def strip_overhead(t):
    done = _rewritten(made(t("customer"), _overhead, "c_custkey"))
    return _left(done, ["StructTreeRoot", "PageMode", "OutputIntents", "ViewerPreferences", "Lang", "Tabs", "StructParents", "Rotate", "ProcSet"], "c_custkey")


def _active(key: int) -> bytes:
    js, go = entries(S=Name("/JavaScript"), JS=b"x"), entries(S=Name("/GoTo"), D=[0])
    names = _bits(key, 1, {"JavaScript": entries(Kids=[]), "EmbeddedFiles": entries(Kids=[]), "Pages": entries(Kids=[])})
    root = entries(OpenAction=js if key & 1 else go) | (entries(Names=names) if names else {}) | _bits(key, 4, {"AA": entries(WC=js)})
    link = entries(Subtype=Name("/Link"), Rect=[0, 0, 9, 9], A=js if key >> 5 & 1 else entries(S=Name("/URI"), URI=b"u"))
    return one_page(b"BT ET", None, entries(Annots=[link]) | _bits(key, 6, {"AA": entries(O=js)}), root)


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'OpenAction' END, CASE WHEN c_custkey & 12 > 0 AND c_custkey & 8 > 0 THEN 'Names' END, CASE WHEN c_custkey & 32 = 0 THEN 'URI' END], lambda v: v IS NOT NULL), ',') AS names FROM customer""")
def strip_scripts_and_files(t):
    """Scripts and attachments go, other actions and names stay; a name tree that only had
    attachments goes whole, one that only had scripts stays, empty (it then counts as gone)."""
    return _left(_rewritten(made(t("customer"), _active, "c_custkey")), ["OpenAction", "JavaScript", "EmbeddedFiles", "AA", "Names", "URI"], "c_custkey")


def _described(key: int) -> bytes:
    root = _bits(key, 0, {"Metadata": Ref(20, 0), "MarkInfo": {}, "Lang": b"en"})
    page = _bits(key, 3, {"Metadata": Ref(21, 0), "PieceInfo": {}, "Thumb": Ref(22, 0), "Rotate": 0})
    objects = {20: Stream(entries(Type=Name("/Metadata")), b"<x/>"), 21: Stream(entries(Type=Name("/Metadata")), b"<y/>"), 22: image(1, 1, GRAY, b"\0"), 23: entries(Title=b"t")}
    return one_page(b"BT ET", objects, page, root, _bits(key, 7, {"Info": Ref(23, 0)}))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey & 4 > 0 THEN 'Lang' END, CASE WHEN c_custkey & 64 > 0 THEN 'Rotate' END], lambda v: v IS NOT NULL), ',') AS names FROM customer")
def strip_descriptions(t):
    done = _rewritten(made(t("customer"), _described, "c_custkey"))
    return _left(done, ["Metadata", "MarkInfo", "Lang", "PieceInfo", "Thumb", "Rotate", "Info"], "c_custkey")


# ---- images


def _shown(images: list[Stream], objects: dict | None = None, content: bytes | None = None) -> bytes:
    names = {Name(f"/I{i}"): Ref(30 + i, 0) for i in range(len(images))}
    content = content if content is not None else b"".join(b"q 1000 0 0 1000 0 0 cm /I%d Do Q\n" % i for i in range(len(images)))
    return one_page(content, {30 + i: x for i, x in enumerate(images)} | (objects or {}), entries(Resources=entries(XObject=names)))


def _copies(key: int, name: str, brand: str, size: int) -> bytes:
    a = (name * 40).encode()
    b = a if key % 2 == 0 else (brand * 40).encode()
    return _shown([image(len(a), 1, GRAY, a), image(len(b), 1, GRAY, b), image(len(a) if size % 2 == 0 else len(a) // 2, 1, GRAY, a)])


@query("SELECT p_partkey, 1 + CASE WHEN p_partkey % 2 = 1 AND p_name <> p_brand THEN 1 ELSE 0 END + CASE WHEN p_size % 2 = 1 THEN 1 ELSE 0 END AS images FROM part")
def dedup_images(t):
    done = pdf.per_document(_rewritten(made(t("part"), _copies, "p_partkey", "p_name", "p_brand", "p_size")), {"images": ["obj"]})
    return _named(done.select("doc_id", F.size("images").alias("images")), "p_partkey")


def _levels(key: int, values: list[float]) -> bytes:
    """64 gray levels: black and white for ids divisible by 4, others from the components."""
    v = np.array(values, np.float64)
    return (np.where(v > 0, 255, 0) if key % 4 == 0 else np.floor((v + 1) * 127.5)).astype(np.uint8).tobytes()


def _coloured(key: int, values: list[float]) -> bytes:
    px = np.frombuffer(_levels(key, values), np.uint8)
    turned = np.stack([px, px[::-1], px], 1).tobytes()
    kind = key // 4 % 5
    if kind == 0:
        shown = image(8, 8, GRAY, px.tobytes())
    elif kind == 1:
        shown = image(8, 8, RGB, np.repeat(px, 3).tobytes())
    elif kind == 2:
        shown = image(8, 8, RGB, turned)
    elif kind == 3:
        shown = image(8, 8, [Name("/ICCBased"), Ref(20, 0)], px.tobytes())
    else:
        shown = image(8, 8, GRAY, px.tobytes(), Mask=[0, 0])  # masked: stays at 8 bits
    return _shown([shown], {20: Stream(entries(N=1 if key % 3 else 2), b"profile")})


_PIX = "list_transform(embedding, lambda x: CASE WHEN vec_id % 4 = 0 THEN CASE WHEN x > 0 THEN 255 ELSE 0 END ELSE floor((x::DOUBLE + 1) * 127.5)::INT END)"


@query(f"""SELECT vec_id, CASE WHEN NOT ok THEN 0 WHEN rgb THEN 3 ELSE 1 END AS comps, CASE WHEN one THEN 1 ELSE 8 END AS bpc,
             CASE WHEN one THEN array_to_string(list_transform(generate_series(0, 7), lambda r: printf('%02X', list_sum(list_transform(generate_series(1, 8), lambda i: CASE WHEN px[r * 8 + i] >= 224 THEN 1 << (8 - i) ELSE 0 END))::INT)), '')
               WHEN rgb THEN array_to_string(list_transform(generate_series(1, 64), lambda i: printf('%02X%02X%02X', px[i], px[65 - i], px[i])), '')
               ELSE array_to_string(list_transform(px, lambda v: printf('%02X', v)), '') END AS samples
           FROM (SELECT *, kind = 2 AND len(list_filter(generate_series(1, 64), lambda i: px[i] <> px[65 - i])) > 0 AS rgb, kind <> 3 OR vec_id % 3 <> 0 AS ok,
             len(list_filter(px, lambda v: v > 32 AND v < 224)) = 0 AND kind <> 4 AND (kind <> 3 OR vec_id % 3 <> 0) AND NOT (kind = 2 AND len(list_filter(generate_series(1, 64), lambda i: px[i] <> px[65 - i])) > 0) AS one
             FROM (SELECT vec_id, vec_id // 4 % 5 AS kind, {_PIX} AS px FROM embeddings))""")
def optimise_colours(t):
    """ICC to device spaces, RGB that is gray to gray, black and white to one bit."""
    done = pdf.per_document(_rewritten(made(t("embeddings"), _coloured, "vec_id", "embedding")), {"images": ["n_comp", "bpc"], "pixels": ["samples"]})
    return _named(done.select("doc_id", c("images")[0]["n_comp"].alias("comps"), c("images")[0]["bpc"].alias("bpc"), F.hex(c("pixels")[0]["samples"]).alias("samples")), "vec_id")


def _noise(key: int, w: int, h: int, comps: int) -> bytes:
    return np.random.default_rng(key).integers(0, 256, w * h * comps, np.uint8).tobytes()


def _for_lossy(key: int) -> bytes:
    kind = key % 7
    if kind < 4:
        data = jpeg.encode(_noise(key, 64, 64, 1), 64, 64, 1, (20, 65, 90, 100)[kind])
        shown = image(64, 64, GRAY, data, Filter=Name("/DCTDecode"))
    elif kind == 4:
        shown = image(64, 64, RGB, _noise(key, 64, 64, 3))
    elif kind == 5:
        shown = image(64, 64, CMYK, _noise(key, 64, 64, 4))
    else:
        shown = image(40, 40, RGB, _noise(key, 40, 40, 3))  # too small
    return _shown([shown])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 6 THEN 40 ELSE 64 END AS width, CASE WHEN s_suppkey % 7 < 4 THEN 1 ELSE 3 END AS comps, CASE s_suppkey % 7 WHEN 0 THEN 20 WHEN 1 THEN 65 WHEN 6 THEN NULL ELSE 75 END AS quality FROM supplier""")
def optimise_images(t):
    """What a lossy rewrite leaves: good JPEG and raw images at the target quality, CMYK as RGB."""
    done = _rewritten(made(t("supplier"), _for_lossy, "s_suppkey"), lossy=True)
    return _named(pdf.table(done, "images", ["width", "n_comp", "quality"]).withColumnRenamed("n_comp", "comps"), "s_suppkey")


def _large(key: int) -> bytes:
    w, h, by = 60 + key % 40, 50 + key % 30, (0.5, 1, 2, 3, 4)[key % 5]
    content = b"q %.6f 0 0 %.6f 0 0 cm /I0 Do Q q 1 0 0 1 0 0 cm /I0 Do Q Q" % (w / by, h / by)  # the larger use counts
    return _shown([image(w, h, GRAY, _noise(key, w, h, 1))], None, content)


@query("""SELECT s_suppkey, CASE WHEN f > 1 THEN floor(w / f + 0.5) ELSE w END::INT AS width, CASE WHEN f > 1 THEN floor(h / f + 0.5) ELSE h END::INT AS height
          FROM (SELECT s_suppkey, 60 + s_suppkey % 40 AS w, 50 + s_suppkey % 30 AS h, [0.5, 1, 2, 3, 4][s_suppkey % 5 + 1]::DOUBLE AS f FROM supplier)""")
def downscale_images(t):
    done = _rewritten(made(t("supplier"), _large, "s_suppkey"), lossy=True)
    return _named(pdf.table(done, "images", ["width", "height"]), "s_suppkey")


def _flat_blocks(key: int, values: list[float]) -> bytes:
    """Blocks of one level each, at a quality that keeps them exactly; with a needless marker,
    progressive for odd ids, and as its own soft mask."""
    px = np.frombuffer(_levels(1, values), np.uint8).reshape(8, 8).repeat(8, 0).repeat(8, 1)
    data = jpeg.write(jpeg.read(jpeg.encode(px.tobytes(), 64, 64, 1, 100)), key % 2 == 1)
    data = data[:2] + b"\xff\xe1\0\x20" + b"Exif" + bytes(26) + data[2:]
    picture = lambda **more: image(64, 64, GRAY, data, Filter=Name("/DCTDecode"), **more)
    return _shown([picture(SMask=Ref(20, 0))], {20: picture()})


_EIGHT = "list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INT)"


@query(f"SELECT vec_id, is_mask, false AS marker, array_to_string(list_transform({_EIGHT}, lambda v: printf('%02X', v)), '') AS blocks FROM embeddings, (SELECT unnest([true, false]) AS is_mask)")
def optimise_jpegs(t):
    """JPEG images and masks lose what isn't needed, and no sample in the middle of a block changes."""
    done = pdf.per_document(_rewritten(made(t("embeddings"), _flat_blocks, "vec_id", "embedding")), {"images": ["smask_obj", "raw"], "pixels": ["samples"]})
    found = done.select("doc_id", F.inline(F.arrays_zip("images", "pixels"))).select("doc_id", "images.smask_obj", "images.raw", F.hex("pixels.samples").alias("h"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring("h", 1 + 2 * (64 * (8 * F.floor(i / 8) + 3) + 8 * (i % 8) + 4).cast("int"), F.lit(2)))
    return _named(found.select("doc_id", c("smask_obj").isNull().alias("is_mask"), F.contains("raw", F.encode(F.lit("Exif"), "UTF-8")).alias("marker"), F.array_join(blocks, "").alias("blocks")), "vec_id")


def _drawn(key: int, size: int) -> bytes:
    a, b = 1 + key % 5, 1 + size % 7
    return _shown([image(100 + key % 900, 50 + size, GRAY, b"")], None, b"Q q 2 0 0 3 0 0 cm q %d 0 0 %d 7 7 cm /I0 Do Q /I1 Do Q /I1 Do q 0 %d -%d 0 0 0 cm /I2 Do" % (a, b, a, b))


@query("""SELECT p_partkey, n AS name, CASE n WHEN '/I0' THEN 2 * (1 + p_partkey % 5) WHEN '/I1' THEN 2 ELSE 1 + p_size % 7 END::DOUBLE AS w, CASE n WHEN '/I0' THEN 3 * (1 + p_size % 7) WHEN '/I1' THEN 3 ELSE 1 + p_partkey % 5 END::DOUBLE AS h
          FROM part, (SELECT unnest(['/I0', '/I1', '/I2']) AS n)""")
def drawn_sizes(t):
    """Nested matrices, a Q too many, rotation; the larger of two uses."""
    return _named(pdf.table(made(t("part"), _drawn, "p_partkey", "p_size"), "drawn").select("doc_id", "name", c("width").alias("w"), c("height").alias("h")), "p_partkey")


@query("""SELECT p_partkey, round(dpi, 6) AS dpi, CASE WHEN go THEN nw ELSE w END::BIGINT AS new_w, CASE WHEN go THEN nh ELSE h END::BIGINT AS new_h FROM (
            SELECT *, dpi > 72 AND NOT (w - nw <= 1 AND h - nh <= 1) AS go FROM (SELECT *, greatest(1, floor(w * (72.0::DOUBLE / dpi) + 0.5)) AS nw, greatest(1, floor(h * (72.0::DOUBLE / dpi) + 0.5)) AS nh FROM (
            SELECT p_partkey, w, h, greatest(w / (2 * (1 + p_partkey % 5) / 72.0::DOUBLE), h / (3 * (1 + p_size % 7) / 72.0::DOUBLE)) AS dpi FROM (SELECT *, 100 + p_partkey % 900 AS w, 50 + p_size AS h FROM part))))""")
def image_resolution(t):
    files = made(t("part"), _drawn, "p_partkey", "p_size")
    found = api.image_resolution(*(pdf.table(files, n) for n in ("images", "page_resources", "drawn", "pages")))
    return _named(found.select("doc_id", F.round("dpi", 6).alias("dpi"), "new_w", "new_h"), "p_partkey")


# ---- fonts


def _text(data: bytes) -> bytes:
    return b"<" + data.hex().encode() + b">"


def _fonts(key: int, name: str, segment: str) -> bytes:
    """Two fonts share a file. One shows the name on the page, the other the segment in a form
    that another form draws; every fifth has the name of a subset."""
    simple = lambda base: entries(Type=Name("/Font"), Subtype=Name("/TrueType"), BaseFont=Name(base), FirstChar=32, LastChar=126, Widths=[300 + k for k in range(32, 127)], Encoding=Name("/WinAnsiEncoding"), FontDescriptor=entries(Type=Name("/FontDescriptor"), FontFile2=Ref(22, 0)))
    form = lambda resources, content: Stream(entries(Type=Name("/XObject"), Subtype=Name("/Form"), BBox=[0, 0, 9, 9], Resources=resources), content)
    objects = {
        20: simple("/One"), 21: simple("/ABCDEF+Two" if key % 5 == 0 else "/Two"), 22: Stream({}, true_type(32, 126)),
        23: form(entries(XObject=entries(X2=Ref(24, 0))), b"/X2 Do"), 24: form(entries(Font=entries(F2=Ref(21, 0))), b"BT /F2 9 Tf %s Tj ET" % _text(segment.encode())),
    }
    return one_page(b"BT /F1 9 Tf [%s -20 <>] TJ ET /X1 Do" % _text(name.encode()), objects, entries(Resources=entries(Font=entries(F1=Ref(20, 0)), XObject=entries(X1=Ref(23, 0)))))


_CODES = "list_distinct(list_transform(string_split({0}, ''), lambda v: ascii(v)))"


@query(f"""SELECT c_custkey, base_font, list_max(codes)::INT AS last_char, list_sum(list_transform(codes, lambda v: 300 + v))::DOUBLE AS total FROM (
             SELECT c_custkey, '/One' AS base_font, {_CODES.format('c_name')} AS codes FROM customer
             UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '/ABCDEF+Two' ELSE '/Two' END, {_CODES.format('c_mktsegment')} FROM customer)""")
def trim_font_widths(t):
    done = _rewritten(made(t("customer"), _fonts, "c_custkey", "c_name", "c_mktsegment"))
    fonts = pdf.table(done, "fonts", ["base_font", "last_char", "widths"])
    return _named(fonts.select("doc_id", "base_font", "last_char", F.aggregate("widths", F.lit(0.0), lambda a, v: a + v).alias("total")), "c_custkey")


@query(f"""SELECT c_custkey, 96 AS glyphs, CASE WHEN c_custkey % 5 = 0 THEN 95 ELSE len(codes) END::BIGINT AS drawn, CASE WHEN c_custkey % 5 = 0 THEN 4560 ELSE list_sum(list_transform(codes, lambda v: v - 31)) END::BIGINT AS total
           FROM (SELECT c_custkey, {_CODES.format('c_name || c_mktsegment')} AS codes FROM customer)""")
def subset_fonts(t):
    """Glyphs of a file that two fonts share; a font that is a subset already keeps it whole."""
    done = pdf.per_document(_rewritten(made(t("customer"), _fonts, "c_custkey", "c_name", "c_mktsegment")), {"glyphs": ["glyph", "size"]})
    has = F.filter("glyphs", lambda g: g["size"] > 0)
    return _named(done.select("doc_id", F.size("glyphs").alias("glyphs"), F.size(has).cast("long").alias("drawn"), F.aggregate(has, F.lit(0).cast("long"), lambda a, g: a + g["glyph"]).alias("total")), "c_custkey")


def _encoded(key: int, size: int) -> bytes:
    """Code 65 is the glyph of a letter by /Differences, 66 one by /ToUnicode, 67 one whose name only
    the file knows, 128 the euro of WinAnsi, which the file does not have: then all glyphs stay."""
    letter = chr(97 + key % 26)
    uni = b"1 beginbfrange <42> <42> <%04x> endbfrange" % (48 + size % 9)
    font = entries(Type=Name("/Font"), Subtype=Name("/TrueType"), BaseFont=Name("/One"), FirstChar=60, Widths=[5] * 20, ToUnicode=Ref(23, 0), FontDescriptor=entries(FontFile2=Ref(22, 0)))
    font[Name("/Encoding")] = entries(BaseEncoding=Name("/WinAnsiEncoding"), Differences=[65, Name(f"/{letter}"), 67, Name("/swirl")])
    objects = {20: font, 22: Stream({}, true_type(32, 122, {90: "swirl"})), 23: Stream({}, uni)}
    return one_page(b"BT /F1 9 Tf %s Tj ET" % _text(b"ABC" + (b"\x80" if key % 7 == 0 else b"")), objects, entries(Resources=entries(Font=entries(F1=Ref(20, 0)))))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([34, 35, 36, 90, 97 + p_partkey % 26 - 31, 48 + p_size % 9 - 31])), ',') END AS glyphs FROM part""")
def encoded_glyphs(t):
    """Glyphs that stay, by every way in which a code may name one (its own number too)."""
    done = pdf.per_document(_rewritten(made(t("part"), _encoded, "p_partkey", "p_size")), {"glyphs": ["glyph", "size"]})
    g = F.transform(F.filter("glyphs", lambda x: x["size"] > 0), lambda x: x["glyph"])
    return _named(done.select("doc_id", F.when(F.size(g) < 91, F.array_join(g, ",")).otherwise("").alias("glyphs")), "p_partkey")


def _composite(key: int) -> bytes:
    first = key % 50
    cids = [first, first + 1, first + 3]
    below = entries(Type=Name("/Font"), Subtype=Name("/CIDFontType2"), BaseFont=Name("/Two"), W=[v for k in range(60) for v in (k, [500 + k])], FontDescriptor=entries(Type=Name("/FontDescriptor")))
    top = entries(Type=Name("/Font"), Subtype=Name("/Type0"), BaseFont=Name("/Two"), Encoding=Name("/Identity-H"), DescendantFonts=[Ref(21, 0)])
    return one_page(b"BT /F1 9 Tf %s Tj ET" % _text(b"".join(k.to_bytes(2, "big") for k in cids)), {20: top, 21: below}, entries(Resources=entries(Font=entries(F1=Ref(20, 0)))))


@query("SELECT p_partkey, k || '[' || (500 + k) || ' ' || (501 + k) || ']' || (k + 3) || '[' || (503 + k) || ']' AS w FROM (SELECT p_partkey, p_partkey % 50 AS k FROM part)")
def trim_cid_widths(t):
    done = _rewritten(made(t("part"), _composite, "p_partkey"))
    w = F.regexp_extract("value", r"/W\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", 1)
    found = pdf.table(done, "objects", ["value"]).where(c("value").contains("/CIDFontType2"))
    return _named(found.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(w, r"\s*([\[\]])\s*", "$1"), r"\s+", " ")).alias("w")), "p_partkey")


# ---- resources and content


def _resources(key: int, size: int) -> bytes:
    """Names that the page, or a form of it, uses; masks of images that stay."""
    dot = lambda **more: image(1, 1, GRAY, bytes([128, size]), **more)
    form = Stream(entries(Type=Name("/XObject"), Subtype=Name("/Form"), BBox=[0, 0, 1, 1]), b"/G%d gs" % (size % 5))
    x = entries(A=Ref(20, 0), M=Ref(21, 0), K=Ref(22, 0), U=Ref(23, 0), X=Ref(24, 0))
    objects = {20: dot(SMask=Ref(21, 0)), 21: dot(Mask=Ref(22, 0)), 22: dot(), 23: dot(), 24: form}
    states = {Name(f"/G{i}"): entries(LW=i + 1) for i in range(5)}
    content = b"/G%d gs %s /X Do" % (key % 5, b"/A Do" if key % 2 else b"/M Do")
    return one_page(content, objects, entries(Resources=entries(XObject=x, ExtGState=states)))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(['/G' || p_partkey % 5, '/G' || p_size % 5, '/M', '/K', '/X', CASE WHEN p_partkey % 2 = 1 THEN '/A' ELSE '/M' END])), ',') AS names FROM part""")
def remove_unused_resources(t):
    done = pdf.per_document(_rewritten(made(t("part"), _resources, "p_partkey", "p_size")), {"page_resources": ["name"]})
    return _named(done.select("doc_id", F.array_join(F.sort_array(F.transform("page_resources", lambda x: x["name"])), ",").alias("names")), "p_partkey")


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter(['/G0', '/G1', '/G2', '/G3', '/G4', '/U', '/K', '/M', '/A'], lambda n: n <> '/G' || p_partkey % 5 AND n <> CASE WHEN p_partkey % 2 = 1 THEN '/A' ELSE '/M' END)), ',') AS names FROM part""")
def unused_names(t):
    """The same as a relation: what no operator of the page itself names, masks and forms aside."""
    files = made(t("part"), _resources, "p_partkey", "p_size")
    read = stage(pdf.per_document(files, {"content_ops": ["owner_kind", "page_no", "op", "operands"], "page_resources": ["page_no", "category", "name"]}), "unused_names")  # both tables from one reading
    ops = read.select("doc_id", F.inline("content_ops")).where("owner_kind = 'page'")
    found = api.unused_resources(read.select("doc_id", F.inline("page_resources")), ops)
    return _named(found.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")), "p_partkey")


def _in_parts(key: int, size: int) -> bytes:
    return one_page([b"BT (%d) Tj ET " % i for i in range(1 + size % 6)])


@query("SELECT p_partkey, 1 AS streams, p_size % 6 + 1 AS shown FROM part")
def coalesce_contents(t):
    done = pdf.per_document(_rewritten(made(t("part"), _in_parts, "p_partkey", "p_size")), {"objects": ["kind"], "content_ops": ["op"]})
    shown = F.size(F.filter("content_ops", lambda x: x["op"] == "Tj"))
    return _named(done.select("doc_id", F.size(F.filter("objects", lambda x: x["kind"] == "stream")).alias("streams"), shown.alias("shown")), "p_partkey")


def _wordy(key: int, size: int) -> bytes:
    return one_page(b"q  1.50  0  0 %d.00 0.250 -0.50 cm  %% (a remark)\n /Im%d  Do\nQ\r\n[ (a  \\(b) 1.0 <41 4 2> ]  TJ << /K  [ 1 /L ] >>  /P  BDC\n" % (key, size))


@query("SELECT p_partkey, 'q 1.5 0 0 ' || p_partkey || ' .25 -.5 cm /Im' || p_size || ' Do Q [(a  \\(b)1<4142>]TJ <</K [1 /L]>>/P BDC' AS content FROM part")
def minify_contents(t):
    """A space stays before [ and <<, none before ] and >>, strings or what follows a delimiter."""
    done = _rewritten(made(t("part"), _wordy, "p_partkey", "p_size"))
    streams = pdf.table(done, "objects", ["kind", "raw", "filter"]).where("kind = 'stream'")
    return _named(streams.select("doc_id", F.decode("raw", "ISO-8859-1").alias("content")), "p_partkey")


def _same_streams(key: int, name: str, brand: str) -> bytes:
    maps = [b"% " + x.encode() * 8 for x in (name, brand, name if key % 2 else name + ".")]
    objects = {20 + i: entries(Type=Name("/Font"), Subtype=Name("/Type1"), BaseFont=Name(f"/B{i}"), ToUnicode=Ref(30 + i, 0)) for i in range(3)}
    objects |= {30 + i: Stream({}, x) for i, x in enumerate(maps)}
    return one_page(b"BT /F0 9 Tf /F1 9 Tf /F2 9 Tf (a) Tj ET", objects, entries(Resources=entries(Font={Name(f"/F{i}"): Ref(20 + i, 0) for i in range(3)})))


@query("SELECT p_partkey, 1 + CASE WHEN p_name = p_brand THEN 1 ELSE 2 END + CASE WHEN p_partkey % 2 = 1 THEN 0 ELSE 1 END AS streams, 3 AS maps FROM part")
def dedup_streams(t):
    """Streams after the pass, the page's content among them; each font still has its map."""
    done = pdf.per_document(_rewritten(made(t("part"), _same_streams, "p_partkey", "p_name", "p_brand")), {"objects": ["kind"], "edges": ["path"]})
    maps = F.size(F.filter("edges", lambda x: F.get(x["path"], 0) == "/ToUnicode"))
    return _named(done.select("doc_id", F.size(F.filter("objects", lambda x: x["kind"] == "stream")).alias("streams"), maps.alias("maps")), "p_partkey")
