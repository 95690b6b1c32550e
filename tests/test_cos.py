"""The PDF layer: reading, writing, and kernels."""

import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quirelight.cos import content, fonts, images, jpeg
from quirelight.cos.document import Document
from quirelight.cos.filters import decode, lzw
from quirelight.cos.objects import Name, PdfError, Real, Ref, Stream, parse, unparse
from quirelight.cos.passes import Options, compress
from quirelight.functions.encodings import glyph_names, macroman, winansi
from quirelight.sources.synthetic import of_texts, plain_file

N = Name


def file(objects, trailer=None):
    return plain_file(objects, trailer or {N("/Root"): Ref(1, 0)})


def one_page(page=None, content_=b"BT ET", more=None, root=None):
    objects = {
        1: {N("/Type"): N("/Catalog"), N("/Pages"): Ref(2, 0)} | (root or {}),
        2: {N("/Type"): N("/Pages"), N("/Kids"): [Ref(3, 0)], N("/Count"): 1},
        3: {N("/Type"): N("/Page"), N("/Parent"): Ref(2, 0), N("/MediaBox"): [0, 0, 100, 100], N("/Contents"): Ref(4, 0)} | (page or {}),
        4: Stream({}, content_),
    }
    return file(objects | (more or {}))


def reread(data, **options):
    out, status, edits = compress(data, Options(**options))
    assert out is not None and -1 not in edits.values(), (status, edits)
    return Document.read(out), edits


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=8) | st.builds(lambda s: N("/" + s), st.text("abc#/ é", max_size=5)) | st.builds(Ref, st.integers(0, 99), st.integers(0, 9)),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.builds(lambda s: N("/" + s), st.text("ab", min_size=1, max_size=3)), v.filter(lambda x: x is not None), max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_values_survive(x):
    assert parse(unparse(x) + b" ")[0] == x


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"(", b")", b"<", b">", b"<<", b">>", b"[", b"]", b"/A", b"1", b"0.50", b" ", b"\n", b"\x0c", b"\x0b", b"%c\n", b"BI ", b"ID ", b" EI", b"q ", b"Do ", b"\\", b"{", b"}", b"R", b"obj"])).map(b"".join))
def test_all_input_ends(data):
    parse(data)
    small = content.minify(data)
    assert len(small) <= len(data)
    assert list(content.tokens(content.minify(small))) == list(content.tokens(small)) or len(content.minify(small)) < len(small)
    content.used_names(data), content.drawn_sizes(data), content.font_codes(data)


@pytest.mark.parametrize(
    "a,b",
    [
        (b"1.50 0.0 -0.0 +0.50 00.5 5. .0 cm\n", b"1.5 0 -0 +0.5 00.5 5 0 cm"),
        (b"q % note\n 1 0 0 1 0 0 cm  Q", b"q 1 0 0 1 0 0 cm Q"),
        (b"( a (b) \\) )  Tj", b"( a (b) \\) )Tj"),
        (b"<41 42>  Tj\n", b"<4142>Tj"),
        (b"<< /A  [ 1  2 ] >> BDC\x0cEMC", b"<</A[1 2]>>BDC EMC"),
        (b"BI  /W 1 ID \x00 EI\x01  EI   Q  ", b"BI/W 1 ID \x00 EI\x01  EI Q"),
    ],
)
def test_minify(a, b):
    got = content.minify(a)
    plain = lambda d: [(k, content.trim_number(t) if k == "word" and re.fullmatch(rb"[+-]?[\d.]+", t) else t) for k, t in content.tokens(d)]
    assert plain(got) == plain(a) and len(got) <= len(b) + 3


NUMBERS = {"1.50": "1.5", "5.": "5", "0.0": "0", ".0": "0", "-.0": "0", "-0.0": "-0", "+0.50": "+0.5", "00.5": "00.5", "0.25": ".25", "-0.25": "-.25", "100": "100", "10.0": "10"}


def test_numbers(spark):
    from pyspark.sql import functions as F
    from quirelight.functions.numbers import parse_number, trim_number

    df = spark.createDataFrame([(k,) for k in NUMBERS], "s string").select("s", trim_number(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == NUMBERS
    assert {k: content.trim_number(k.encode()).decode() for k in NUMBERS} == NUMBERS
    cases = {"1.2abc": 1.2, "x": 0.0, "-.5": -0.5, "": 0.0, "1e2": 100.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse_number(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def test_encodings(spark):
    from quirelight.functions.encodings import glyph_unicode

    assert (winansi(0x80), winansi(0x81), winansi(0xE9), macroman(0x8E), macroman(0xDB), macroman(0xFF)) == (0x20AC, 0x81, 0xE9, 0xE9, 0x20AC, 0x2C7)
    names = glyph_names()
    assert len(names) == 268 and names["Gcommaaccent"] == 0x122 and names["Scedilla"] == 0x15E and names["ydieresis"] == 0xFF and names["caron"] if "caron" in names else True
    cases = {"uni20AC": 0x20AC, "u20AC": 0x20AC, "u1F600": 0, "A": 65, "eacute.alt": 0xE9, "nothing": 0, "uni00": 0, "union": 0, ".notdef": 0}
    got = {r["name"]: r["unicode"] for r in glyph_unicode(spark.createDataFrame([(k,) for k in cases], "name string")).collect()}
    assert got == cases and {k: fonts.glyph_unicode(k) for k in cases} == cases


def test_damaged_files():
    good = of_texts(["Hello"], True, False)
    shown = lambda d: [op for op, _ in content.operations(d.contents(d.pages()[0][1]))]
    for bad in (good, good.replace(b"startxref\n", b"startxref\n99"), good[: good.rfind(b"xref")], re.sub(rb"(?m)^0000000(\d\d\d) ", rb"0000009\1 ", good), b"junk" + good, good.replace(b"/Length", b"/Langth"), good[: good.find(b"trailer")]):
        doc, _ = reread(bad)
        assert shown(doc) == ["BT", "Tf", "Tj", "ET"] and "/Info" not in doc.trailer
    assert Document.read(good).status == "ok" and Document.read(good[:-30]).status == "repaired"
    for bad, status in ((b"", "empty"), (b"this is not a PDF file at all", "not_pdf"), (file({1: {N("/Type"): N("/Catalog")}}, {N("/Root"): Ref(1, 0), N("/Encrypt"): {}}), "encrypted")):
        assert compress(bad)[:2] == (None, status)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_damage_ends(data):
    good = bytearray(of_texts(["Hello there"], True, True))
    for _ in range(data.draw(st.integers(0, 6))):
        at = data.draw(st.integers(0, len(good) - 1))
        good[at : at + data.draw(st.integers(0, 9))] = data.draw(st.binary(max_size=5))
    compress(bytes(good))


def test_output_is_stable_and_smaller():
    data = of_texts(["some text " * 50] * 4, True, False)
    out, _, edits = compress(data)
    assert out == compress(data)[0] and len(out) < len(data) and out.startswith(b"%PDF-") and b"%%EOF" in out[-8:]
    assert edits["dedup_streams"] == 3 and edits["strip_metadata"] == 1 and edits["strip_overhead"] > 0
    kept, _, _ = compress(data, Options(strip_metadata=False))
    assert len(kept) > len(out)
    assert abs(len(compress(out)[0]) - len(out)) < 0.05 * len(out)


def image(w, h, space, raw, **more):
    return Stream({N("/Subtype"): N("/Image"), N("/Width"): w, N("/Height"): h, N("/BitsPerComponent"): 8, N("/ColorSpace"): space} | {N(f"/{k}"): v for k, v in more.items()}, raw)


def with_images(images_, content_=None):
    names = {N(f"/I{i}"): Ref(10 + i, 0) for i in range(len(images_))}
    draw = content_ or b"".join(b"q 50 0 0 50 0 0 cm %s Do Q\n" % n.encode() for n in names)
    return one_page({N("/Resources"): {N("/XObject"): names}}, draw, {10 + i: s for i, s in enumerate(images_)})


def found(doc):
    page = doc.pages()[0][1]
    x = doc.dict_of(doc.dict_of(page["/Resources"])["/XObject"])
    return {k: doc.get(v) for k, v in x.items()}


def test_colours():
    r = np.random.default_rng(0)
    gray = np.repeat(r.integers(40, 200, (40, 40, 1)), 3, 2).astype(np.uint8).tobytes()
    white = r.choice([0, 10, 32, 224, 255], (40, 40)).astype(np.uint8).tobytes()
    almost = white[:-1] + bytes([33])
    icc = Stream({N("/N"): 3}, b"p" * 50)
    odd = Stream({N("/N"): 2}, b"p" * 50)
    data = with_images([image(40, 40, N("/DeviceRGB"), gray), image(40, 40, N("/DeviceGray"), white), image(40, 40, N("/DeviceGray"), almost), image(40, 40, [N("/ICCBased"), Ref(30, 0)], bytes(range(160)) * 30), image(40, 40, N("/DeviceGray"), white, SMask=Ref(11, 0)), image(40, 40, [N("/ICCBased"), Ref(31, 0)], b"x" * 3200)])
    doc = Document.read(data)
    doc.objects |= {Ref(30, 0): icc, Ref(31, 0): odd}
    got = found(reread(doc.write())[0])
    assert [(got[f"/I{i}"].dict["/ColorSpace"], got[f"/I{i}"].dict["/BitsPerComponent"]) for i in range(3)] == [("/DeviceGray", 8), ("/DeviceGray", 1), ("/DeviceGray", 8)]
    assert got["/I3"].dict["/ColorSpace"] == "/DeviceRGB" and got["/I4"].dict["/BitsPerComponent"] == 8 and isinstance(got["/I5"].dict["/ColorSpace"], list)


def test_dedup_images():
    a = image(2, 2, N("/DeviceGray"), b"\1\2\3\4" * 50)
    same, other = image(2, 2, N("/DeviceGray"), a.raw), image(4, 1, N("/DeviceGray"), a.raw)
    doc, edits = reread(with_images([a, same, other]))
    x = doc.dict_of(doc.dict_of(doc.pages()[0][1]["/Resources"])["/XObject"])
    assert edits["dedup_images"] == 1 and x["/I0"] == x["/I1"] != x["/I2"]
    doc, edits = reread(with_images([a, same, other]), strict_images=False)
    assert edits["dedup_images"] == 2


def test_lossy():
    y, x = np.mgrid[0:200, 0:200]
    rgb = np.stack([x, y, (x + y) // 2], 2).astype(np.uint8).tobytes()
    cmyk = np.stack([x, y, x, y // 4], 2).astype(np.uint8).tobytes()
    data = with_images([image(200, 200, N("/DeviceRGB"), rgb), image(200, 200, N("/DeviceCMYK"), cmyk)])
    plain, _ = reread(data)
    doc, edits = reread(data, lossy=True)
    got = found(doc)
    assert got["/I0"].dict["/Width"] == 50 and got["/I0"].dict["/Filter"] == "/DCTDecode" and got["/I1"].dict["/ColorSpace"] == "/DeviceRGB"
    assert len(doc.write()) < len(plain.write()) and edits["downscale_images"] == 2


@pytest.mark.parametrize("q", [1, 50, 65, 66, 75, 100])
def test_jpeg(q):
    r = np.random.default_rng(q)
    px = np.clip(r.normal(128, 30, (37, 50)).cumsum(1) / 8, 0, 255).astype(np.uint8).tobytes()
    data = jpeg.encode(px, 50, 37, 1, q)
    assert images.estimate_quality(data) == q
    again = jpeg.read(jpeg.lossless(data))
    assert all((a.blocks == b.blocks).all() for a, b in zip(again.comps, jpeg.read(data).comps))
    if q == 100:
        assert np.abs(np.frombuffer(again.pixels(), np.uint8).astype(int) - np.frombuffer(px, np.uint8)).max() < 6
    noisy = bytearray(data)
    at = noisy.find(b"\xff\xdb") + 5
    noisy[at : at + 4] = b"\xff\xff\xff\xff"
    assert images.estimate_quality(bytes(noisy)) in (-1, q, *range(1, 101)) and images.estimate_quality(b"no") == -1


def java_jpeg(spark, pixels, progressive):
    """A file that the JVM's own writer makes of gray (h, w) or RGB (h, w, 3) pixels."""
    jvm = spark._jvm
    io, kinds = jvm.javax.imageio, jvm.java.awt.image.BufferedImage
    h, w = pixels.shape[:2]
    picture = kinds(w, h, kinds.TYPE_BYTE_GRAY if pixels.ndim == 2 else kinds.TYPE_INT_RGB)
    raster = picture.getRaster()
    for b in range(1 if pixels.ndim == 2 else 3):
        plane = pixels if pixels.ndim == 2 else pixels[:, :, b]
        for y in range(h):
            for x in range(w):
                raster.setSample(x, y, b, int(plane[y, x]))
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(io.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(picture, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def java_pixels(spark, data):
    raster = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data)).getRaster()
    w, h, n = raster.getWidth(), raster.getHeight(), raster.getNumBands()
    return np.array([[[raster.getSample(x, y, b) for b in range(n)] for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("colour", [False, True])
def test_progressive_jpeg(spark, colour):
    r = np.random.default_rng(3)
    px = np.clip(r.normal(0, 12, (21, 27, 3)).cumsum(1).cumsum(0) / 3 + 128, 0, 255).astype(np.uint8)
    px = px if colour else px[:, :, 0]
    plain, data = java_jpeg(spark, px, False), java_jpeg(spark, px, True)
    assert b"\xff\xc2" in data and data.count(b"\xff\xda") > 3
    one, many = jpeg.read(plain), jpeg.read(data)
    assert one.pixels() == many.pixels()
    if not colour:
        assert np.abs(java_pixels(spark, data).reshape(-1) - np.frombuffer(many.pixels(), np.uint8).astype(int)).max() <= 1
    for progressive in (False, True):
        again = jpeg.write(many, progressive)
        assert jpeg.read(again).pixels() == many.pixels() and (java_pixels(spark, again) == java_pixels(spark, data)).all()
    assert len(jpeg.lossless(data)) <= len(data)
    for stop in range(0, len(data), 40):  # a file that ends early, or is damaged, is refused or read, never loops
        for broken in (data[:stop], data[:stop] + b"\x55" + data[stop + 1 :]):
            try:
                jpeg.read(broken)
            except (ValueError, KeyError, IndexError, struct.error):
                pass


def test_best_script_and_restarts():
    noisy = np.random.default_rng(0).integers(0, 256, (96, 96, 3)).astype(np.uint8).tobytes()
    image = jpeg.read(jpeg.encode(noisy, 96, 96, 3, 90))
    assert len(jpeg.smallest(image)) == min(len(jpeg.write(image)), len(jpeg.write(image, True)))
    one = jpeg.write(jpeg.read(jpeg.encode(bytes(range(64)), 8, 8, 1, 100)))
    frame, scan = one.find(b"\xff\xc0"), one.find(b"\xff\xda") + 10
    wide = one[:frame] + b"\xff\xdd\0\4\0\1" + one[frame : frame + 7] + b"\0\x10" + one[frame + 9 : -2] + b"\xff\xd0" + one[scan:]
    both = jpeg.read(wide)
    assert (both.width, both.restart) == (16, 1) and (both.comps[0].blocks[0, 0] == both.comps[0].blocks[0, 1]).all()


def test_quality_of_columns_equals_the_kernels(spark):
    from pyspark.sql import functions as F
    from quirelight.functions.images import estimate_quality

    rows = [(q, images.luminance_table(jpeg.encode(bytes(64), 8, 8, 1, q))) for q in range(1, 101, 7)] + [(-1, [255] * 64), (-1, None)]
    got = spark.createDataFrame(rows, "q int, t array<int>").where("t IS NOT NULL").select("q", estimate_quality(F.col("t")).alias("e")).collect()
    assert all(r["q"] == r["e"] or r["q"] == -1 for r in got)


def test_filters():
    assert decode({N("/Filter"): [N("/ASCIIHexDecode"), N("/FlateDecode")]}, zlib.compress(b"x" * 9).hex().encode() + b">")[0] == b"x" * 9
    assert decode({N("/Filter"): N("/ASCII85Decode")}, b"87cURD]i,\"Ebo80~>")[0] == b"Hello World!"
    assert decode({N("/Filter"): N("/RunLengthDecode")}, b"\x02abc\xfez\x80")[0] == b"abczzz"
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = np.arange(40, dtype=np.uint8).reshape(4, 10)
    up = b"".join(b"\x02" + (rows[i] - (rows[i - 1] if i else 0)).astype(np.uint8).tobytes() for i in range(4))
    parms = {N("/Predictor"): 12, N("/Columns"): 10}
    assert decode({N("/Filter"): N("/FlateDecode"), N("/DecodeParms"): parms}, zlib.compress(up))[0] == rows.tobytes()
    assert decode({N("/Filter"): N("/FlateDecode")}, zlib.compress(rows.tobytes() * 9)[:-6])[0][:9] == rows.tobytes()[:9]
    with pytest.raises(PdfError):
        decode({N("/Filter"): N("/Odd")}, b"")


def widget(**more):
    return {N("/Subtype"): N("/Widget"), N("/Rect"): [10, 10, 30, 20], N("/AP"): {N("/N"): Ref(20, 0)}} | {N(f"/{k}"): v for k, v in more.items()}


def test_forms():
    form = Stream({N("/BBox"): [0, 0, 10, 5]}, b"f")
    turned = Stream({N("/BBox"): [0, 0, 10, 5], N("/Matrix"): [0, 1, -1, 0, 0, 0]}, b"g")
    annots = [widget(), widget(F=2), widget(F=32), widget(FT=N("/Sig")), widget(AP={N("/N"): {N("/Off"): Ref(20, 0)}}), widget(Rect=[30, 20, 10, 10]), widget(AP={N("/N"): Ref(21, 0)}), widget(Rect=[1, 1, 1, 5])]
    doc, edits = reread(one_page({N("/Annots"): annots}, b"BT ET", {20: form, 21: turned}, {N("/AcroForm"): {}}))
    page = doc.pages()[0][1]
    assert edits["flatten_forms"] == 4 and len(page["/Annots"]) == 5 and "/AcroForm" not in doc.root()
    ops = list(content.operations(doc.contents(page)))
    matrices = [[float(v) for v in x] for op, x in ops if op == "cm"]
    assert matrices[:2] == [[2, 0, 0, 2, 10, 10]] * 2 and matrices[2] == [0, -2, 2, 0, 10, 10]
    assert sum(op == "Do" for op, _ in ops) == 3


def test_scripts_files_and_overhead():
    js = {N("/S"): N("/JavaScript"), N("/JS"): b"x"}
    root = {N("/OpenAction"): js, N("/AA"): {}, N("/Names"): {N("/JavaScript"): {}, N("/EmbeddedFiles"): {}, N("/Dests"): {}}, N("/StructTreeRoot"): {}, N("/MarkInfo"): {}, N("/Lang"): b"en"}
    page = {N("/AA"): {}, N("/Tabs"): N("/S"), N("/Thumb"): 1, N("/Annots"): [{N("/Subtype"): N("/Link"), N("/A"): js}, {N("/Subtype"): N("/Link"), N("/A"): {N("/S"): N("/URI")}}]}
    doc, _ = reread(one_page(page, root=root))
    assert set(doc.root()) == {"/Type", "/Pages", "/Names", "/Lang"} and set(doc.root()["/Names"]) == {"/Dests"}
    got = doc.pages()[0][1]
    assert not {"/AA", "/Tabs", "/Thumb"} & set(got) and ["/A" in a for a in got["/Annots"]] == [False, True]
    doc, _ = reread(one_page(root={N("/OpenAction"): {N("/S"): N("/GoTo")}, N("/Names"): {N("/EmbeddedFiles"): {}}}))
    assert "/OpenAction" in doc.root() and "/Names" not in doc.root()


def test_unused_resources_keep_masks():
    im = lambda **m: image(1, 1, N("/DeviceGray"), b"\x80", **m)
    x = {N("/A"): Ref(10, 0), N("/M"): Ref(11, 0), N("/K"): Ref(12, 0), N("/U"): Ref(13, 0)}
    res = {N("/XObject"): x, N("/ExtGState"): {N("/G1"): {}, N("/G2"): {}}, N("/Font"): {N("/F1"): {}, N("/F2"): {}}}
    data = one_page({N("/Resources"): res}, b"/G1 gs /A Do BT /F1 9 Tf ET", {10: im(SMask=Ref(11, 0)), 11: im(Mask=Ref(12, 0)), 12: im(), 13: im()})
    doc, _ = reread(data)
    r = doc.dict_of(doc.pages()[0][1]["/Resources"])
    assert set(r["/XObject"]) == {"/A", "/M", "/K"} and set(r["/ExtGState"]) == {"/G1"} and set(r["/Font"]) == {"/F1", "/F2"}
    doc, _ = reread(data, remove_unused_fonts=True)
    assert set(doc.dict_of(doc.pages()[0][1]["/Resources"])["/Font"]) == {"/F1"}


def true_type():
    """Five glyphs: 1 to 3 simple, 4 made of 1 and 3; A to D mapped to 1 to 4."""
    simple = lambda k: struct.pack(">hhhhh", 1, 0, 0, 9, 9) + bytes([k]) * 30
    whole = struct.pack(">hhhhh", -1, 0, 0, 9, 9) + struct.pack(">HHBB", 0x20, 1, 0, 0) + struct.pack(">HHBB", 0, 3, 0, 0)
    glyphs = [b"", simple(1), simple(2), simple(3), whole]
    loca = [0]
    for g in glyphs:
        loca.append(loca[-1] + len(g) + len(g) % 2)
    body = b"".join(g + b"\0" * (len(g) % 2) for g in glyphs)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">HHHHHhhHH", 68, 0xFFFF, 0, 65, 0xFFFF, -64, 1, 0, 0)
    tables = {"head": bytes(50) + b"\0\0\0\0", "maxp": struct.pack(">IH", 0x10000, 5), "loca": struct.pack(">6H", *(v // 2 for v in loca)), "glyf": body, "cmap": cmap, "GPOS": bytes(60)}
    out, at = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), 12 + 16 * len(tables)
    data = b""
    for tag, t in sorted(tables.items()):
        out += struct.pack(">4sIII", tag.encode(), 0, at + len(data), len(t))
        data += t + b"\0" * (-len(t) % 4)
    return out + data


def test_true_type():
    f = fonts.TrueType(true_type())
    assert f.cmap() == {65: 1, 66: 2, 67: 3, 68: 4} and f.closure({4}) == {0, 1, 3, 4}
    small = fonts.TrueType(f.subset({4}, True))
    assert small.glyphs == 5 and "GPOS" not in small.tables and small.cmap() == f.cmap()
    assert [small.loca[i + 1] > small.loca[i] for i in range(5)] == [False, True, False, True, True]


def test_fonts():
    def simple(name, **more):
        return {N("/Type"): N("/Font"), N("/Subtype"): N("/TrueType"), N("/BaseFont"): N(name), N("/FirstChar"): 65, N("/Widths"): [500, 600, 700, 800], N("/FontDescriptor"): {N("/FontFile2"): Ref(30, 0)}} | more

    def run(second, text=b"/F1 9 Tf (A) Tj /F2 9 Tf (B) Tj"):
        return reread(one_page({N("/Resources"): {N("/Font"): {N("/F1"): Ref(20, 0), N("/F2"): Ref(21, 0)}}}, b"BT " + text + b" ET", {20: simple("/One"), 21: second, 30: Stream({}, true_type())}))

    doc, edits = run(simple("/Two"))
    f = doc.dict_of(doc.dict_of(doc.pages()[0][1]["/Resources"])["/Font"])
    a, b = doc.dict_of(f["/F1"]), doc.dict_of(f["/F2"])
    assert a["/Widths"] == [500] and a["/LastChar"] == 65 and b["/Widths"] == [0, 600] and edits["optimise_fonts"] == 3
    file_ = fonts.TrueType(doc.data(doc.get(doc.dict_of(a["/FontDescriptor"])["/FontFile2"])))
    assert [file_.loca[i + 1] > file_.loca[i] for i in range(5)] == [False, True, True, False, False]  # both fonts' glyphs
    assert run(simple("/ABCDEF+Two"))[1]["optimise_fonts"] == 2  # a subset already: the file stays
    assert run(simple("/Two"), b"/F1 9 Tf (AZ) Tj")[1]["optimise_fonts"] == 1  # Z has no glyph: the file stays


def test_font_tables():
    cmap = b"2 beginbfchar <41> <0061> <42> <00010062> endbfchar 3 beginbfrange <43> <45> <0100> <46> <47> [<01> <02>] <FFFE> <FFFF> <FFFF> endbfrange"
    assert fonts.to_unicode(cmap, set(range(256)) | {0xFFFF}) == {0x41: 0x61, 0x42: 0x62, 0x43: 0x100, 0x44: 0x101, 0x45: 0x102, 0x46: 1, 0x47: 2, 0xFFFF: 0}
    assert fonts.differences([5, N("/a"), N("/b"), 5, N("/c")]) == {5: "c", 6: "b"}
    w = fonts.read_w([1, [10, 20], 5, 7, 30, 9])
    assert w == {1: 10, 2: 20, 5: 30, 6: 30, 7: 30} and fonts.write_w(w) == [1, [10, 20], 5, [30, 30, 30]]
    assert fonts.trimmed_widths([1, 2, Real("3.5"), 4], 10, {11, 12}) == ([0, 2, Real("3.5")], 12)
    assert fonts.trimmed_widths([1], 10, {10}) is None and fonts.trimmed_widths([1], 10, set()) == ([], 9)


def test_drawn_sizes(spark):
    from pyspark.sql import functions as F
    from quirelight.functions.numbers import fold_matrix, largest_use

    data = b"q 2 0 0 2 0 0 cm q 0 30 -40 0 0 0 cm /A Do Q /B Do Q /A Do Q /B Do"
    assert content.drawn_sizes(data) == {"/A": (80.0, 60.0), "/B": (2.0, 2.0)}
    ops = [(op, x[-1] if op == "Do" else None, [float(v) for v in x] if op == "cm" else None) for op, x in content.operations(data)]
    df = spark.createDataFrame([(ops,)], "ops array<struct<op:string,name:string,m:array<double>>>")
    got = df.select(largest_use(fold_matrix(F.col("ops"))).alias("u")).first()["u"]
    assert {r["name"]: (r["w"], r["h"]) for r in got} == content.drawn_sizes(data)


def test_pixels():
    assert images.pack_bits(bytes([255, 0, 255, 0, 0, 0, 0, 255, 255]) * 2, 9, 2) == b"\xa1\x80" * 2
    assert images.cmyk_to_rgb(bytes([0, 255, 100, 51])) == bytes([204, 0, 124])
    assert images.bilinear(bytes([0, 100, 200, 50]), 2, 2, 1, 1, 1) == b"\0"
    assert images.bilinear(bytes(range(9)), 3, 3, 1, 2, 2) == bytes([0, 2, 5, 6])


def test_a_pass_that_fails_changes_nothing(monkeypatch):
    from quirelight.cos import passes
    from quirelight.sources.synthetic import of_texts

    def half(doc, o):
        for x in doc.objects.values():
            if isinstance(x, dict):
                x["/Spoilt"] = 1
        raise ValueError

    data = of_texts(["one", "two"], True, False)
    want = passes.compress(data)
    monkeypatch.setattr(passes, "PASSES", [*passes.PASSES[:3], ("half", half), *passes.PASSES[3:]])
    got = passes.compress(data)
    assert got[0] == want[0] and got[2] == want[2] | {"half": -1} and b"Spoilt" not in got[0]


def test_a_stream_that_is_too_large(monkeypatch):
    import zlib

    from quirelight.cos import filters
    from quirelight.cos.objects import PdfError

    monkeypatch.setattr(filters, "MOST", 100_000)
    assert len(filters.flate(zlib.compress(bytes(100_000)))) == 100_000
    with pytest.raises(PdfError):
        filters.flate(zlib.compress(bytes(200_000_000)))
