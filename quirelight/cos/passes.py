"""Rewrite passes over one document, in the order in which they run."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.images import MAX_DPI, SIDE, SKIP_QUALITY, TARGET_QUALITY, TINY
from . import content, fonts, images, jpeg
from .document import Document, children, rect
from .filters import filters_of
from .objects import Name, PdfError, Ref, Stream, number, unparse


@dataclass(frozen=True)
class Options:
    """remove_unused_fonts and strict_images differ from the plain rules: unused fonts go,
    and images are merged only if their dictionaries agree too."""

    lossy: bool = False
    strip_metadata: bool = True
    remove_unused_fonts: bool = False
    strict_images: bool = True


def _image_uses(doc: Document):
    """(page, name, reference, stream) for each use of an image in a page's own resources."""
    for _, page in doc.pages():
        xobjects = doc.dict_of(doc.dict_of(page.get("/Resources")).get("/XObject"))
        for name in sorted(xobjects):
            ref = xobjects[name]
            s = doc.get(ref)
            if isinstance(s, Stream) and s.dict.get("/Subtype") == "/Image":
                yield page, name, ref, s


def _images(doc: Document) -> list[tuple[Ref, Stream]]:
    return list({r: (r, s) for _, _, r, s in _image_uses(doc) if isinstance(r, Ref)}.values())


def _drop(d: dict, *keys: str) -> int:
    return sum(d.pop(k, None) is not None for k in keys)


def flatten_page_tree(doc: Document, o: Options) -> int:
    doc.push_inherited()
    return 0


def _annots(doc: Document, page: dict) -> list:
    a = doc.get(page.get("/Annots"))
    return a if isinstance(a, list) else []


def flatten_forms(doc: Document, o: Options) -> int:
    root = doc.root()
    if "/AcroForm" not in root:
        return 0
    edits = 0
    for ref, page in doc.pages():
        own = doc.objects.get(ref) if ref else None
        if not isinstance(own, dict):
            continue
        kept, stamps = [], []
        resources = dict(doc.dict_of(page.get("/Resources")))
        xobjects = dict(doc.dict_of(resources.get("/XObject")))
        for i, a in enumerate(_annots(doc, page)):
            d = doc.dict_of(a)
            flags = doc.get(d.get("/F", 0))
            look = doc.dict_of(d.get("/AP")).get("/N")
            box, form = rect(doc, d.get("/Rect")), doc.get(look)
            fine = d.get("/Subtype") == "/Widget" and isinstance(flags, int) and not flags & 35 and d.get("/FT") != "/Sig" and isinstance(form, Stream) and isinstance(look, Ref) and box
            m = _widget_matrix(doc, form, box) if fine else None
            if m is None:
                kept.append(a)
                continue
            form.dict[Name("/Type")], form.dict[Name("/Subtype")] = Name("/XObject"), Name("/Form")
            xobjects[Name(f"/FlatForm{i}")] = look
            stamps.append(b"q %s cm /FlatForm%d Do Q\n" % (" ".join(f"{v:.6g}" for v in m).encode(), i))
            edits += 1
        if stamps:
            resources[Name("/XObject")] = xobjects
            own[Name("/Resources")] = resources
            own[Name("/Annots")] = kept
            contents = doc.get(page.get("/Contents"))
            parts = list(contents) if isinstance(contents, list) else [page["/Contents"]] if "/Contents" in page else []
            own[Name("/Contents")] = [_new(doc, b"q\n"), *parts, _new(doc, b"\nQ\n" + b"".join(stamps))]
    return edits + _drop(root, "/AcroForm")


def _new(doc: Document, data: bytes) -> Ref:
    ref = Ref(max((r.num for r in doc.objects), default=0) + 1, 0)
    doc.objects[ref] = Stream({}, data)
    return ref


def _widget_matrix(doc: Document, form: Stream, r: list[float]) -> list[float] | None:
    """The same rule as functions.numbers.widget_matrix."""
    x0, x1 = sorted((r[0], r[2]))
    y0, y1 = sorted((r[1], r[3]))
    b = rect(doc, form.dict.get("/BBox")) or [0.0, 0.0, 1.0, 1.0]
    bw, bh = b[2] - b[0], b[3] - b[1]
    if x1 <= x0 or y1 <= y0 or abs(bw) < 1e-10 or abs(bh) < 1e-10:
        return None
    sx, sy = (x1 - x0) / bw, (y1 - y0) / bh
    tx, ty = x0 - b[0] * sx, y0 - b[1] * sy
    m = doc.get(form.dict.get("/Matrix"))
    m = [number(doc.get(v)) for v in m[:6]] if isinstance(m, list) and len(m) >= 6 else [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    if None in m or abs(det := m[0] * m[3] - m[1] * m[2]) < 1e-10:
        return [sx, 0.0, 0.0, sy, tx, ty]
    u, v, w, z, e, f = m
    return [z / det * sx, -v / det * sy, -w / det * sx, u / det * sy, (w * f - z * e) / det * sx + tx, (v * e - u * f) / det * sy + ty]


def strip_overhead(doc: Document, o: Options) -> int:
    root = doc.root()
    n = _drop(root, "/StructTreeRoot", "/OutputIntents", "/ViewerPreferences", "/Threads", "/SpiderInfo", "/PageMode", "/PageLayout", "/Dests")
    for _, page in _own_pages(doc):
        n += _drop(page, "/StructParents", "/StructParent", "/Tabs", "/PresSteps")
        n += _drop(doc.dict_of(page.get("/Resources")), "/ProcSet")
    return n + sum(_drop(x, "/Metadata") for x in doc.objects.values() if isinstance(x, dict) and x is not root)


def _own_pages(doc: Document) -> list[tuple[Ref, dict]]:
    """Pages' own dictionaries, which may be changed."""
    return [(r, x) for r, _ in doc.pages() if isinstance(x := doc.objects.get(r), dict)]


def dedup_images(doc: Document, o: Options) -> int:
    first: dict[tuple, Ref] = {}
    to: dict[Ref, Ref] = {}
    for ref, s in _images(doc):
        key = (hashlib.sha256(s.raw).digest(), unparse({k: v for k, v in s.dict.items() if k != "/Length"}) if o.strict_images else b"")
        canon = first.setdefault(key, ref)
        if canon != ref:
            to[ref] = canon
    n = 0
    for _, page in doc.pages():
        xobjects = doc.dict_of(doc.dict_of(page.get("/Resources")).get("/XObject"))
        for name, ref in xobjects.items():
            if isinstance(ref, Ref) and ref in to:
                xobjects[name] = to[ref]
                n += 1
    return n


def _replace(s: Stream, raw: bytes, filter_name: str | None) -> None:
    s.raw = raw
    _drop(s.dict, "/DecodeParms", "/Filter")
    if filter_name:
        s.dict[Name("/Filter")] = Name(filter_name)


def _side(doc: Document, s: Stream) -> tuple[int, int, int]:
    w, h, b = (doc.get(s.dict.get(k)) for k in ("/Width", "/Height", "/BitsPerComponent"))
    return (w, h, b) if all(isinstance(v, int) for v in (w, h, b)) else (0, 0, 0)


def _device(doc: Document, space) -> Name | None:
    """The device colour space that stands for an ICC profile."""
    x = doc.get(space)
    if isinstance(x, list) and len(x) >= 2 and doc.get(x[0]) == "/ICCBased":
        n = doc.get(doc.dict_of(x[1]).get("/N"))
        return {1: Name("/DeviceGray"), 3: Name("/DeviceRGB"), 4: Name("/DeviceCMYK")}.get(n)
    return None


def optimise_colours(doc: Document, o: Options) -> int:
    """ICC to device spaces, RGB that is gray to gray, gray that is black and white to one bit."""
    n = 0
    for _, s in _images(doc):
        if device := _device(doc, s.dict.get("/ColorSpace")):
            s.dict[Name("/ColorSpace")] = device
            n += 1
        w, h, bits = _side(doc, s)
        space = doc.get(s.dict.get("/ColorSpace"))
        if bits != 8 or w <= 0 or h <= 0:
            continue
        coded = {"/DCTDecode", "/DCT"} & set(filters_of(s.dict))
        pixels = jpeg.samples(doc, s) if not coded or space == "/DeviceGray" else None
        if pixels is None:
            continue
        if space == "/DeviceRGB" and len(pixels) == w * h * 3 and images.is_gray(pixels):
            pixels = pixels[::3]
            _replace(s, pixels, None)
            s.dict[Name("/ColorSpace")] = space = Name("/DeviceGray")
            n += 1
        if space == "/DeviceGray" and len(pixels) == w * h and not {"/SMask", "/Mask"} & s.dict.keys() and images.is_bitonal(pixels):
            packed = images.pack_bits(pixels, w, h)
            if len(packed) < len(s.raw):
                _replace(s, packed, None)
                s.dict[Name("/BitsPerComponent")] = 1
                _drop(s.dict, "/Predictor")
                n += 1
    for _, page in doc.pages():
        spaces = doc.dict_of(doc.dict_of(page.get("/Resources")).get("/ColorSpace"))
        for name, x in spaces.items():
            if device := _device(doc, x):
                spaces[name] = device
                n += 1
    return n


def _pixels(doc: Document, s: Stream) -> tuple[bytes, int, int, int, bool] | None:
    """(pixels, width, height, components, whether CMYK) of an 8-bit image that can be decoded."""
    w, h, bits = _side(doc, s)
    comps, cmyk = images.resolve_space(doc, s.dict.get("/ColorSpace"))
    if bits != 8 or not comps or not (0 < w <= SIDE and 0 < h <= SIDE):
        return None
    data = jpeg.samples(doc, s)
    return (data, w, h, comps, cmyk) if data is not None and len(data) == w * h * comps else None


def _as_jpeg(s: Stream, got: tuple, size: tuple[int, int] | None) -> bool:
    data, w, h, comps, cmyk = got
    if cmyk:
        data, comps = images.cmyk_to_rgb(data), 3
    if size:
        data, (w, h) = images.bilinear(data, w, h, comps, *size), size
    image = jpeg.coefficients(data, w, h, comps, TARGET_QUALITY)
    small = jpeg.smallest(image)
    if len(small) >= len(s.raw):
        return False
    _replace(s, small, "/DCTDecode")
    s.image = small, image, True
    s.dict |= {Name("/ColorSpace"): Name("/DeviceGray" if comps == 1 else "/DeviceRGB"), Name("/Width"): w, Name("/Height"): h}
    _drop(s.dict, "/Decode") if cmyk else None
    return True


def optimise_images(doc: Document, o: Options) -> int:
    n = 0
    for _, s in _images(doc) if o.lossy else ():
        w, h, _ = _side(doc, s)
        if w * h < TINY:
            continue
        if "/DCTDecode" in filters_of(s.dict):
            q = images.estimate_quality(s.raw)
            if 0 < q <= SKIP_QUALITY and not images.resolve_space(doc, s.dict.get("/ColorSpace"))[1]:
                continue
        if got := _pixels(doc, s):
            n += _as_jpeg(s, got, None)
    return n


def downscale_images(doc: Document, o: Options) -> int:
    if not o.lossy:
        return 0
    n, seen, sizes = 0, set(), {}
    for page, name, ref, s in _image_uses(doc):
        if ref in seen:
            continue
        seen.add(ref)
        w, h, bits = _side(doc, s)
        if bits != 8 or w <= 0 or h <= 0:
            continue
        if id(page) not in sizes:
            sizes[id(page)] = content.drawn_sizes(doc.contents(page))
        drawn = sizes[id(page)].get(name)
        if not drawn or not drawn[0] or not drawn[1]:
            box = rect(doc, page.get("/MediaBox"))
            drawn = (box[2] - box[0], box[3] - box[1]) if box else None
        if not drawn or drawn[0] <= 0 or drawn[1] <= 0:
            continue
        dpi = max(w / (drawn[0] / 72), h / (drawn[1] / 72))
        if dpi <= MAX_DPI:
            continue
        to = tuple(max(1, math.floor(v * MAX_DPI / dpi + 0.5)) for v in (w, h))
        if w - to[0] <= 1 and h - to[1] <= 1:
            continue
        if got := _pixels(doc, s):
            n += _as_jpeg(s, got, to)
    return n


def _lossless(doc: Document, streams) -> int:
    n = 0
    for s in streams:
        if filters_of(s.dict) == ["/DCTDecode"] and not (s.image and s.image[0] is s.raw and s.image[2]):
            try:
                small = jpeg.lossless(s.raw, jpeg.of(s))
            except (ValueError, KeyError, IndexError, struct.error):
                continue
            if len(small) < len(s.raw):
                s.raw = small
                n += 1
    return n


def optimise_jpegs(doc: Document, o: Options) -> int:
    return _lossless(doc, (s for _, s in _images(doc)))


def optimise_masks(doc: Document, o: Options) -> int:
    masks = {id(m): m for _, s in _images(doc) if isinstance(m := doc.get(s.dict.get("/SMask")), Stream)}
    return _lossless(doc, masks.values())


def _forms(doc: Document, resources: dict, seen: set) -> list[Stream]:
    """Form XObjects that resources reach, each once."""
    out, todo = [], [resources]
    while todo:
        for ref in doc.dict_of(todo.pop().get("/XObject")).values():
            s = doc.get(ref)
            if isinstance(s, Stream) and s.dict.get("/Subtype") == "/Form" and id(s) not in seen:
                seen.add(id(s))
                out.append(s)
                todo.append(doc.dict_of(s.dict.get("/Resources")))
    return out


def _font_usage(doc: Document) -> dict[Ref, list[bytes]]:
    """Strings shown with each font: in pages, nested forms, appearances and Type 3 glyphs."""
    out: dict[Ref, list[bytes]] = {}

    def scan(data: bytes, found: dict, given: dict) -> None:
        for name, strings in content.font_codes(data)[0].items():
            ref = found.get(name, given.get(name))
            if isinstance(ref, Ref):
                out.setdefault(ref, []).extend(strings)

    for _, page in doc.pages():
        resources = doc.dict_of(page.get("/Resources"))
        given = doc.dict_of(resources.get("/Font"))
        scan(doc.contents(page), given, {})
        seen: set = set()
        forms = _forms(doc, resources, seen)
        for a in _annots(doc, page):
            look = doc.get(doc.dict_of(doc.dict_of(a).get("/AP")).get("/N"))
            states = look.values() if isinstance(look, dict) else [look]
            for s in map(doc.get, states):
                if isinstance(s, Stream):
                    forms += [s, *_forms(doc, doc.dict_of(s.dict.get("/Resources")), seen)]
        for s in forms:
            scan(doc.data(s) or b"", doc.dict_of(doc.dict_of(s.dict.get("/Resources")).get("/Font")), given)
    return out


def optimise_fonts(doc: Document, o: Options) -> int:
    n = 0
    files: dict[Ref, tuple[set[int], bool]] = {}  # glyphs, whether a simple font needs the cmap
    bad: set[Ref] = set()
    usage = _font_usage(doc)
    for ref, x in doc.objects.items():
        d = x if isinstance(x, dict) else {}
        if d.get("/Type") != "/Font" and "/BaseFont" not in d or d.get("/Subtype") in ("/CIDFontType0", "/CIDFontType2"):
            continue
        strings = usage.get(ref, [])
        kind = d.get("/Subtype")
        if kind in ("/TrueType", "/Type1") and strings:
            codes = {c for s in strings for c in s}
            n += _trim_widths(doc, d, codes)
        if kind == "/TrueType":
            file = doc.dict_of(d.get("/FontDescriptor")).get("/FontFile2")
            if isinstance(file, Ref):
                _collect(doc, d, d, file, {c for s in strings for c in s}, False, files, bad)
        elif kind == "/Type0":
            below = doc.get(d.get("/DescendantFonts"))
            cid = doc.dict_of(below[0]) if isinstance(below, list) and below else {}
            cids = {s[i] << 8 | s[i + 1] for s in strings for i in range(0, len(s) - 1, 2)}
            plain = d.get("/Encoding") in ("/Identity-H", "/Identity-V")
            file = doc.dict_of(cid.get("/FontDescriptor")).get("/FontFile2")
            if isinstance(file, Ref):
                if plain and cid.get("/Subtype") == "/CIDFontType2":
                    _collect(doc, d, cid, file, cids, True, files, bad)
                else:
                    bad.add(file)
            if plain and strings:
                n += _trim_w(doc, cid, cids)
    for file, (gids, simple) in files.items():
        s = doc.objects.get(file)
        if file in bad or not isinstance(s, Stream) or (data := doc.data(s)) is None:
            continue
        try:
            small = fonts.TrueType(data).subset(gids, simple)
        except (ValueError, KeyError, struct.error, IndexError):
            continue
        if len(small) < len(data):
            _replace(s, small, None)
            s.dict[Name("/Length1")] = len(small)
            n += 1
    return n


def _collect(doc: Document, top: dict, d: dict, file: Ref, codes: set[int], cid: bool, files: dict, bad: set) -> None:
    """Adds the glyphs that a font's codes show; marks the file if they can't all be told."""
    name = str(doc.get(d.get("/BaseFont")) or "")
    subset = len(name) > 8 and name[7] == "+" and name[1:7].isalpha() and name[1:7].isupper()
    s = doc.objects.get(file)
    try:
        font = fonts.TrueType(doc.data(s) or b"") if isinstance(s, Stream) else None
    except (ValueError, KeyError, struct.error, IndexError):
        font = None
    if subset or font is None:
        bad.add(file)
        return
    gids, simple = files.get(file, (set(), False))
    if cid:
        m = doc.get(d.get("/CIDToGIDMap"))
        table = doc.data(m) or b"" if isinstance(m, Stream) else None
        found = codes if table is None else {struct.unpack_from(">H", table, 2 * c)[0] for c in codes if 2 * c + 2 <= len(table)}
        files[file] = (gids | set(found), simple)
        return
    found, mapped = set(), set()
    try:
        cmap, glyphs = font.cmap(), font.names()
    except struct.error:
        bad.add(file)
        return
    enc = doc.get(d.get("/Encoding"))
    base = enc if isinstance(enc, Name) else doc.get(enc.get("/BaseEncoding")) if isinstance(enc, dict) else None
    named = fonts.differences([doc.get(v) for v in doc.get(enc["/Differences"])]) if isinstance(enc, dict) and isinstance(doc.get(enc.get("/Differences")), list) else {}
    uni = doc.get(top.get("/ToUnicode"))
    told = fonts.to_unicode(doc.data(uni) or b"", codes) if isinstance(uni, Stream) else {}
    for c in codes:
        values = [told.get(c, 0), fonts.glyph_unicode(named[c]) if c in named else fonts.base_unicode(c, base), c, 0xF000 + c]
        hit = {cmap[v] for v in values if v in cmap} | ({glyphs[named[c]]} if named.get(c) in glyphs else set())
        found |= hit
        if hit:
            mapped.add(c)
    if mapped != codes:
        bad.add(file)
    files[file] = (gids | found, True)


def _trim_widths(doc: Document, d: dict, codes: set[int]) -> int:
    widths, first = doc.get(d.get("/Widths")), doc.get(d.get("/FirstChar"))
    if not isinstance(widths, list) or not isinstance(first, int):
        return 0
    new = fonts.trimmed_widths([doc.get(w) for w in widths], first, codes)
    if new is None:
        return 0
    d[Name("/Widths")], d[Name("/LastChar")] = new
    return 1


def _trim_w(doc: Document, cid: dict, cids: set[int]) -> int:
    w = doc.get(cid.get("/W"))
    if not isinstance(w, list):
        return 0
    flat = [[doc.get(v) for v in y] if isinstance(y := doc.get(x), list) else y for x in w]
    new = fonts.write_w({k: v for k, v in fonts.read_w(flat).items() if k in cids})
    if len(new) >= len(w):
        return 0
    cid[Name("/W")] = new
    return 1


CATEGORIES = ("/ExtGState", "/ColorSpace", "/Pattern", "/Shading", "/Properties")


def remove_unused(doc: Document, o: Options) -> int:
    """Resources that neither the page nor a form of it names. Each page gets its own copy."""
    n = 0
    for _, page in _own_pages(doc):
        resources = doc.dict_of(page.get("/Resources"))
        if not resources:
            continue
        used = content.used_names(doc.contents(page))
        for s in _forms(doc, resources, set()):
            used |= content.used_names(doc.data(s) or b"")
        resources = dict(resources)
        fonts_too = ("/Font",) if o.remove_unused_fonts and not _annots(doc, page) else ()
        for category in (*CATEGORIES, *fonts_too):
            d = doc.dict_of(resources.get(category))
            kept = {k: v for k, v in d.items() if k in used}
            n += len(d) - len(kept)
            if len(kept) < len(d):
                resources[Name(category)] = kept
        d = doc.dict_of(resources.get("/XObject"))
        name_of = {v: k for k, v in sorted(d.items(), reverse=True) if isinstance(v, Ref)}  # the first of several
        todo, kept = [k for k in d if k in used], set()
        while todo:  # masks that a used image refers to, and theirs
            k = todo.pop()
            if k not in kept:
                kept.add(k)
                x = doc.dict_of(d[k])
                todo += [name_of[x[m]] for m in ("/SMask", "/Mask") if isinstance(x.get(m), Ref) and x[m] in name_of]
        if len(kept) < len(d):
            n += len(d) - len(kept)
            resources[Name("/XObject")] = {k: v for k, v in d.items() if k in kept}
        page[Name("/Resources")] = {k: v for k, v in resources.items() if not isinstance(v, dict) or v}
    return n


def coalesce_contents(doc: Document, o: Options) -> int:
    n = 0
    for _, page in _own_pages(doc):
        x = doc.get(page.get("/Contents"))
        if isinstance(x, list) and len(x) > 1 and all(isinstance(s := doc.get(v), Stream) and doc.data(s) is not None for v in x):
            page[Name("/Contents")] = _new(doc, doc.contents(page))
            n += 1
    return n


def minify_contents(doc: Document, o: Options) -> int:
    n, seen = 0, set()
    for _, page in _own_pages(doc):
        s = doc.get(page.get("/Contents"))
        for s in map(doc.get, s) if isinstance(s, list) else [s]:
            if not isinstance(s, Stream) or id(s) in seen or isinstance(doc.get(page.get("/Contents")), list) and len(doc.get(page["/Contents"])) > 1:
                continue
            seen.add(id(s))
            data = doc.data(s)
            if data is not None and len(small := content.minify(data)) < len(data):
                _replace(s, small, None)
                n += 1
    return n


def dedup_streams(doc: Document, o: Options) -> int:
    pictures = {r for r, _ in _images(doc)}
    first: dict[tuple, Ref] = {}
    to: dict[Ref, Ref] = {}
    for ref, s in doc.objects.items():
        if isinstance(s, Stream) and ref not in pictures and s.raw:
            key = (hashlib.sha256(s.raw).digest(), *(unparse(doc.get(s.dict.get(k))) for k in ("/Filter", "/DecodeParms", "/Type", "/Subtype")))
            if (canon := first.setdefault(key, ref)) != ref:
                to[ref] = canon
    n = 0
    for x in doc.objects.values():
        d = x.dict if isinstance(x, Stream) else x
        if isinstance(d, dict):
            for k, v in d.items():
                if isinstance(v, Ref) and v in to:
                    d[k] = to[v]
                    n += 1
    return n


def strip_embedded(doc: Document, o: Options) -> int:
    root = doc.root()
    names = doc.get(root.get("/Names"))
    if not isinstance(names, dict):
        return 0
    n = _drop(names, "/EmbeddedFiles")
    return n + (_drop(root, "/Names") if not names else 0)


def _script(doc: Document, x) -> bool:
    return doc.dict_of(x).get("/S") == "/JavaScript"


def strip_javascript(doc: Document, o: Options) -> int:
    root = doc.root()
    n = _drop(root, "/AA") + (_drop(root, "/OpenAction") if _script(doc, root.get("/OpenAction")) else 0)
    names = doc.get(root.get("/Names"))
    n += _drop(names, "/JavaScript") if isinstance(names, dict) else 0
    for _, page in _own_pages(doc):
        n += _drop(page, "/AA")
        for a in _annots(doc, page):
            d = doc.get(a)
            if isinstance(d, dict):
                n += _drop(d, "/AA") + (_drop(d, "/A") if _script(doc, d.get("/A")) else 0)
    return n


def strip_metadata(doc: Document, o: Options) -> int:
    if not o.strip_metadata:
        return 0
    n = _drop(doc.root(), "/Metadata", "/MarkInfo") + _drop(doc.trailer, "/Info")
    return n + sum(_drop(page, "/Metadata", "/PieceInfo", "/Thumb") for _, page in _own_pages(doc))


PASSES: list[tuple[str, Callable[[Document, Options], int]]] = [
    (f.__name__, f)
    for f in (
        flatten_page_tree, flatten_forms, strip_overhead, dedup_images, optimise_colours, optimise_images, downscale_images, optimise_jpegs, optimise_masks,
        optimise_fonts, remove_unused, coalesce_contents, minify_contents, dedup_streams, strip_embedded, strip_javascript, strip_metadata,
    )
]


def compress(data: bytes, o: Options = Options()) -> tuple[bytes | None, str, dict[str, int]]:
    """(file, status, edits by pass). status: ok, repaired, encrypted, empty, not_pdf or failed;
    a pass that fails on a document is noted with -1, changes nothing, and leaves the others to run."""
    if not data:
        return None, "empty", {}
    try:
        doc = Document.read(data)
    except (PdfError, RecursionError, struct.error):
        return None, "not_pdf", {}
    if doc.status == "encrypted":
        return None, "encrypted", {}
    edits: dict[str, int] = {}
    again = True
    while again:  # a pass that fails may have changed something, so the file is read again, and the pass left out
        again, left_out = False, [k for k, n in edits.items() if n < 0]
        for name, f in PASSES:
            try:
                edits[name] = -1 if name in left_out else f(doc, o)
            except (PdfError, ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, struct.error, OverflowError):
                edits = {k: -1 for k in [*left_out, name]}
                doc, again = Document.read(data), True
                break
    edits = {name: edits[name] for name, _ in PASSES}
    try:
        return doc.write(data), doc.status, edits
    except (PdfError, ValueError, TypeError, RecursionError):
        return None, "failed", edits


__all__ = ["PASSES", "Options", "children", "compress"]
