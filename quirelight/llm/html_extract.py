"""The main text of web pages: composite text density over the DOM.

A forgiving parser makes the DOM. Scripts, styles, controls and what is hidden leave no
text. For every node the characters per tag are computed and adjusted for links:

    density = C/T * ln(C/LC * T/LT) / ln ln(C/(C-LC) * LC + LCb/Cb * C + e)

with characters C, tags T, link characters LC and link tags LT of its subtree, and those
of the body for b. The node whose children's densities have the largest sum is the core
of the article. The least density on the way from it to the body is the threshold:
beside the core those subtrees belong to the text that hang on this way and are no less
dense.

Elements named as menu, footer, advert, notice, comment and so on are suspects. A name
alone silences nothing: a suspect counts as noise, and adds nothing to densities, while it
holds little of the page's text, and is text like any other if it holds most of it and
there is no article beside it. How much is little depends on the name: least for one that
only contains such a word and stands beside names such as content or article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, slices

_names = lambda text: frozenset(text.split())
VOID = _names("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
INLINE = _names("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
RAW = _names("script style textarea title xmp iframe noembed noframes")
NO_TEXT = _names("head script style noscript template button select option optgroup textarea datalist title iframe noembed noframes object embed applet svg canvas audio video input")
ASIDE = _names("nav footer aside form dialog menu map header")
CLOSES_P = _names("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul")
KEPT = _names("html body article main")
NOISE = _names(
    "ad ads adv advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent contentinfo complementary cookie cookies copyright dialog "
    "discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promoted promotion "
    "recommended recommendations related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar tracking widget widgets"
)
GOOD = _names("article body content entry main post story text")
_NOT = _names("has is no not with without")  # has-sidebar is no sidebar
SURE, LIKELY, MAYBE = 3, 2, 1  # suspects
_MOST = {SURE: 0.5, LIKELY: 0.5, MAYBE: 0.2}  # shares of the text up to which they are noise
_BESIDE = 0.2  # share of the text outside suspects from which a larger sure one is noise too, as it is beside an <article>
_SAME = {"li": ("li", _names("ul ol menu dir")), "dt": ("dt dd", _names("dl")), "dd": ("dt dd", _names("dl")), "tr": ("tr td th", _names("table tbody thead tfoot")), "td": ("td th", _names("tr table")), "th": ("td th", _names("tr table")), "option": ("option", _names("select datalist"))}
_SAME = {k: (_names(a), b) for k, (a, b) in _SAME.items()}
_HOLDS_P = _names("table td th caption button object applet marquee html body")
_MARK = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "up", "kids", "mute", "suspect", "open", "plain", "chars", "tags", "link_chars", "link_tags", "density", "first", "last")

    def __init__(self, tag: str, up: Node | None, mute: bool, suspect: int = 0):
        self.tag, self.up, self.kids, self.mute, self.suspect, self.open = tag, up, [], mute, suspect, True
        self.plain = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.first, self.last = 0.0, 0, 0
        if up is not None:
            up.kids.append(self)


def _hidden(name: str, value: str) -> bool:
    return name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(_HIDDEN.search(value))


def _judged(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """(whether an element never has text, how suspect it is by its names)."""
    if tag in NO_TEXT:
        return True, 0
    suspect = SURE if tag in ASIDE and not (tag == "header" and in_article) else 0
    if not attrs or tag in KEPT:
        return False, suspect
    whole = part = good = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if _hidden(name, value):
            return True, 0
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                bad = [w for w in words if w in NOISE and not (w in ("header", "byline") and in_article)]
                if not bad:
                    good |= any(w in GOOD for w in words)
                elif len(words) == 1:
                    whole = True
                elif words[0] not in _NOT:
                    part = True
    return False, max(suspect, SURE if whole else 0 if not part else MAYBE if good else LIKELY)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool]]]:
    """(body, texts): texts are (node, text or None for a block's end, within a link) in page order.

    Open elements lie on a stack. Where each tag is open, and where blocks and what holds
    paragraphs are, is kept beside it, so that no tag searches the stack: the time is linear.
    An inline element that ends while a block in it is open stays on the stack, closed."""
    root = Node("html", None, False)
    body = Node("body", root, False)
    stack, texts = [root, body], []
    opened: dict[str, list[int]] = {"html": [0], "body": [1]}
    blocks, holders = [0, 1], [0, 1]
    at, n = 0, len(page)

    def is_open(*tags: str) -> bool:
        return any(opened.get(t) for t in tags)

    def close(node: Node) -> None:
        node.open, node.last = False, len(texts)
        opened[node.tag].pop()

    def pop(to: int, ends_block: bool = True) -> None:
        while len(stack) > max(2, to):
            gone = stack.pop()
            if gone.open:
                close(gone)
        while len(stack) > 2 and not stack[-1].open:
            stack.pop()
        for places in (blocks, holders):
            while places[-1] >= len(stack):
                places.pop()
        if ends_block:
            texts.append((stack[-1], None, False))

    def last(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    while at < n:
        low = page.find("<", at)
        m = _MARK.match(page, low) if low >= 0 else None
        while low >= 0 and not m:  # a bare <
            low = page.find("<", low + 1)
            m = _MARK.match(page, low) if low >= 0 else None
        stop = low if low >= 0 else n
        if stop > at and not stack[-1].mute:
            texts.append((stack[-1], page[at:stop], is_open("a")))
        if not m:
            break
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            k = last((tag,))
            if k < 2:
                continue
            if tag not in INLINE:
                pop(k)
            elif blocks[-1] > k:  # a block within stays open
                close(stack[k])
            else:
                pop(k, False)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and (k := last(("p",))) > holders[-1]:
            pop(k)
        if tag in _SAME:
            closed, bounds = _SAME[tag]
            while (k := last(closed)) > last(bounds):
                pop(k)
                if tag != "tr":
                    break
        up = stack[-1]
        if tag == "br" and not up.mute:
            texts.append((up, " ", False))
        elif tag not in INLINE:
            texts.append((up, None, False))
        never, suspect = (True, 0) if up.mute else _judged(tag, attrs, is_open("article", "main"))
        node = Node(tag, up, never, suspect)
        node.first = len(texts)
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.start() if end else n
            close_at = page.find(">", at)
            at = close_at + 1 if close_at >= 0 else n
            node.last = len(texts)
        elif tag not in VOID and not (attrs.endswith("/") and up.tag == "svg"):
            opened.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            if tag in _HOLDS_P:
                holders.append(len(stack))
            stack.append(node)
        else:
            node.last = len(texts)
    pop(0)
    body.last = len(texts)
    return body, texts


def _in_order(body: Node) -> list[Node]:
    """All nodes, what is below a node after it."""
    order, todo = [], [body]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    return order


def _silence(body: Node, texts: list) -> None:
    """Mutes suspects that hold little of the text, with all below them."""
    for node, text, link in texts:
        if text is not None and not link:
            node.plain += len(text) - text.count(" ")
    order = _in_order(body)
    for node in reversed(order):
        if node.up is not None:
            node.up.plain += node.plain
    total, outer, named = body.plain, 0, False  # outer: within the outermost suspects; named: an article is outside
    todo = [body]
    while todo:
        node = todo.pop()
        if node.suspect:
            outer += node.plain
        else:
            named |= node.tag in ("article", "main") and node.plain > 0
            todo += node.kids
    beside = named or total - outer >= _BESIDE * total
    left = total
    for levels in ((SURE,), (LIKELY, MAYBE)):
        whole, todo = left, [body]
        while todo:
            node = todo.pop()
            if node.mute:
                continue
            if node.suspect in levels and (node.plain <= _MOST[node.suspect] * whole or node.suspect == SURE and beside):
                node.mute = True
                left -= node.plain
            else:
                todo += node.kids
    for node in order:
        if node.up is not None and node.up.mute:
            node.mute = True


def _measure(body: Node, texts: list) -> list[Node]:
    """Sets counts and densities; returns all nodes with what is below a node after it."""
    _silence(body, texts)
    for node, text, link in texts:
        if text is not None and not node.mute:
            size = len(text) - text.count(" ")
            node.chars += size
            node.link_chars += size if link else 0
    order = _in_order(body)
    for node in reversed(order):
        if node.up is not None and not node.mute:
            up = node.up
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    share = body.link_chars / max(1, body.chars)
    for x in order:
        if x.chars and not x.mute:
            tags, link_chars, link_tags = max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
            base = math.log(math.log(max(1.0, x.chars / max(1, x.chars - x.link_chars) * x.link_chars + share * x.chars) + math.e))
            x.density = x.chars / tags * max(0.0, math.log(x.chars / link_chars * tags / link_tags)) / base
    return order


def _chosen(body: Node, order: list[Node]) -> list[Node]:
    best = max(order, key=lambda x: sum(k.density for k in x.kids))
    if not sum(k.density for k in best.kids):
        return [body]
    way = [best]
    while way[-1] is not body:
        way.append(way[-1].up)
    threshold = min(x.density for x in way)
    top = 0
    if best.tag in INLINE or best.tag == "p":  # a lone paragraph stands for what holds it
        top = next((i for i, x in enumerate(way) if x.tag not in INLINE and x.tag != "p"), 0)
    taken, on_way = [way[top]], set(map(id, way))
    for x in way[top + 1 :]:
        taken += [k for k in x.kids if id(k) not in on_way and not k.mute and k.tag not in INLINE and k.density >= threshold and k.density > 0]
    return taken


def extract(page: str) -> str:
    """The main text: blocks in page order, joined by newlines."""
    body, texts = parse(page)
    order = _measure(body, texts)
    spans = sorted((x.first, x.last) for x in _chosen(body, order))
    blocks = []
    for first, last in spans:
        held: list[str] = []
        for node, text, _ in [*texts[first:last], (body, None, False)]:
            if text is not None:
                if not node.mute:
                    held.append(text)
            elif held:
                if block := " ".join(html.unescape("".join(held)).split()):
                    blocks.append(block)
                held = []
    return "\n".join(blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of ``pages``: id, the columns ``keep``, text, n_chars (code points).

    Null html counts as empty; a page without text has an empty one. Null or repeated ids
    keep their rows, and rows that repeat give the same. Of nodes with equal sums the first in
    the page is taken. Each page is one call, in time linear in its length, however deep its
    elements are. Other columns
    are ignored. An empty table gives an empty result.
    """
    require(pages, id_col, html_col, *keep)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            found = [extract(t or "") for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[1:], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*names, "text", "n_chars"])

    read = pages.select(F.col(html_col).alias("_html"), *names)
    return read.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in read.dtypes[1:]), "text string", "n_chars long"]))
