import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quirelight.llm.html_extract import INLINE, _chosen, _measure, extract, extract_text, parse

A = "A long first paragraph, with much plain text in it so that its density is high, and more of it."
B = "A second paragraph of the same article, that goes on for a while without any link in it at all."

CASES = [
    ("", ""),
    ("   ", ""),
    (f"<p>{A}", A),
    (f"<nav><a href=/>x</a></nav><article><h1>T &amp; U</h1><p><b>{A}<br><p>{B}</p></article><footer>f</footer>", f"T & U\n{A}\n{B}"),
    (f"<body><header>Site</header><article><header><h1>T</h1></header><p>{A}</p><p>{B}</p><footer>by x</footer></article></body>", f"T\n{A}\n{B}"),
    (f"<div class='menu main'><a>m</a></div><div id=c><p>{A}<p>{B}</div><div class=comments><p>{A * 3}</p></div>", f"{A}\n{B}"),
    (f"<main><section><p>{A}</p></section><section><p>{B}</p></section></main><aside>{B}</aside>", f"{A}\n{B}"),
    (f"<script>var a='<p>x</p>';</script><style>p{{}}</style><article><p>a &lt; b &#233;&nbsp; c\n d {A}</p><!-- <p>no</p> --></article>", f"a < b é c d {A}"),
    (f"<article><p>1 <b>bold<i>er</i></b> text</p><ul><li>one<li>two</ul><pre> x\n  y </pre><p>{A}</article>", f"1 bolder text\none\ntwo\nx y\n{A}"),
    (f"<article><p>x <b>y<p>z</b> w</p><p>{A}</p></article>", f"x y\nz w\n{A}"),
    (f"<div role='dialog'>cookies</div><article><p hidden>h</p><p style='display: none'>n</p><p>{A}</p><form><p>{B}</p></form></article>", A),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    (f"<article><p title='a>b'>{A}</p><p title=\"unclosed>{B}</p></article>", f"{A}\n{B}"),
    (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{A}</p></article>", f"a\nb\nc\n{A}"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_extract(page, text):
    assert extract(page) == text


CLASSES = ["content has-sidebar", "main-content with-sidebar", "post no-comments", "page header-fixed", "article-body search-result", "layout right-sidebar-layout", "social-science", "notice-board article-text", "comments", "widget"]


@pytest.mark.parametrize("names", CLASSES)
def test_a_name_silences_no_article(names):
    page = f"<nav><a href=/>Home</a> menu of it</nav><div class='{names}'><h1>Title</h1><p>{A}</p><p>{B}</p></div><footer>foot</footer>"
    assert extract(page) == f"Title\n{A}\n{B}"
    assert extract(f"<form><div class='site has-nav'>{page}</div></form>") == f"Title\n{A}\n{B}"


@pytest.mark.parametrize("names", ["comments", "user-comments", "right-sidebar", "related posts", "share-bar", "site-footer"])
def test_noise_beside_an_article(names):
    assert extract(f"<article><p>{A}</p><p>{B}</p></article><div class='{names}'><p>{A}</p></div>") == f"{A}\n{B}"


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>" * 50_000 + "</div>" * 50_000, "<b>" * 30_000 + "<div>" * 30_000 + "</b>" * 30_000, "<div>" * 50_000 + "</span></p>" * 50_000 + "<li>" * 20_000):
        start = time.process_time()
        extract(page + "x")
        assert time.process_time() - start < 4


def plain_choice(body):
    """The selection by recursion over the whole tree, from counts alone."""
    import math

    share = body.link_chars / max(1, body.chars)

    def density(x):
        if not x.chars or x.mute:
            return 0.0
        t, lc, lt = max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        return x.chars / t * max(0.0, math.log(x.chars / lc * t / lt)) / math.log(math.log(max(1.0, x.chars / max(1, x.chars - x.link_chars) * x.link_chars + share * x.chars) + math.e))

    def below(x):
        return [x] + [y for k in x.kids for y in below(k)]

    sums = {id(x): sum(density(k) for k in x.kids) for x in below(body)}
    if not max(sums.values()):
        return {id(body)}
    most = [x for x in below(body) if sums[id(x)] == max(sums.values())]
    out = []
    for best in most:  # ties: any
        way = [best]
        while way[-1] is not body:
            way.append(way[-1].up)
        least = min(map(density, way))
        top = next((x for x in way if x.tag not in INLINE and x.tag != "p"), body) if best.tag in INLINE or best.tag == "p" else best
        beside = {id(k) for x in way[way.index(top) + 1 :] for k in x.kids if k not in way and not k.mute and k.tag not in INLINE and density(k) >= least and density(k) > 0}
        out.append({id(top)} | beside)
    return out


def test_density_of_plain_case():
    import math

    body, texts = parse("<div><p>abcdefghij</p><p><a>abcde</a>fghijklmno</p></div>")
    div = next(x for x in _measure(body, texts) if x.tag == "div")
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (25, 3, 5, 1)
    base = math.log(math.log(25 / 20 * 5 + 5 / 25 * 25 + math.e))
    assert math.isclose(div.density, 25 / 3 * math.log(25 / 5 * 3 / 1) / base)


PART = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<a href='x'>", "</a>", "<div class=ad>", "</div>", "<article>", "</article>", "<td>", "<tr>", "<table>", "</table>", "<!--", "-->", "<", ">", "&amp;", "&", "text ", "<script>", "</script>", "<br/>", "'", '"', "<li>", "<svg><path/></svg>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=40).map("".join))
def test_any_page_ends(page):
    assert "\n\n" not in extract(page)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PART, st.sampled_from(["<section>", "</section>", "<div>", "some more words of text ", "<ul>", "</ul>", "<aside>", "</aside>"])), max_size=60).map("".join))
def test_choice_equals_plain_recursion(page):
    body, texts = parse(page)
    got = {id(x) for x in _chosen(body, _measure(body, texts))}
    want = plain_choice(body)
    assert got == want or got in want


def test_table(spark):
    rows = [(1, "u", c[0], "t") for c in CASES] + [(None, None, None, "t"), (2, "u", f"<p>{A * 20000}", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    want = [(r[0], r[1], extract(r[2] or "")) for r in rows]
    assert sorted(map(str, ((r["page_id"], r["url"], r["text"]) for r in got))) == sorted(map(str, want))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(df.where("false")).collect() == []
