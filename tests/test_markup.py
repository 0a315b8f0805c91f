import time

import pytest

from gleanery import constants as C
from gleanery.functions.markup import PageReader, markdown, parse

RULES = [
    ("<h1>A <b>b</b></h1><h6>c</h6>", "# A b\n\n###### c"),
    ("<p>a</p><p>b</p>", "a\n\nb"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a<br>b<hr>c</div>", "a\nb\nc"),
    ("<span>a<br>b</span><hr>c", "a\nb\n---\nc"),
    ("<strong>a</strong><b>b</b><em>c</em><i>d</i>", "**a****b***c**d*"),
    ('<a href="/x">t <i>u</i></a>', "[t u](/x)"),
    ('<a href="">t</a><a>u</a><a href="/x"></a>', "tu"),
    ('<img src="/a.png" alt="A"><img alt="none">', "![A](/a.png)"),
    ('<img data-src="/lazy.png" src="/wait.gif">', "![](/lazy.png)"),
    ("<ul><li>a<li>b <i>c</i><span>no</span></ul>", "- a\n- b *c*no"),
    ("<ol><li>x</li><p>skipped</p><li>y</li></ol>z", "1. x\n2. y\n\nz"),
    ("<code>a<b>b</b></code>", "`ab`"),
    ("<pre>\n x\n  y</pre>z", "```\n x\n  y\n```\n\nz"),
    ("<blockquote>l1\n\nl2</blockquote>", "> l1\n\n> l2"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "abc"),
    ("a<script>var x = '</p>'</script><style>p{}</style><!-- no --><noscript>n</noscript>b", "ab"),
    ("<p><b>one<br><p>two</b> three</p>four", "**one**\n\n**two** three\n\nfour"),
    ("a &amp; b &lt;c&gt; &copy; &#8364; &nbsp;", "a & b <c> © €"),
    ("x\n\n\n\n\ny", "x\n\ny"),
    ("one<br/>two", "one\ntwo"),
    ("1 < 2 <p>c <a href='x", "1 < 2 c"),
    ("<P>UP</P><DIV>low</DIV>", "UP\n\nlow"),
    ("</p>x", "x"),
    ("<a href=/1>one<a href=/2>two</a>", "[one](/1)[two](/2)"),
    ("<h1>a<h2>b", "# a\n\n## b"),
    ("<p>a<ul><li>b</ul>c", "a\n\n- b\n\nc"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a- b\n\n- c"),
    ("<td>a</td><b>x<td>y</td>z</b>", "a**xyz**"),
    ("<svg><title>t</title></svg>x", "tx"),
    ("<span>b</span><span>br</span><!--hr-->", "bbr"),
]


@pytest.mark.parametrize("html, expected", RULES)
def test_markdown(html, expected):
    assert markdown(parse(html), 0) == expected


@pytest.mark.parametrize("html, expected", [
    ("<p>lost<b>kept</b>lost</p>", "**kept**"),
    ("<h1>kept</h1>lost<ul><li>lost <a href=x>kept</a></ul>", "# kept\n\n- [kept](x)"),
    ("<p><b>one<br><p>two", "**one**\n\n**two**"),
])
def test_literal_mode_keeps_marked_text_only(html, expected):
    assert markdown(parse(html), 0, bare=False) == expected


def test_attributes():
    link = parse("<a HREF='?a=1&copy=2&amp;b&lt' href=second data-x>t</a>").kids[1].kids[0]
    assert link.attrs == {"href": "?a=1&copy=2&b<", "data-x": ""}


def test_byte_budget_never_splits_a_character():
    assert markdown(parse("<p>" + "中" * 50), 100) == "中" * 33
    assert markdown(parse("<p>" + "中" * 50), 0) == "中" * 50


def test_deep_nesting_keeps_text():
    assert markdown(parse("<div>" * 5000 + "x"), 0) == "x"
    assert "x" in markdown(parse("<b>" * 3000 + "x"), 0)


def test_text_below_many_closed_elements_is_kept():
    page = "<article>" + "<div>" * 5000 + "<p>DEEP</p>" + "</div>" * 5000 + "<p>TAIL</p></article>"
    assert markdown(parse(page), 0).split() == ["DEEP", "TAIL"]


def test_unclosed_formatting_is_fast():
    started = time.perf_counter()
    parse("".join(f"<b class=c{i}>x" for i in range(4000)))
    assert time.perf_counter() - started < 5


def test_no_cut_unless_asked():
    assert len(markdown(parse("<p>" + "x" * 40_000), 0)) == 40_000


def _reader(**options):
    defaults = dict(min_bytes=C.MIN_CONTENT_BYTES, max_bytes=0, bare=True)
    return PageReader(C.COMMON_SELECTORS, C.WECHAT_SELECTORS, C.FALLBACK_SELECTOR, **{**defaults, **options})


LONG, SHORT = "word " * 30, "word"


@pytest.mark.parametrize("html, selector", [
    (f"<article>{LONG}</article><main>{LONG}</main>", "article"),
    (f"<main>{LONG}</main><article>{SHORT}</article>", "main"),
    (f"<article>{SHORT}</article><article>{LONG}</article>", "body(fallback)"),
    (f"<div role=article>{LONG}</div>", "[role='article']"),
    (f"<div itemprop=articleBody>{LONG}</div>", "[itemprop='articleBody']"),
    (f"<div class='x post-content y'>{LONG}</div>", ".post-content"),
    (f"<div class='post-contents'>{LONG}</div>", "body(fallback)"),
    (f"<div class=Post-RichText>{LONG}</div>", ".Post-RichText"),
    (f"<div id=article_content>{LONG}</div>", "#article_content"),
    (f"<div class=ssa-article>{LONG}</div>", ".ssa-article"),
    ("<article></article>" + LONG, "body(fallback)"),
])
def test_selection(html, selector):
    content, found, _ = _reader().read(html)
    assert found == selector and "word" in content


def test_wechat_selectors_come_first_when_asked():
    page = f"<article>{LONG}</article><div id=js_content>{LONG}</div><div class=rich_media_content>{LONG}</div>"
    assert _reader().read(page)[1] == "article"
    assert _reader().read(page, use_extra=True)[1] == "div#js_content"
    assert _reader().read(page.replace("<div id=js_content>", "<p id=js_content>"), True)[1] == "div.rich_media_content"


def test_metadata():
    page = """<head><title> A </title><link rel=canonical href=""><link rel="canonical" href="/c"><link rel=canonical
    href=/d><meta property="og:title" content=""><meta property="og:image" content="/1"><meta property="og:image"
    content="/2"><meta name=description content=" d &amp; e "><meta name="author" content="no"></head>
    <body><title>B</title>x"""
    content, selector, metadata = _reader().read(page)
    assert metadata == ("/c", "A B", " d & e ", "/1", "", "", "")
    assert (content, selector) == ("Bx", "body(fallback)")
