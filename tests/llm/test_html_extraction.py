"""Main text of pages of several builds, and of odd ones."""

import pytest

from conftest import frame
from marketlens.llm import html_extraction as he

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
MENU = "<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul>"

PAGES = {
    "semantic": (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav>{MENU}</nav><!-- ad --><div class='ad'>Buy</div>"
        f"<article><h1>Head &amp; more</h1><p><b>{P}<br><p>{P} {P}</p><p>Be.</p></article><footer>&copy; me</footer>",
        f"Head & more {P} {P} {P} Be.",
    ),
    "divs": (
        f"<body class='comments-open has-sidebar'><header><h1>Site</h1>{MENU}</header><div id=wrapper><div class=content><h2>Title</h2>"
        f"<div class=section><p>A {P} {P}</p><p>B {P}</p></div><div class=section><h3>Sub</h3><p>C {P} <a href=x>link</a></p><ul><li>one</li>"
        f"<li>two <b>x</b>y</li></ul></div></div><div class=sidebar><p>side {P}</p></div></div>"
        f"<section id=comments><article class=comment><p>reader {P * 8}</p></article></section><div class=cookie-notice>We use cookies</div></body>",
        f"Title A {P} {P} B {P} Sub C {P} link one two xy",
    ),
    "table": (f"<table><tr><td>{MENU}</td><td><h1>Head</h1>{P}<br>{P}<p>{P}</p></td></tr></table>", f"Head {P} {P} {P}"),
    "within the article": (
        f"<main><article><header><h1>Title</h1></header><p>{P}</p><aside>aside</aside><p>{P}</p><form><input value=x>Sign up</form>"
        f"<div class='related-posts'><article><p>teaser</p></article></div><footer>tags</footer></article></main>",
        f"Title {P} {P}",
    ),
    "long remarks": (
        f"<article><h1>T</h1><p>{P}</p></article><div class='reader-comments'><p>{P * 20}</p></div><div role=dialog><p>{P * 9}</p></div>",
        f"T {P}",
    ),
    "code": (f"<article><p>{P}</p><pre><code>x = 1 <span class='comment'># why</span>\n  y</code></pre><p>{P}</p></article>", f"{P} x = 1 # why y {P}"),
    "around": (f"<form><div class='page-sidebar-left'><div><p>{P}</p><p>{P} <a href=x>x</a></p></div></div><input></form>", f"{P} {P} x"),
    "short": ("<div class='notice'>We moved</div><article><h1>T</h1><p>Short.</p></article>", "T Short."),
    "hidden": (f"<p>{P}</p><p hidden>no</p><p style='display: none'>no</p><p>{P}</p>", f"{P} {P}"),
    "unclosed": ("<div><p>one<p>two<div>three<span>four</div>five <!-- c -- > six", "one two threefour five six"),
    "references": ("<p>a&nbsp;&lt;b&gt; &#233;&#x1F642; &eacute &unknown; &amp;amp;</p>", "a <b> é🙂 é &unknown; &amp;"),
    "blocks": ("<p>a<b>b</b>c</p><p>d\n\t e</p>f<hr>g<br>h", "abc d e f g h"),
    "plain": ("just text", "just text"),
    "none": ("<html><body><script>x</script></body></html>", ""),
    "blank": (" \n ", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, text = PAGES[name]
    assert he.main_text(html) == text


def test_deep_and_long_pages():
    assert he.main_text("<div>" * 30_000 + "deep") == "deep"
    assert he.main_text("</div></p>" * 30_000 + "<p>x") == "x"
    body = "".join(f"<p>{P} {n}</p>" for n in range(5000))
    assert he.main_text(f"<nav>{MENU}</nav><div>{body}</div>") == " ".join(f"{P} {n}" for n in range(5000))


def test_density_rewards_text_and_not_links():
    nodes = he.Tree(f"<body><div><p>{P}</p></div><div><a href=x>{P}</a></div></body>").nodes
    he.prune(nodes)
    he.measure(nodes)
    text, links = (n for n in nodes if n.tag == "div")
    assert text.density > links.density >= 0
    assert nodes[[n.tag for n in nodes].index("body")].total == pytest.approx(text.density + links.density)


def test_extracted_rows(spark):
    rows = [(n, f"u{n}", html) for n, (html, _) in enumerate(PAGES.values())] + [(None, None, "<p>x</p>"), (1, "again", None)]
    pages = frame(spark, "page_id long, url string, html string, text string, n_chars long", *[(*r, "clash", 0) for r in rows])
    got = he.extracted(pages)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    texts = [t for _, t in PAGES.values()] + ["x", ""]
    want = [(i, u, t, len(t)) for (i, u, _), t in zip(rows, texts, strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert he.extracted(pages.limit(0)).collect() == []
