"""Main text of pages: templates of different make, the densities by plain recursion, the query on a whole table."""

import math
import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import html_text, queries
from siltstone.llm.html_text import Counts, Page, main_text

LONG = "The harbour was quiet in the early morning and the boats had not yet left for the open sea. " * 4
MORE = "Nobody in the village had expected that the old lighthouse would be lit again after so many years. " * 3
MENU = "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(12))


def clean(*blocks):
    return "\n".join(" ".join(b.split()) for b in blocks)


def test_article_among_boilerplate():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>
      <header><h1>Site name</h1><p>Since 1900</p></header><nav><ul>{MENU}</ul></nav>
      <div class="cookie-notice">We use cookies, please accept them all right now.</div>
      <main><article><header><h1>Lighthouse &amp; sea</h1></header>
        <p>{LONG} See <a href="/x">the older story</a> too.</p>
        <script>document.write("<p>" + x);</script><!-- a <p>comment</p> -->
        <div class="ad-slot">Buy boats today!</div>
        <h2>Short</h2><p>Yes.</p><ul><li>First <b>po</b>int</li><li>Second<br>point</li></ul>
        <form action="/s"><label>Subscribe</label><input name=q></form>
        <blockquote>{MORE}</blockquote></article>
        <aside>About the author</aside>
        <section id="comments"><h3>Comments</h3><div class="comment"><p>{LONG}{LONG}{LONG}</p></div></section></main>
      <footer>&copy; 2020 {MORE}</footer></body></html>"""
    assert main_text(html) == clean("Lighthouse & sea", LONG + " See the older story too.", "Short", "Yes.", "First point", "Second point", MORE)


def test_plain_divisions_without_article_elements():
    html = f"""<body><div id=top><a href=/>Home</a> <a href=/b>News</a> <a href=/c>Sport</a></div>
      <h1>Title ahead</h1><div><div><p>{LONG}</p><p>Tiny.</p></div><div><p>{MORE}</p></div></div>
      <div><ul>{MENU}</ul></div><div>Call us</div></body>"""
    assert main_text(html) == clean("Title ahead", LONG, "Tiny.", MORE)


def test_a_frame_that_is_marked_or_a_form_is_kept():
    html = f'<body><form id=aspnet><div class="widget-page"><article><h1>A</h1><p>{LONG}</p></article></div></form></body>'
    assert main_text(html) == clean("A", LONG)
    assert main_text(f'<div class="comments"><article class="comment"><p>{LONG}</p></article></div><article><p>{MORE}</p></article>') == clean(MORE)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("  \n ", ""), ("plain   text &amp; more", "plain text & more"), ("<p>one<p>two", "one\ntwo"), ("a < b and <3 c", "a < b and <3 c"),
        ("<article><p>x&nbsp;y &lt;p&gt; &#x41;&#66; &eacute; &copy</article>", "x y <p> AB é ©"), ("<p>open <b>bold<br><p>next</b> one", "open bold\nnext one"),
        ("<p title='a > b'>kept</p>", "kept"), ('<p class="x>broken quote</p><p>after', 'broken quote\nafter'), ("<script>never closed <p>x</p>", ""), ("<!-- open <p>x", ""),
        ("<nav>only <a href=x>menu</a></nav>", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<head><title>t</title><p>text", "text"),
        ("<article><p>A</p><p hidden>B</p><p style='display: none'>C</p><span class='share-bar'>D</span></article>", "A"), ("text</p></div></b> tail", "text tail"), ("<p>unfinished <a href=", "unfinished <a href="),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_very_long_and_very_deep_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<article>" + "<p>" + "word " * 400_000)) == 5 * 400_000 - 1
    assert main_text("<article>" + "<p>row</p>" * 20_000 + "</article>").count("\n") == 19_999


TREE = st.recursive(st.text("ab c", max_size=12).map(lambda t: t.strip()), lambda inner: st.tuples(st.sampled_from(["div", "p", "a", "b", "section"]), st.lists(inner, max_size=4)), max_leaves=25)


def written(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>" + "".join(map(written, tree[1])) + f"</{tree[0]}>"


@settings(max_examples=150, deadline=None)
@given(st.lists(TREE, max_size=6))
def test_counts_and_densities_by_plain_recursion(trees):
    """Each node's density and sum from its own subtree, walked again for every node."""
    page = Page("".join(map(written, trees)))
    found = Counts(page)
    size = len(page.parent)
    kids = {k: [c for c in range(1, size) if page.parent[c] == k] for k in range(size)}

    def linked(k):
        return k > 0 and (page.tag[k] == "a" or linked(page.parent[k]))

    def own(k):
        return sum(len(t.strip()) for n, t in page.flow if n == k and t)

    def subtree(k):
        return [k] + [x for c in kids[k] for x in subtree(c)]

    def counts(k):
        nodes = subtree(k)
        return sum(map(own, nodes)), sum(page.tag[n] in html_text.BLOCKS or page.tag[n] == "a" for n in nodes[1:]), sum(own(n) for n in nodes if linked(n)), sum(page.tag[n] == "a" for n in nodes)

    c_all, _, l_all, _ = counts(0)

    def density(c, t, lc, lt):
        if c == 0:
            return 0.0
        base = math.log(c / max(1, c - lc) * max(1, lc) + l_all / c_all * c + math.e)
        return c / max(1, t) * max(0.0, math.log(max(1, c / max(1, lc) * (max(1, t) / max(1, lt))), base))

    for k in range(size):
        assert found.density[k] == pytest.approx(density(*counts(k)))
        text = 0 if linked(k) else own(k)
        assert found.total[k] == pytest.approx(density(text, 1, 0, 0) + sum(found.density[c] for c in kids[k]))


def plain_article(html):
    """The template's article by a pattern, its blocks cut at the tags of paragraphs and titles."""
    inner = re.search(r"<article>(.*?)</article>", html or "", re.DOTALL)
    blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_against_the_template(spark, sf):
    rows = queries.QUERIES["op12_html_extraction"](spark, sf).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], plain_article(pages[r["page_id"]]["html"]), len(r["text"]))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "<p>x"), (None, "<p>x"), (2, "")], "page_id bigint, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as __text")
    got = html_text.extract(df, keep={"page_id": "page_id"})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "", 0), (1, "x", 1), (2, "", 0), (None, "x", 1)]
    assert html_text.extract(df.where("false")).count() == 0
