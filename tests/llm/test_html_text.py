"""Main text of pages: the given tables, hand-made layouts, odd rows."""

import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmoor.llm import html_text
from sparkmoor.llm.catalog import QUERIES

LONG = "Many words stand in this paragraph, which goes on for a while as articles do, and then it ends."
LINKS = "".join(f"<li><a href='/{i}'>Go to {i}</a></li>" for i in range(6))


def plain(page):
    """The blocks of a page of the given tables, whose article is named."""
    if not page:
        return ""
    title, rest = re.search(r"<article><h1>(.*?)</h1>(.*)</article>", page, re.S).groups()
    blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in [title, *rest.split("<p>")]]
    return "\n".join(filter(None, blocks))


def test_given_pages(spark, root):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
    got = QUERIES["op12_tag_ratio_text"](spark, root)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


ARTICLE = f"<h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}<br>{LONG}</p>"
TEXT = f"A title\n{LONG}\nShort.\n{LONG} {LONG}"
LAYOUTS = {
    "article": f"<nav><ul>{LINKS}</ul></nav><article>{ARTICLE}</article><footer><p>{LONG}</p></footer>",
    "main": f"<header><p>{LONG}</p></header><main>{ARTICLE}</main><aside>{LONG}</aside>",
    "article in main": f"<main><ul>{LINKS}</ul><article>{ARTICLE}</article><div>{LINKS}</div></main>",
    "plain elements": f"<div>{LINKS}</div><div>{ARTICLE}</div><div>&copy; somebody</div>",
    "nested elements": f"<div><div>{LINKS}</div><div><section>{ARTICLE}</section></div></div><p>&copy; us",
    "names": f"<div id=topMenu>{LONG}</div><div class='site-header'>{LONG}</div><div class=content>{ARTICLE}"
             f"<div class='ad-slot'>{LONG}</div><div class=cookieNotice>{LONG}</div></div><div id=comments><p>{LONG}</p></div>",
    "roles": f"<div role=banner>{LONG}</div><article>{ARTICLE}<div role=alert>{LONG}</div><div hidden>{LONG}</div></article>",
    "forms": f"<article>{ARTICLE}<form><p>{LONG}<textarea>{LONG}</textarea></form></article>",
    "all in a form": f"<form><nav>{LINKS}</nav><article>{ARTICLE}</article></form>",
    "readers": f"<article>{ARTICLE}<article><p>{LONG}</p></article></article><section class=comments><article>{LONG * 9}</article></section>",
    "named wrapper": f"<div class='page has-sidebar'><article>{ARTICLE}</article><div class=sidebar>{LONG}</div></div>",
    "header of the article": f"<article><header><h1>A title</h1></header>{ARTICLE[16:]}</article>",
    "unclosed": f"<div class=ad>{LONG}</div><article><h1>A title<p>{LONG}<p>Short.<p><b>{LONG}<br>{LONG}</article><footer>{LONG}",
    "links to elsewhere": f"<article>{ARTICLE}<ul>{LINKS}</ul></article>",
    "code and remarks": f"<script>var x = '<p>{LONG}</p>'</script><article><!-- {LONG} --><style>p {{}}</style>{ARTICLE}<noscript>{LONG}</noscript></article>",
    "table": f"<table><tr><td><ul>{LINKS}</ul></td><td>{ARTICLE}</td></tr></table>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page = f"<!DOCTYPE html><html><head><title>{LONG}</title></head><body>{LAYOUTS[name]}</body></html>"
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("just words", "just words"), ("<p>a &amp; b &lt;c&gt; &#233;&eacute;&am;</p>", "a & b <c> éé&am;"),
    ("<p>a\n\t b&nbsp; c</p>", "a b c"), ("<p>cut off<a href='x", "cut off"), ("<p>cut <scr", "cut"), ("<p>1 < 2</p>", "1 < 2"),
    ("<p>x</p><script>never closed <p>y", "x"), ("<![if IE]><p>x</p><![endif]>", "x"), ("<![CDATA[y]]><p>x", "x"),
    ("<p>x&#" + "9" * 5000 + ";</p>", "x�"), ("<p>x&#0000000000065;</p>", "xA"), ("<p>&#xD800;</p>", "�"),
    ("<div class=ad>only this</div>", "only this"), ("<nav>only that</nav>", ""), ("</p></div></nope>x", "x"),
    ("<p>one<p>two", "one\ntwo"), ("<article><p>a</article><article><p>b b</article>", "b b"),
    ("<p>same</p><p>same</p>", "same\nsame"), ("<P CLASS='Ad'>no</P><P>yes, this", "yes, this")])
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


@given(st.text(st.sampled_from("<>/=&#;'\"! -[]apdivnx\n1é"), max_size=80))
@settings(deadline=None, max_examples=500)
def test_no_page_is_too_odd(page):
    text = html_text.main_text(page)
    assert all(x and x == " ".join(x.split()) for x in text.split("\n")) or not text


@given(st.lists(st.sampled_from(["<p>", "</p>", "a &amp; b", "<b>", "<div class='ad'>", "</div>", "<!-- x -->", "é", "&am", " "]), max_size=40),
       st.integers(1, 9))
@settings(deadline=None)
def test_parts_change_nothing(parts, size):
    page = "".join(parts)
    whole = html_text.main_text(page)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html_text, "CHUNK", size)
        assert html_text.main_text(page) == whole


def test_very_long_pages():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert html_text.main_text(f"<nav>{LINKS}</nav><div>{body}</div>").count("\n") == 19_999
    assert html_text.main_text("<div>" * 50_000 + "x" + "</div></i>" * 50_000) == "x"
    assert len(html_text.main_text("<article>" + "word " * 500_000 + "</article>")) == 2_499_999


def test_smoothing():
    lines = [html_text.Line("x" * n, 1, 0, 0, 0) for n in (0, 0, 0, 100, 0, 0, 0)]
    smooth = html_text.ratios(lines)
    assert np.allclose(smooth, smooth[::-1]) and smooth.argmax() == 3 and 0 < smooth[2] < smooth[3] < 100
    assert np.allclose(html_text.ratios(lines[3:4]), 100)


def test_odd_rows(spark):
    rows = [(1, "<p>a</p>", "u"), (1, "<p>a</p>", "u"), (None, None, None), (2, "", "v")]
    df = spark.createDataFrame(rows, "page_id long, html string, Text string").withColumn("_html", F.lit(1))
    out = html_text.with_text(df)
    assert out.columns == ["page_id", "html", "Text", "_html", "text_"]
    assert sorted(r["text_"] for r in out.collect()) == ["", "", "a", "a"]
    assert html_text.with_text(df.limit(0)).count() == 0
    report = html_text.line_report(df).collect()
    assert [(r["page_id"], r["line"], r["kept"], r["text"]) for r in report] == [(1, 0, True, "a")] * 2
