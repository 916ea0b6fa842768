import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborspark.functions import encoding, entities
from arborspark.functions.html import ELEMENT, Dom, events, tokens
from arborspark.plans import css

MARKUP = st.lists(st.sampled_from(["<div>", "</div>", "<p class='a b'>", "</p>", "<br>", "<img src=x/>", "text", "&amp;", "<!-- c -->", "<b id=i>", "</b>", "<script>", "</script>", "<", ">", '"', "é", "<a href=\"/x", "<!doctype html>", "</", "<ul><li>1<li>2</ul>"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_tree_invariants(html):
    d = Dom(html)
    for i in range(1, len(d)):
        assert 0 <= d.parent[i] < i <= d.out[i] <= d.out[d.parent[i]]
        assert d.depth[i] == d.depth[d.parent[i]] + 1
    spans = [(a, b) for *_, a, b in tokens(html)]
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)


@settings(max_examples=150, deadline=None)
@given(MARKUP)
def test_serialised_markup_is_a_fixed_point(html):
    once = Dom(html).html()
    assert Dom(once).html() == once


@pytest.mark.parametrize(("html", "selector", "count"), [
    ('<div class="card"><span class="t">text<', ".t", 1),
    ('<div class="card"><a href="/a>broken<span class="t">x</span></div>', ".card", 1),
    ('<div class="card"><span class="t">x</span></div></span></div>', ".card > .t", 1),
    ('<div class=card><img src="/a.png" alt="x"/><span class=t>y</span></div>', "img + .t", 1),
    ("", "*", 0),
    ("<p><b>one<br><p>two", "b > p", 1),
    ("<script>var a='<p>'</script><p>", "p", 1),
    ("<script>never closed <p>", "p", 0),
])
def test_malformed_pages(html, selector, count):
    assert len(css.select(Dom(html), selector)) == count


def test_depth_is_bounded():
    d = Dom("<div>" * 3000 + "x")
    assert max(d.depth) <= 1026
    assert len(css.select(Dom("<div>" * 800 + "<i>deep</i>"), "div i")) == 1


def test_events():
    got = [(k, n) for k, n, _, _ in events('<!DOCTYPE html><div><img src=/a.png><br/>hi<!-- n --></div>')]
    assert got == [("doc_start", None), ("doctype", "html"), ("start", "div"), ("start", "img"), ("end", "img"), ("start", "br"), ("end", "br"), ("text", None), ("comment", None), ("end", "div"), ("doc_end", None)]
    s = next(e for e in events("<a href=/x class=lk DATA-X='1' disabled href=no>") if e[0] == "start")
    assert s[2] == {"href": "/x", "class": "lk", "data-x": "1", "disabled": ""}


def test_text_references_and_paths():
    d = Dom('<div id=m><p>a &lt;b&gt; &nbsp;&copy; &#65;&#x42;&#0;</p><p>z<script>s</script></p></div>')
    assert d.text(css.select(d, "p")[0]) == "a <b>  &copy; AB�"
    assert d.visible_text(0).endswith("z")
    assert d.css_path(css.select(d, "p")[1]) == "#m > p:nth-of-type(2)"
    assert d.xpath_path(css.select(d, "p")[1]) == "//div[@id='m']/p[2]"
    assert all(d.kind[i] == ELEMENT for i in d.elements)


@pytest.mark.parametrize(("raw", "name", "text"), [
    (b"plain", "utf-8", "plain"),
    (b"\xef\xbb\xbfmark", "utf-8", "mark"),
    (b'<meta charset="windows-1252">\xe9', "windows-1252", '<meta charset="windows-1252">é'),
    (b'<meta http-equiv="Content-Type" content="text/html; charset=latin1">\x80', "windows-1252", None),
    ("﻿hi".encode("utf-16-le"), "utf-16-le", "hi"),
    (b"<p>\xc3\x28ok", "utf-8", "<p>(ok"),
])
def test_encodings(raw, name, text):
    assert encoding.detect(raw) == name
    if text is not None:
        assert encoding.to_text(raw) == text


@pytest.mark.parametrize(("s", "want"), [("&amp;lt;", "&lt;"), ("&copy;&eacute;", "©é"), ("&bogus; &", "&bogus; &"), ("&#x41;&#66;", "AB"), ("a&nbsp;b&apos;", "a b'")])
def test_entities(spark, s, want):
    from pyspark.sql import functions as F

    assert entities.decode(s) == want
    assert spark.createDataFrame([(s,)], "s string").select(entities.decode_col(F.col("s"))).first()[0] == want
