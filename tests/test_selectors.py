import pytest
from pyspark.sql import functions as F

from arborspark.functions.html import Dom
from arborspark.operators import arrays, relational
from arborspark.operators.nodes import nodes, parse
from arborspark.plans import css, xpath

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title></head><body>
<header><h2 class="title">Top</h2></header>
<main id="results"><div class="card" data-rank="1"><h2 class="title">A</h2><a href="/a" rel="next">Next</a><span class="price">$10</span></div>
<div class="card featured" data-rank="2"><h2 class="title">B</h2><span class="price">$20</span><p></p></div>
<div class="ad" data-rank="3"><h2>Sponsored</h2><span class="price">--</span></div></main>
<ul><li>1</li><li class="x">2</li><li>3<b>!</b></li><li>4</li><li lang="en-US">5</li></ul>
<form><input type="checkbox" checked><input disabled="false" required><input disabled></form><!-- note --></body></html>"""

SELECTORS = [
    "div", ".card", "div.card.featured", "#results", "[data-rank]", '[data-rank="2"]', '[class~="featured"]', '[lang|="en"]', '[href^="/"]', '[href$="a"]', '[rel*="ex"]', '[rel="NEXT" i]', "main > div", "body div .price",
    "h2 + span", "h2 ~ span", "a + span", "li:first-child", "li:last-child", "li:nth-child(2)", "li:nth-child(odd)", "li:nth-child(3n-1)", "li:nth-child(-n+2)", "li:nth-last-child(2)", "li:only-child", "h2:first-of-type",
    "span:last-of-type", "span:only-of-type", "span:nth-of-type(1)", "p:empty", ":root", "input:checked", "input:disabled", "input:enabled", "input:required", "input:optional", "a:link", "a:hover", "a:unknown-thing",
    "div:not(.card)", "div:not(.card, .ad)", "div:is(.ad, .featured) > span", "li:not(:first-child):not(.x)", "div:has(a)", "div:has(> p)", "div:not(:has(a))", "h2:has(+ a)", "h2:has(~ p)", "main:has(div > a) .price", "li:has(::text)", "div:has(h2 + span)",
    "li, h2", "h2, .title, li.x", "div:not(.card > .ad)", "body > main div.card > h2.title", "*",
]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<div><div class='card'><p>x</p></div></div>"), (3, None)], "page_id long, html string")
    return nodes(pages).cache(), parse(pages).cache()


@pytest.mark.parametrize("start", range(0, len(SELECTORS), 10))
def test_three_engines_agree(tables, start):
    n, d = tables
    for s in SELECTORS[start : start + 10]:
        want = sorted((p, i) for p, h in ((1, PAGE), (2, "<div><div class='card'><p>x</p></div></div>")) for i in css.select(Dom(h), s))
        assert sorted(map(tuple, relational.select(n, s).select("page_id", "node_id").collect())) == want, s
        got = d.select("page_id", F.explode(arrays.select(F.col("dom"), s)).alias("n")).select("page_id", "n.node_id")
        assert sorted(map(tuple, got.collect())) == want, s


def test_values_and_order():
    d = Dom(PAGE)
    assert css.values(d, ".card a::attr(href), .ad h2::text") == ["/a", "Sponsored"]
    assert css.values(d, "li > ::text")[2] == "3"
    assert css.values(d, "div::attr(id)") == [None] * 3
    assert [d.tag[i] for i in css.select(d, "h2, header")][-1] == "header"
    card = css.select(d, ".card")[0]
    assert css.select(d, ".card", card) == [card] and len(css.select(d, "> h2", card)) == 1


@pytest.mark.parametrize("bad", ["", "div >", "..x", "[", "a..b", "::"])
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.parse(bad)


@pytest.mark.parametrize(("expression", "want"), [
    ("//div[contains(@class,'card')]/h2", ["A", "B"]), ("//div[1]/h2", ["A"]), ("(//h2)[last()]", ["Sponsored"]), ("//li[position() > 3]", ["4", "5"]), ("//li[last()]/@lang", ["en-US"]),
    ("count(//li)", ["5"]), ("//div[@data-rank > 1]/h2/text()", ["B", "Sponsored"]), ("//a/following-sibling::span", ["$10"]), ("//span[. = '$20']/preceding-sibling::h2", ["B"]), ("name(//b/..)", ["li"]),
    ("count(//b/ancestor::*)", ["4"]), ("name(//b/ancestor::*[1])", ["li"]), ("//comment()", [" note "]), ("string(//title)", ["T & U"]), ("concat('a', 1 + 2 * 3, 'b')", ["a7b"]),
    ("substring('12345', 2, 3)", ["234"]), ("substring('12345', 1.5, 2.6)", ["234"]), ("substring-before('a=b','=')", ["a"]), ("substring-after('a=b','=')", ["b"]), ("translate('bar','abc','AB')", ["BAr"]),
    ("normalize-space('  a   b ')", ["a b"]), ("1 div 0", ["Infinity"]), ("0 div 0", ["NaN"]), ("5 mod 2", ["1"]), ("-5 mod 2", ["-1"]), ("round(2.5)", ["3"]), ("floor(-1.5)", ["-2"]), ("ceiling(1.2)", ["2"]),
    ("boolean(//nope)", ["false"]), ("not(//li)", ["false"]), ("//li = '3!'", ["true"]), ("//li != '1'", ["true"]), ("sum(//li[position() < 3])", ["3"]), ("starts-with(//a/@href, '/')", ["true"]), ("//title | //a", ["T & U", "Next"]),
    ("//li[lang('en')]", ["1", "2", "3!", "4", "5"]), ("id('results')/div[2]/h2", ["B"]), ("//*[self::b or self::p]", ["", "!"]), ("/html/body/ul/li[2]", ["2"]), ("/div", []), ("//ul/descendant::b", ["!"]), ("//namespace::*", []),
    ("count(//title/following::li)", ["5"]), ("count(//b/preceding::li)", ["2"]), ("string-length('abc')", ["3"]), ("//div[h2='B']/@data-rank", ["2"]), ("true() and false()", ["false"]), ("local-name(//svg:a)", ["a"]),
])
def test_xpath(expression, want):
    assert xpath.strings(Dom(PAGE), expression) == want


def test_xpath_errors():
    for bad in ("//", "//a[", "1 +", "a b"):
        with pytest.raises(xpath.XPathError):
            xpath.parse(bad)
    for bad in ("sideways::a", "nope(1)"):
        with pytest.raises(xpath.Unsupported):
            xpath.parse(bad)


def test_sets_of_nodes(tables):
    n, _ = tables
    li = relational.select(n, "li")
    assert relational.concatenate(li, li).count() == 10 and relational.difference(li, relational.select(n, "li.x")).count() == 4
    assert relational.intersection(li, li).count() == 5 and relational.first(li).select("data").count() == 1
    assert [r["text"] for r in relational.text(n, relational.item(li, 1, 2)).orderBy("node_id").collect()] == ["2", "3!"]
    assert [r["text"] for r in relational.text(n, relational.item(li, -1)).collect()] == ["5"]


def test_more_of_sets(tables):
    n, _ = tables
    li = relational.select(n, "li")
    assert [r["text"] for r in relational.joined_text(n, li).collect()] == ["123!45"]
    assert relational.without_last(li).count() == relational.without_first(li).count() == 4
    assert sorted(r["ord"] for r in relational.reverse(li).collect()) == [1, 2, 3, 4, 5]
    assert [r["index"] for r in relational.index_of(li, relational.select(n, "li.x")).collect()] == [1]
    assert {r["included"] for r in relational.includes(li, relational.select(n, "h2")).collect()} == {False}
