import datetime

import pytest
from pyspark.sql import functions as F

from arborspark.functions import builder, coerce
from arborspark.operators import extract, mutate
from arborspark.operators.nodes import nodes
from arborspark.plans.schema import Schema, SchemaError

CARD = """<div class="card" data-id="42"><h2>  Widget
 A </h2><span class="price">EUR 1.234,56</span><span class="n">about 1,024 pcs</span><span class="f">~ 3.50 kg</span><b class="on">Yes</b><time>March 5, 2024</time>
<a href="/w?a=1&amp;b=2">link</a><a href="https://y.test/z">other</a><i class="tags">red,  green ,,blue</i><script class="j">{"b": [1, 2], "a": null}</script><ul><li>1</li><li>x</li><li>3</li></ul></div>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://x.test/p/", CARD), (2, "https://x.test/", CARD + CARD), (3, None, "<p>none</p>"), (4, None, None)], "page_id long, url string, html string")


INNER = (
    Schema().field("title", "h2", clean=True).field("price", ".price", type="money").field("n", ".n", type="integer").field("f", ".f", type="float").field("on", ".on", type="boolean").field("day", "time", type="date")
    .field("tags", ".tags", type="list").field("id", attr="data-id", type="integer").field("alt", [".missing", "h3", "a"]).field("items", "li", type="integer", multi=True).field("size", ".size", default="M")
)
SCHEMA = Schema().repeated(".card", "cards", INNER)


def test_both_engines_give_the_same_rows(pages):
    a = {r["page_id"]: r["cards"] for r in extract.extract(pages, SCHEMA).collect()}
    b = {r["page_id"]: r["cards"] for r in extract.extract(pages, SCHEMA, engine="catalyst").collect()}
    assert a == b
    assert [len(a[k]) for k in (1, 2, 3, 4)] == [1, 2, 0, 0]
    c = a[1][0]
    assert (c["title"], c["price"], c["n"], c["f"], c["on"], c["day"], c["tags"], c["id"], c["alt"], c["items"], c["size"]) == ("Widget A", 1234.56, 1024, 3.5, True, datetime.date(2024, 3, 5), ["red", "green", "blue"], 42, "link", [1, 3], "M")


def test_addresses_json_html_and_transforms(pages):
    s = Schema().field("url", "a", attr="href", type="url", normalize_url=True).field("j", ".j", type="json").field("inner", "ul", type="html").field("loud", "h2", clean=True, transform=str.upper).field("rows", "li", type="array")
    r = extract.extract(pages, s, base_col="url").where("page_id = 1").first()
    assert (r["url"], r["j"], r["inner"], r["loud"], r["rows"]) == ("https://x.test/w?a=1&b=2", '{"a":null,"b":[1,2]}', "<li>1</li><li>x</li><li>3</li>", "WIDGET A", ["1", "x", "3"])


def test_required_values(pages):
    s = Schema().field("t", "h2", required=True)
    with pytest.raises(Exception, match="no value for 't'"):
        extract.extract(pages, s).collect()
    assert {r["page_id"] for r in extract.extract(pages, s, on_missing="drop").collect()} == {1, 2}
    assert [r["page_id"] for r in extract.extract(pages, s, on_missing="null").where("_error is not null").orderBy("page_id").collect()] == [3, 4]


def test_schema_round_trip():
    assert Schema.from_json(SCHEMA.to_json()) == SCHEMA
    with pytest.raises(SchemaError):
        Schema().field("x", "a", transform=str).to_json()
    with pytest.raises(SchemaError):
        Schema().field("x", "a", type="nope")


VALUES = ["EUR 1.234,56", "$1,234.56", "$19.99", "none", "1,23,456", "1234,567", "1.234.567", "-5", "3.", "12-3", "-", "", "  Yes ", "off", "maybe", "2024-02-30", "2024-02-29T10:00", "5 Mar 2024", "01/31/2024", "a , b,, c", "0007", "1.2.3", "..5", "abc-12.5x"]


def test_columns_equal_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    v = F.col("v")
    got = df.select("v", coerce.money_col(v).alias("money"), coerce.integer_col(v).alias("integer"), coerce.float_col(v).alias("floating"), coerce.boolean_col(v).alias("boolean"), coerce.date_col(v).alias("date"), coerce.list_col(v).alias("listing"))
    for r in got.collect():
        for name in ("money", "integer", "floating", "boolean", "date", "listing"):
            assert r[name] == getattr(coerce, name)(r["v"]), (name, r["v"])


def test_absolute():
    assert coerce.absolute("../a", "https://x.test/b/c") == "https://x.test/a"
    assert coerce.absolute("mailto:x", None) == "mailto:x" and coerce.absolute("http://y/z", "https://x.test") == "http://y/z" and coerce.absolute("//h/p", "https://x.test") == "https://h/p"


def test_edits(pages):
    html = '<div id=a class="x y"><p>1</p><p>2</p></div>'
    E = mutate.Edit
    cases = [
        (E("set_attribute", "p", "k", 'v"'), '<div id="a" class="x y"><p k="v&quot;">1</p><p k="v&quot;">2</p></div>'), (E("remove_attribute", "div", "class"), '<div id="a"><p>1</p><p>2</p></div>'),
        (E("remove_class", "div", value="x"), '<div id="a" class="y"><p>1</p><p>2</p></div>'), (E("remove", "p:first-child"), '<div id="a" class="x y"><p>2</p></div>'), (E("content", "p", value="<"), '<div id="a" class="x y"><p>&lt;</p><p>&lt;</p></div>'),
        (E("wrap", "p:last-child", value="<b></b>"), '<div id="a" class="x y"><p>1</p><b><p>2</p></b></div>'), (E("before", "p:first-child", value="<i>0</i>"), '<div id="a" class="x y"><i>0</i><p>1</p><p>2</p></div>'),
        (E("replace", "p", value="<u></u>"), '<div id="a" class="x y"><u></u><u></u></div>'), (E("append", "div", value="<p>3</p>"), '<div id="a" class="x y"><p>1</p><p>2</p><p>3</p></div>'), (E("rename", "p", "q"), '<div id="a" class="x y"><q>1</q><q>2</q></div>'),
    ]
    for e, want in cases:
        assert mutate.apply(html, [e]) == want
    assert nodes(mutate.mutate(pages, [E("remove", ".card")])).where("tag = 'div'").count() == 0
    with pytest.raises(ValueError):
        E("explode", "p")


def test_builder():
    t = builder.tag
    assert t("a", "x < y", t("br"), [builder.Raw("<i>")], href="/?a&'", data_id=5, hidden=True, title=None, class_="k") == '<a href="/?a&amp;&#39;" data-id="5" hidden class="k">x &lt; y<br><i></a>'
    assert builder.doctype() + builder.comment(" c ") == "<!DOCTYPE html><!-- c -->"
