"""Registered queries over pages built from the columns of part: every row is a page whose answers SQL can state by arithmetic.

The markup holds what the raw pages lack (forms, languages, empty elements, siblings of mixed tags), in numbers that follow
p_size, so that a selector's count is an expression of that column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, print_of, query, table
from .functions import coerce, encoding, html, sax
from .operators import extract, mutate, navigate, relational, structured
from .operators.nodes import map_rows, nodes
from .plans import css, xpath
from .plans.schema import Schema
from .sources import crawl, http, robots
from .streaming import rows as streams


def built(spark, sf_dir: str) -> DataFrame:
    """page_id, url, html of a page for each part."""
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    some = lambda n, text: F.when(s % n == 0, F.lit(text)).otherwise(F.lit(""))
    key = F.col("p_partkey").cast("string")
    parts = [
        F.lit("<html><head><title>"), coerce.escape_col(F.col("p_name")), F.lit('</title></head><body><div id="main" lang="'), F.when(s % 2 == 0, "en-us").otherwise("english"), F.lit('">'),
        F.lit("<ul>"), F.expr("repeat('<li>x</li>', p_size % 4 + 1)"), F.lit("</ul>"), F.when(s % 2 == 0, F.lit("<p></p>")).otherwise(F.lit("<p>t<b>u</b>v</p>")),
        F.lit('<form action="/find" method="'), F.when(s % 2 == 0, "post").otherwise("get"), F.lit('"><input name="a" value="'), key, F.lit('"'), some(2, " disabled"), F.lit('><input name="b"'), some(3, " required"),
        F.lit('><input name="c" type="checkbox"'), some(5, " checked"), F.lit('><input name="d"'), some(7, " readonly"), F.lit("></form>"),
        F.lit('<a href="/p/'), key, F.lit('">go</a><a>no</a><h2>'), F.col("p_brand"), F.lit("</h2><h2>"), F.format_string("%.1f", "p_retailprice"), F.lit("</h2><span>only</span></div></body></html>"),
    ]
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://x.test/p/"), key).alias("url"), F.concat(*parts).alias("html"))


def _counted(name: str, wanted: dict[str, tuple[str, str]]) -> None:
    """Registers a query of the number of nodes that each selector matches on every page; wanted has a selector and SQL by column."""

    def run(spark, sf_dir):
        got = extract.extract_css(built(spark, sf_dir), {k: s for k, (s, _) in wanted.items()})
        return got.select("page_id", *[F.size(k).alias(k) for k in wanted])

    QUERIES[name] = run
    ORACLES[name] = "SELECT p_partkey AS page_id, " + ", ".join(f"CAST({sql} AS INTEGER) AS {k}" for k, (_, sql) in wanted.items()) + " FROM part"


_LI = "(p_size % 4 + 1)"


def _if(n: int) -> str:
    return f"(CASE WHEN p_size % {n} = 0 THEN 1 ELSE 0 END)"


_counted("q_pseudo_states", {
    "disabled": ("input:disabled", _if(2)), "enabled": ("input:enabled", f"4 - {_if(2)}"), "required": ("input:required", _if(3)), "optional": ("input:optional", f"4 - {_if(3)}"),
    "checked": ("input:checked", _if(5)), "read_only": ("input:read-only", _if(7)), "read_write": ("input:read-write", f"4 - {_if(7)}"),
    "any_link": ("a:any-link", "1"), "link": ("a:link", "1"), "hover": ("a:hover", "0"), "visited": ("a:visited", "0"), "focus": ("input:focus", "0"),
})
_counted("q_pseudo_structure", {
    "by_id": ("#main", "1"), "dash": ("[lang|=en]", _if(2)), "first_of_type": ("h2:first-of-type", "1"), "last_of_type": ("div > :last-of-type", "6"), "only_of_type": ("li:only-of-type", f"CASE WHEN {_LI} = 1 THEN 1 ELSE 0 END"),
    "only_span": ("span:only-of-type", "1"), "empty": ("p:empty", _if(2)), "root": (":root", "1"), "root_child": (":root > body", "1"), "either": (":is(h2, span)", "3"), "where": ("div > :where(p, ul)", "2"),
    "matches": (":matches(h2)", "2"), "inner": (":is(ul, form) > :not(:first-child)", f"{_LI} - 1 + 3"),
})


@query(f"SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS ord, 'x' AS first, CAST({_LI} AS INTEGER) AS n_child FROM part")
def q_scoped(spark, sf_dir):
    """A leading combinator and :scope, inside each node that an outer selector matches."""

    def compute(dom, row):
        for k, i in enumerate(css.select(dom, "ul")):
            yield k, next(iter(css.values(dom, ":scope > li", i)), None), len(css.select(dom, "> li", i))

    return map_rows(built(spark, sf_dir), "html", compute, "ord int, first string, n_child int", ("page_id",))


@query("SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN [] ELSE ['t', 'v'] END AS direct, [p_brand, printf('%.1f', p_retailprice), '/p/' || p_partkey, NULL] AS mixed FROM part")
def q_pseudo_elements(spark, sf_dir):
    """The text of a node itself, and a group whose members read different things."""

    def compute(dom, row):
        p = css.select(dom, "p")[0]
        yield dom.direct_texts(p), css.values(dom, "h2::text, a::attr(href)")

    return map_rows(built(spark, sf_dir), "html", compute, "direct array<string>, mixed array<string>", ("page_id",))


@query("SELECT * FROM (VALUES ('div >> p', false), ('p:nth-child(x)', false), ('a[href', false), ('p:unheard-of', true), ('a, b', true), ('> p', true)) t(selector, valid)")
def q_selector_errors(spark, sf_dir):
    def valid(s: str) -> bool:
        try:
            css.parse(s)
        except css.SelectorError:
            return False
        return True

    given = ["div >> p", "p:nth-child(x)", "a[href", "p:unheard-of", "a, b", "> p"]
    return spark.createDataFrame([(s, valid(s)) for s in given], "selector string, valid boolean")


@query("SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS ord, '//div[@id=''main'']/span' AS path FROM part")
def q_xpath_path(spark, sf_dir):
    return extract.matching(built(spark, sf_dir), "span").select("page_id", "ord", F.regexp_replace("xpath_path", r"\[1\]", "").alias("path"))


def _xpath(name: str, expression: str, kind: str, sql: str) -> None:
    def run(spark, sf_dir):
        return extract.xpath(built(spark, sf_dir), expression).select("page_id", "ord", F.col("value").cast(kind).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS ord, {sql} AS value FROM part"


for _name, _expression, _kind, _sql in [
    ("q_xpath_following", "count(//ul/following::*)", "bigint", f"CAST(11 + 1 - {_if(2)} AS BIGINT)"),
    ("q_xpath_preceding", "count(//span/preceding::h2) + count(//span/preceding::li)", "bigint", f"CAST(2 + {_LI} AS BIGINT)"),
    ("q_xpath_namespace", "count(//div/namespace::*)", "bigint", "CAST(0 AS BIGINT)"),
    ("q_xpath_set_comparison", "//h2 > 950 and //h2 = 'Brand#2'", "boolean", "p_retailprice > 950 AND p_brand = 'Brand#2'"),
    ("q_xpath_lang", "count(//li[lang('en')])", "bigint", f"CAST({_LI} * {_if(2)} AS BIGINT)"),
    ("q_xpath_boolean", "boolean(//input[@checked]) or not(true())", "boolean", "p_size % 5 = 0"),
    ("q_xpath_numbers", "floor(number(//h2[2])) + ceiling(0.2) + round(2.5) + sum(//input[@name = 'a']/@value)", "bigint", "CAST(floor(p_retailprice) + 1 + 3 + p_partkey AS BIGINT)"),
    ("q_xpath_filter", "string((//h2)[last() - 1]/following-sibling::*[2])", "string", "'only'"),
]:
    _xpath(_name, _expression, _kind, _sql)


@query("SELECT * FROM (VALUES ('//a[', false), ('unknown(1)', false), ('1 +', false), ('//a[1]/@href', true)) t(expression, valid)")
def q_xpath_errors(spark, sf_dir):
    def valid(s: str) -> bool:
        try:
            xpath.strings(html.Dom("<a href=x></a>"), s)
        except xpath.XPathError:
            return False
        return True

    return spark.createDataFrame([(s, valid(s)) for s in ("//a[", "unknown(1)", "1 +", "//a[1]/@href")], "expression string, valid boolean")


@query(f"SELECT p_partkey AS page_id, CAST({_LI} AS BIGINT) AS n, repeat('x', {_LI}) AS joined, CAST({_LI} - 1 AS BIGINT) AS popped, CAST({_LI} - 1 AS BIGINT) AS shifted, CAST({_LI} - 1 AS BIGINT) AS last_index, CAST({_LI} AS BIGINT) AS included, CAST({_LI} AS BIGINT) AS under_lists FROM part")
def q_node_set_methods(spark, sf_dir):
    """Reverse, pop, shift, index, include, joined text, children and a selector within a set."""
    n = relational.parsed_once(nodes(built(spark, sf_dir).select("page_id", "html")))
    items, lists = relational.select(n, "li"), relational.select(n, "ul")
    count = lambda d, name: d.groupBy("page_id").agg(F.count("*").alias(name))
    last = relational.index_of(items, relational.item(items, -1)).select("page_id", F.col("index").cast("bigint").alias("last_index"))
    found = relational.includes(items, navigate.children(n, lists)).where("included")
    parts = [
        count(relational.reverse(items), "n"), relational.joined_text(n, items).withColumnRenamed("text", "joined"), count(relational.without_last(items), "popped"), count(relational.without_first(items), "shifted"),
        last, count(found, "included"), count(relational.select(n, "ul > li"), "under_lists"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "page_id", "left")
    return out.na.fill(0, ["popped", "shifted"])


@query(f"SELECT p_partkey AS page_id, upper(p_brand) AS shout, CAST({_LI} * {_if(2)} AS BIGINT) AS kept FROM part")
def q_map_select_reject(spark, sf_dir):
    """A set's map, select and reject are DataFrame operations on its rows."""
    p = built(spark, sf_dir)
    h2 = extract.extract_each(p, "h2", {"text": "::text"})
    shout = h2.where("ord = 0").select("page_id", F.upper("text").alias("shout"))
    li = extract.extract_each(p, "[lang|=en] li", {"text": "::text"}).where(~(F.col("text") == "y"))
    return shout.join(li.groupBy("page_id").agg(F.count("*").alias("kept")), "page_id", "left").na.fill(0, ["kept"])


_SCHEMA = (
    Schema()
    .field("items", ["nav li", "ul li"], multi=True)
    .field("price", "h2:last-of-type", type="float")
    .field("inner", "p b", default="none")
    .field("loud", "h2", transform=str.upper)
)


@query(f"SELECT p_partkey AS page_id, CAST({_LI} AS INTEGER) AS n_items, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'u' END AS inner_text, upper(p_brand) AS loud FROM part")
def q_schema_options(spark, sf_dir):
    """Fallbacks of several values, a default, a transform."""
    got = extract.extract(built(spark, sf_dir), _SCHEMA)
    return got.select("page_id", F.size("items").alias("n_items"), "price", F.col("inner").alias("inner_text"), "loud")


@query("SELECT p_partkey AS page_id, 'u' AS inner_text FROM part WHERE p_size % 2 = 1")
def q_schema_required(spark, sf_dir):
    schema = Schema().field("inner_text", "p b", required=True)
    return extract.extract(built(spark, sf_dir), schema, on_missing="drop")


@query("SELECT p_partkey AS page_id, p_brand AS brand, p_retailprice AS price FROM part")
def q_schema_json(spark, sf_dir):
    """A schema that was written as JSON and read again."""
    schema = Schema.from_json(Schema().field("brand", "h2").field("price", "h2:last-of-type", type="float").to_json())
    return extract.extract(built(spark, sf_dir), schema)


@query("SELECT p_partkey AS page_id, CAST(floor(p_retailprice) AS BIGINT) AS whole, p_retailprice AS decimal FROM part")
def q_number(spark, sf_dir):
    """number: a whole number where nothing follows the digits, else a decimal."""
    p = table(spark, sf_dir, "part")
    shown = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("about "), F.floor("p_retailprice").cast("string")).alias("a"), F.concat(F.format_string("%.1f", "p_retailprice"), F.lit(" each")).alias("b"))
    whole, decimal = F.udf(coerce.number, "long"), F.udf(lambda v: float(coerce.number(v)), "double")
    return shown.select("page_id", whole("a").alias("whole"), decimal("b").alias("decimal"))


@query("SELECT p_partkey AS page_id, substr(sha256('https://x.test/p/' || p_partkey), 1, 32) AS key FROM part")
def q_cache_key(spark, sf_dir):
    return built(spark, sf_dir).select("page_id", http.cache_key(F.col("url")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'utf-8' WHEN p_size % 3 = 0 THEN 'iso-8859-1' END AS charset FROM part")
def q_charset(spark, sf_dir):
    s = F.col("p_size")
    header = F.when(s % 2 == 0, "text/html; charset=UTF-8").when(s % 3 == 0, 'text/html; charset="ISO-8859-1"').otherwise("text/html")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.nullif(coerce.charset_col(header), F.lit(""))).alias("charset"))


@query("SELECT * FROM (VALUES ('UTF8', 'utf-8'), ('latin1', 'windows-1252'), ('Shift_JIS', 'shift_jis'), ('ascii', 'windows-1252')) t(label, encoding)")
def q_encoding_names(spark, sf_dir):
    return spark.createDataFrame([(x, encoding.normalize(x)) for x in ("UTF8", "latin1", "Shift_JIS", "ascii")], "label string, encoding string")


@query(f"SELECT p_partkey AS page_id, CAST({_LI} AS INTEGER) AS n_marked, CAST(0 AS INTEGER) AS n_lang, CAST(1 AS INTEGER) AS n_wrapped, CAST(2 AS INTEGER) AS n_hr, CAST(0 AS INTEGER) AS n_span, CAST(1 AS INTEGER) AS n_swapped FROM part")
def q_edits(spark, sf_dir):
    """Attributes set and removed, nodes wrapped, inserted before and after, replaced, swapped."""
    edits = [
        mutate.Edit("set_attribute", "li", "data-x", "1"), mutate.Edit("remove_attribute", "#main", "lang"), mutate.Edit("wrap", "ul", value="<section></section>"),
        mutate.Edit("before", "form", value="<hr>"), mutate.Edit("after", "form", value="<hr>"), mutate.Edit("replace", "span", value="<em>new</em>"), mutate.Edit("swap", "em", value="<i>x</i>"),
    ]
    found = {"n_marked": 'li[data-x="1"]', "n_lang": "[lang]", "n_wrapped": "section > ul", "n_hr": "hr + form, form + hr", "n_span": "span", "n_swapped": "i"}
    got = extract.extract_css(mutate.mutate(built(spark, sf_dir), edits), {k: (v if k != "n_hr" else "hr") for k, v in found.items()})
    return got.select("page_id", *[F.size(k).alias(k) for k in found])


@query("SELECT p_partkey AS page_id, CASE WHEN p_size % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, 'https://x.test/find' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '?a=' || p_partkey || '&b=new' || CASE WHEN p_size % 5 = 0 THEN '&c=on' ELSE '' END END AS url, CASE WHEN p_size % 2 = 0 THEN 'a=' || p_partkey || '&b=new' || CASE WHEN p_size % 5 = 0 THEN '&c=on' ELSE '' END END AS body FROM part")
def q_form_request(spark, sf_dir):
    """Submissions with a value overridden and another deleted."""

    def compute(dom, row):
        form = crawl.Form(dom, css.select(dom, "form")[0], row["url"])
        r = form.delete("d").request({"b": "new"})
        yield r["method"], r["url"], r["body"]

    return map_rows(built(spark, sf_dir), "html", compute, "method string, url string, body string", ("page_id",), ("url",))


@query("SELECT * FROM (VALUES ('crawler', CAST(2.5 AS DOUBLE), 2), ('special', 7.0, 2), ('other', 2.5, 2)) t(agent, delay, n_sitemaps)")
def q_robots_meta(spark, sf_dir):
    r = robots.parse("User-agent: *\nCrawl-delay: 2.5\n\nUser-agent: special\nCrawl-delay: 7\nSitemap: https://x.test/a.xml\nSitemap: https://x.test/b.xml\n")
    rows = [(a, r.crawl_delay(a), len(r.sitemaps)) for a in ("crawler", "special", "other")]
    return spark.createDataFrame(rows, "agent string, delay double, n_sitemaps int")


@query(f"SELECT p_partkey AS page_id, CAST({_LI} AS INTEGER) AS whole, CAST({_LI} AS INTEGER) AS cut, CAST({_LI} - 1 AS INTEGER) AS truncated, CAST(4 AS INTEGER) AS closed FROM part")
def q_stream_chunks(spark, sf_dir):
    """Rows do not depend on where chunks are cut; a row that never ends is not given; void elements are rows of their own."""

    def compute(dom, row):
        raw = row["html"].encode()
        pieces = [raw[i : i + 7] for i in range(0, len(raw), 7)]
        half = raw[: raw.rindex(b"</li>")]
        yield tuple(len(list(streams.split_rows(c, t))) for c, t in (([raw], "li"), (pieces, "li"), ([half], "li"), (pieces, "input")))

    return map_rows(built(spark, sf_dir), "html", compute, "whole int, cut int, truncated int, closed int", ("page_id",), ("html",))


_TOP = [(1, "html"), (2, "head"), (3, "title"), (2, "body"), (3, "div"), *((4, t) for t in ("ul", "p", "form", "a", "a", "h2", "h2", "span"))]


@query(f"SELECT p_partkey AS page_id, CAST({print_of(*_TOP)} AS BIGINT) AS fingerprint FROM part")
def q_fingerprints(spark, sf_dir):
    return structured.fingerprints(built(spark, sf_dir))


@query(f"SELECT p_partkey AS page_id, CAST(13 + {_LI} + 4 + 1 - {_if(2)} AS INTEGER) AS starts, CAST(6 + {_LI} + 3 * (1 - {_if(2)}) AS INTEGER) AS texts FROM part")
def q_handlers(spark, sf_dir):
    """Event handlers, counting what they are told."""

    class Count(sax.Handler):
        def __init__(self):
            self.starts = self.texts = 0

        def start_element(self, name, attrs):
            self.starts += 1

        def characters(self, text):
            self.texts += 1

    def compute(dom, row):
        c = sax.parse(row["html"], Count())
        yield c.starts, c.texts

    return map_rows(built(spark, sf_dir), "html", compute, "starts int, texts int", ("page_id",), ("html",))
