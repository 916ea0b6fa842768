"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

Queries over pages parse them where they lie and shuffle nothing, unless their name says relational or their result is an
aggregate. Fixture queries run an operator over a few rows given inline; their SQL is the literal answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import builder, coerce, entities
from .functions.html import ELEMENT
from .operators import arrays, extract, mutate, navigate, relational, structured, templates
from .operators.nodes import nodes, parse, tokens
from .plans.schema import Schema
from .sources import cache, crawl, files, robots
from .streaming import rows as streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query of (spark, sf_dir) under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all pages, parsed once however often a query reads them."""
    return relational.parsed_once(nodes(_pages(spark, sf_dir)))


def _text(expression: str) -> str:
    """SQL that decodes the references that the pages hold."""
    return f"replace(replace(replace(replace({expression}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


_LINKS = "SELECT page_id, unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)))) AS ord, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS t FROM pages"
_LINK_ROWS = f"SELECT page_id, CAST(ord AS INTEGER) AS ord, {_text('h')} AS href, {_text('t')} AS text FROM ({_LINKS})"
_N = "SELECT page_id, n, unnest(range(1, n + 1)) AS i FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages)"


# --- selectors ------------------------------------------------------------------------------------------------------------


@query(_LINK_ROWS)
def q_links(spark, sf_dir):
    return extract.extract_each(_pages(spark, sf_dir), "nav li > a[href]", {"href": "::attr(href)", "text": "::text"})


@query(_LINK_ROWS)
def q_links_relational(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    found = relational.ranked(relational.select(n, "nav li > a[href]"))
    text = relational.text(n, relational.select(n, "nav li > a[href]"))
    return found.join(text, ["page_id", "node_id"]).select("page_id", (F.col("ord") - 1).alias("ord"), F.element_at("attrs", F.lit("href")).alias("href"), "text")


@query(_LINK_ROWS)
def q_links_arrays(spark, sf_dir):
    dom = F.col("dom")
    found = parse(_pages(spark, sf_dir)).select("page_id", "dom", F.posexplode(arrays.select(dom, "nav li > a[href]")).alias("ord", "n"))
    return found.select("page_id", "ord", F.element_at(F.col("n.attrs"), F.lit("href")).alias("href"), arrays.text(dom, F.col("n")).alias("text"))


@query(f"SELECT page_id, {_text("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, {_text("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def q_title_h1_lang(spark, sf_dir):
    return extract.extract_map(_pages(spark, sf_dir), {"title": "title", "h1": "article > h1", "lang": "html::attr(lang)"})


_TAGS = ("a", "article", "b", "body", "br", "div", "footer", "h1", "head", "html", "li", "meta", "nav", "p", "script", "style", "title", "ul")


@query(" UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, CAST(len(regexp_extract_all(h, '<{t}[ >]')) AS BIGINT) AS n FROM (SELECT page_id, regexp_replace(html, '(<script>).*?(</script>)', '\\1\\2', 'g') AS h FROM pages) WHERE len(regexp_extract_all(h, '<{t}[ >]')) > 0" for t in _TAGS))
def q_tag_counts(spark, sf_dir):
    return _nodes(spark, sf_dir).where(F.col("node_type") == ELEMENT).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _counts(spark, sf_dir, selector: str) -> DataFrame:
    found = relational.select(_nodes(spark, sf_dir), selector)
    return found.groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_N}) WHERE i % 2 = 1 GROUP BY page_id")
def q_nth_child_odd(spark, sf_dir):
    return _counts(spark, sf_dir, "ul > li:nth-child(2n+1)")


@query(f"SELECT page_id, count(*) AS n FROM ({_N}) WHERE n - i + 1 = 2 GROUP BY page_id")
def q_nth_last_child(spark, sf_dir):
    return _counts(spark, sf_dir, "li:nth-last-child(2)")


@query(f"SELECT page_id, count(*) AS n FROM ({_N}) WHERE i = 1 OR i = n GROUP BY page_id")
def q_first_or_last_child(spark, sf_dir):
    return _counts(spark, sf_dir, "li:first-child, li:last-child")


@query(f"SELECT page_id, count(*) AS n FROM ({_N}) WHERE i >= 3 GROUP BY page_id")
def q_general_sibling(spark, sf_dir):
    return _counts(spark, sf_dir, "li:nth-of-type(2) ~ li")


@query(f"SELECT page_id, count(*) AS n FROM ({_N}) WHERE i >= 2 GROUP BY page_id")
def q_adjacent_sibling(spark, sf_dir):
    return _counts(spark, sf_dir, "li + li")


@query("SELECT page_id, CAST(1 AS BIGINT) AS n FROM pages")
def q_child(spark, sf_dir):
    return _counts(spark, sf_dir, "article > p")


@query("SELECT page_id, n FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) - 1 AS BIGINT) AS n FROM pages) WHERE n > 0")
def q_descendant(spark, sf_dir):
    return _counts(spark, sf_dir, "article b p")


@query("SELECT page_id, CAST(1 AS BIGINT) AS n FROM pages WHERE html LIKE '%<article>%<h1>%'")
def q_has(spark, sf_dir):
    return _counts(spark, sf_dir, "body article:has(> h1)")


@query("SELECT page_id, CAST(1 AS BIGINT) AS n FROM pages WHERE len(regexp_extract_all(html, '<li>')) < 6")
def q_not_has(spark, sf_dir):
    return _counts(spark, sf_dir, "ul:not(:has(li:nth-child(6)))")


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS h FROM pages) WHERE starts_with(h, '/th') OR ends_with(h, 'n') OR contains(h, 'er') GROUP BY page_id")
def q_attribute_operators(spark, sf_dir):
    return _counts(spark, sf_dir, 'a[href^="/th"], a[href$="n"], a[href*="er"]')


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS h FROM pages) WHERE starts_with(lower(h), '/th') AND NOT ends_with(h, 'n') GROUP BY page_id")
def q_attribute_fold_not(spark, sf_dir):
    return _counts(spark, sf_dir, 'a[href^="/TH" i]:not([href$="n"])')


@query("SELECT page_id, 'except' AS op, CAST(n - 1 AS BIGINT) AS n FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages) WHERE n > 1 UNION ALL SELECT page_id, 'intersect', CAST(1 AS BIGINT) FROM pages WHERE html LIKE '%<li>%' UNION ALL SELECT page_id, 'union all', CAST(n + 1 AS BIGINT) FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages) WHERE n > 0")
def q_node_sets(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    every, first = relational.select(n, "li"), relational.select(n, "li:first-child")
    made = {"except": relational.difference(every, first), "intersect": relational.intersection(every, first), "union all": relational.concatenate(every, first)}
    parts = [d.groupBy("page_id").agg(F.count("*").alias("n")).withColumn("op", F.lit(k)) for k, d in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH l AS ({_LINKS}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord DESC) AS r FROM l) SELECT page_id, {_text('t')} AS text FROM k WHERE r = 2")
def q_item_from_end(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return relational.text(n, relational.item(relational.select(n, "nav a"), -2)).select("page_id", "text")


@query(f"SELECT page_id, [{_text('x')} for x in regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)] AS hrefs, [{_text("regexp_extract(html, '<title>(.*?)</title>', 1)")}] AS titles FROM pages")
def q_batch_css(spark, sf_dir):
    return extract.extract_css(_pages(spark, sf_dir), {"hrefs": "a::attr(href)", "titles": "title"})


@query("SELECT page_id, CAST(0 AS INTEGER) AS ord, 'html:nth-of-type(1) > body:nth-of-type(1) > article:nth-of-type(1) > h1:nth-of-type(1)' AS css_path FROM pages")
def q_css_path(spark, sf_dir):
    return extract.matching(_pages(spark, sf_dir), "h1").select("page_id", "ord", "css_path")


@query("SELECT page_id, regexp_extract(html, '<!--(.*?)-->', 1) AS comment, regexp_extract(html, '<!DOCTYPE ([^>]*)>', 1) AS doctype FROM pages")
def q_comment_doctype(spark, sf_dir):
    t = tokens(_pages(spark, sf_dir)).where(F.col("kind").isin("comment", "doctype"))
    return t.groupBy("page_id").agg(F.max(F.when(F.col("kind") == "comment", F.col("data"))).alias("comment"), F.max(F.when(F.col("kind") == "doctype", F.col("name"))).alias("doctype"))


@query(" UNION ALL ".join([
    "SELECT page_id, 'comment' AS kind, CAST(len(regexp_extract_all(html, '<!--')) AS BIGINT) AS n FROM pages",
    "SELECT page_id, 'doctype', CAST(1 AS BIGINT) FROM pages",
    "SELECT page_id, 'start', CAST(len(regexp_extract_all(regexp_replace(html, '(<script>).*?(</script>)', '\\1\\2', 'g'), '<[a-z]')) AS BIGINT) FROM pages",
]))
def q_token_kinds(spark, sf_dir):
    return tokens(_pages(spark, sf_dir)).where(F.col("kind").isin("comment", "doctype", "start")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, 'li' AS tag, 'parent' AS step, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n FROM pages UNION ALL SELECT page_id, 'ul', 'ancestor', CAST(1 AS BIGINT) FROM pages UNION ALL SELECT page_id, 'li', 'next', CAST(len(regexp_extract_all(html, '<li>')) - 1 AS BIGINT) FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 1 UNION ALL SELECT page_id, 'li', 'child', CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) FROM pages UNION ALL SELECT page_id, 'li', 'first', CAST(1 AS BIGINT) FROM pages")
def q_navigation(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    links, items, lists = (relational.select(n, s) for s in ("nav a", "nav li", "nav ul"))
    steps = {"parent": navigate.parent(n, links), "ancestor": navigate.ancestors(n, links, "ul"), "next": navigate.next_element(n, items), "child": navigate.children(n, lists), "first": navigate.first_element_child(n, lists)}
    parts = [d.groupBy("page_id", "tag").agg(F.count("*").alias("n")).withColumn("step", F.lit(k)) for k, d in steps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT page_id, 'href' AS name, {_text('h')} AS value FROM ({_LINKS})")
def q_attributes(spark, sf_dir):
    return navigate.attributes(relational.select(_nodes(spark, sf_dir), "nav a")).select("page_id", "name", "value")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n, CAST(len(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1), lambda h: starts_with(h, '/th'))) AS BIGINT) AS n_hit FROM pages")
def q_matches(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    m = navigate.matches(n, relational.select(n, "nav a"), '[href^="/th"]')
    return m.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("matches").alias("n_hit"))


@query(f"SELECT page_id, CAST(0 AS INTEGER) AS ord, {_text("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS text, trim(regexp_replace({_text("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, '[ \t\r\n\f\v]+', ' ', 'g'), ' ') AS clean_text, false AS blank FROM pages")
def q_texts(spark, sf_dir):
    return navigate.texts(_pages(spark, sf_dir), "h1").select("page_id", "ord", "text", "clean_text", "blank")


@query(f"SELECT page_id, {_text("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, 'html' AS doctype, true AS has_head, true AS has_body, CAST(len(regexp_extract_all(regexp_replace(html, '(<script>).*?(</script>)', '\\1\\2', 'g'), '<[a-z]')) AS INTEGER) AS elements FROM pages")
def q_document_info(spark, sf_dir):
    return navigate.documents(_pages(spark, sf_dir)).select("page_id", "title", "doctype", "has_head", "has_body", "elements")


# --- xpath -----------------------------------------------------------------------------------------------------------------


def _xpath(expression: str, kind: str = "string"):
    def run(spark, sf_dir):
        return extract.xpath(_pages(spark, sf_dir), expression).select("page_id", "ord", F.col("value").cast(kind).alias("value"))

    return run


for _name, _expression, _kind, _sql in [
    ("q_xpath_count", "count(//nav//li)", "bigint", "SELECT page_id, CAST(0 AS INTEGER) AS ord, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS value FROM pages"),
    ("q_xpath_position", "//li[position() > 1 and position() < last()]/a/@href", "string", f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS ord, {_text('h')} AS value FROM (SELECT *, max(ord) OVER (PARTITION BY page_id) AS m FROM ({_LINKS})) WHERE ord > 0 AND ord < m"),
    ("q_xpath_last", "string(//li[last()])", "string", f"SELECT page_id, CAST(0 AS INTEGER) AS ord, {_text('t')} AS value FROM (SELECT *, max(ord) OVER (PARTITION BY page_id) AS m FROM ({_LINKS})) WHERE ord = m"),
    ("q_xpath_strings", "concat(substring(normalize-space(//title), 1, 5), '|', translate(/html/@lang, 'edfrns', 'EDFRNS'), '|', string-length(//h1))", "string", f"SELECT page_id, CAST(0 AS INTEGER) AS ord, substr(trim(t), 1, 5) || '|' || upper(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) || '|' || length({_text("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS value FROM (SELECT *, {_text("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS t FROM pages)"),
    ("q_xpath_axes", "name(//h1/following-sibling::*[1])", "string", "SELECT page_id, CAST(0 AS INTEGER) AS ord, 'p' AS value FROM pages"),
    ("q_xpath_ancestors", "count(//li[1]/ancestor::*)", "bigint", "SELECT page_id, CAST(0 AS INTEGER) AS ord, CAST(4 AS BIGINT) AS value FROM pages"),
    ("q_xpath_union", "//title/text() | //comment()", "string", f"SELECT page_id, CAST(0 AS INTEGER) AS ord, {_text("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS value FROM pages UNION ALL SELECT page_id, CAST(1 AS INTEGER), regexp_extract(html, '<!--(.*?)-->', 1) FROM pages"),
]:
    QUERIES[_name], ORACLES[_name] = _xpath(_expression, _kind), _sql


# --- extraction -------------------------------------------------------------------------------------------------------------

_SCHEMA = (
    Schema()
    .field("title", ["meta[name=none]", "title"], clean=True)
    .field("lang", "html", attr="lang", default="und")
    .field("hrefs", "nav a", attr="href", type="array")
    .field("n", "script", type="integer")
    .repeated("nav li", "links", Schema().field("href", "a", attr="href", type="url").field("text", "a"))
)
_SCHEMA_SQL = f"""SELECT page_id, trim(regexp_replace({_text("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '[ \t\r\n]+', ' ', 'g')) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS n, CAST(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS INTEGER) AS n_hrefs, {_text("regexp_extract(html, '<a href=\"([^\"]*)\">', 1)")} AS first_href,
CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS n_links, {_text("regexp_extract(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)")} AS first_text FROM pages"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("page_id", "title", "lang", "n", F.size("hrefs").alias("n_hrefs"), F.coalesce(F.get("hrefs", F.lit(0)), F.lit("")).alias("first_href"), F.size("links").alias("n_links"), F.coalesce(F.get("links", F.lit(0))["text"], F.lit("")).alias("first_text"))


@query(_SCHEMA_SQL)
def q_schema_arrow(spark, sf_dir):
    return _flat(extract.extract(_pages(spark, sf_dir), _SCHEMA))


@query(_SCHEMA_SQL)
def q_schema_catalyst(spark, sf_dir):
    return _flat(extract.extract(_pages(spark, sf_dir), _SCHEMA, engine="catalyst"))


@query("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, r AS row FROM (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<li>.*?</li>')))) AS i, unnest(regexp_extract_all(html, '<li>.*?</li>')) AS r FROM pages)")
def q_stream_rows(spark, sf_dir):
    return streams.rows(_pages(spark, sf_dir), "li")


@query(f"SELECT page_id, CAST(ord AS INTEGER) AS ord, {_text('h')} AS href FROM ({_LINKS})")
def q_stream_fields(spark, sf_dir):
    return streams.rows(_pages(spark, sf_dir), "li", {"href": "a::attr(href)"})


# --- documents as a whole ---------------------------------------------------------------------------------------------------


@query("SELECT page_id, 'class' AS attribute, CAST(1 AS BIGINT) AS n_left, CAST(0 AS BIGINT) AS n_nav FROM pages")
def q_mutate(spark, sf_dir):
    edits = [mutate.Edit("remove", "nav"), mutate.Edit("add_class", "h1", value="headline"), mutate.Edit("content", "footer", value="<end>")]
    changed = mutate.mutate(_pages(spark, sf_dir), edits)
    n = nodes(changed)
    left = F.count_if(F.array_contains("classes", "headline"))
    return n.groupBy("page_id").agg(left.alias("n_left"), F.count_if(F.col("tag") == "nav").alias("n_nav")).select("page_id", F.lit("class").alias("attribute"), "n_left", "n_nav")


@query("SELECT page_id, CAST(0 AS INTEGER) AS ord, regexp_extract(html, '<ul>.*?</ul>') AS markup FROM pages")
def q_serialize(spark, sf_dir):
    return mutate.serialize(_pages(spark, sf_dir), "nav ul")


@query("SELECT page_id, sha256(html) AS sha, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages")
def q_content_key(spark, sf_dir):
    return cache.keyed(_pages(spark, sf_dir)).select("page_id", "sha", F.octet_length("html").cast("bigint").alias("n_bytes"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n FROM pages")
def q_parse_distinct(spark, sf_dir):
    dom = cache.parse_distinct(_pages(spark, sf_dir))
    return dom.select("page_id", F.size(arrays.select(F.col("dom"), "li")).cast("bigint").alias("n"))


def print_of(*tags: tuple[int, str]) -> int:
    """The fingerprint of a page with these tags (with their depths) on its top levels, from its definition: FNV-1a of 64 bits."""
    h = 1469598103934665603
    for b in "".join(f"{d}:{t};" for d, t in tags).encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h - 2**64 if h >= 2**63 else h


#: The top levels of the raw pages, read off their markup.
_SKELETON = [(1, "html"), (2, "head"), (3, "meta"), (3, "title"), (3, "style"), (3, "script"), (2, "body"), (3, "nav"), (4, "ul"), (3, "div"), (3, "article"), (4, "h1"), (4, "p"), (3, "footer")]


@query(f"SELECT CAST({print_of(*_SKELETON)} AS BIGINT) AS fingerprint, count(*) AS n FROM pages")
def q_fingerprint_groups(spark, sf_dir):
    return structured.fingerprints(_pages(spark, sf_dir)).groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN len(regexp_extract_all(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>', '', 'g'), '\\S+')) >= 200 THEN 'article' ELSE 'unknown' END AS page_type FROM pages")
def q_page_types(spark, sf_dir):
    return structured.page_types(_pages(spark, sf_dir))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a'), (1, 'b'), (3, 'c')) t(page_id, name)")
def q_templates(spark, sf_dir):
    pages = _inline(spark, "<main><h1>a</h1></main>", "<main><h1>b</h1></main>", "<p>x</p>", "<div><b>c</b></div>")
    prints = {r["page_id"]: r["fingerprint"] for r in structured.fingerprints(pages).collect()}
    registry = templates.TemplateRegistry()
    registry.register(prints[0], Schema().field("name", "h1"))
    registry.register(prints[3], Schema().field("name", "b"))
    return registry.extract(pages).select("page_id", "name")


@query("SELECT page_id, 'utf-8' AS encoding, html FROM pages")
def q_decode_bytes(spark, sf_dir):
    raw = _pages(spark, sf_dir).select("page_id", F.encode("html", "utf-8").alias("content"))
    return files.decode_pages(raw, keep=("page_id",))


# --- scalar functions ---------------------------------------------------------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages")
def q_url_host(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", coerce.host_col(F.col("url")).alias("host"))


@query("SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def q_pages_per_host(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(coerce.host_col(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT l.page_id, CAST(l.ord AS INTEGER) AS ord, regexp_extract(p.url, '^[a-z]+://[^/?#]+') || {_text('l.h')} AS href FROM ({_LINKS}) l JOIN pages p USING (page_id)")
def q_url_absolute(spark, sf_dir):
    schema = Schema().repeated("nav a", "links", Schema().field("href", attr="href", type="url", normalize_url=True))
    got = extract.extract(_pages(spark, sf_dir), schema, base_col="url")
    return got.select("page_id", F.posexplode("links").alias("ord", "l")).select("page_id", "ord", F.col("l.href").alias("href"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') AS text FROM documents")
def q_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", coerce.clean_col(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM documents")
def q_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", coerce.escape_col(F.col("text"), quote=True).alias("text"))


@query("SELECT doc_id, text FROM documents")
def q_entities_round_trip(spark, sf_dir):
    escaped = coerce.escape_col(F.col("text"), quote=True, apostrophe=True)
    return table(spark, sf_dir, "documents").select("doc_id", entities.decode_col(escaped).alias("text"))


@query("""SELECT p_partkey, p_retailprice AS us, p_retailprice AS eu, CAST(floor(p_retailprice) AS BIGINT) AS whole, p_retailprice AS plain FROM part""")
def q_money(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    us = F.format_number("p_retailprice", 2)
    eu = F.translate(us, ",.", ".,")
    whole = F.format_number(F.floor("p_retailprice"), 0)
    return p.select("p_partkey", coerce.money_col(F.concat(F.lit("USD "), us)).alias("us"), coerce.money_col(F.concat(eu, F.lit(" EUR"))).alias("eu"), coerce.integer_col(F.concat(F.lit("~"), whole, F.lit(" pcs"))).alias("whole"), coerce.float_col(F.concat(F.lit("at "), F.regexp_replace(us, ",", ""))).alias("plain"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS us, CAST(o_orderdate AS DATE) AS words, o_orderstatus = 'F' AS flag FROM orders")
def q_dates_booleans(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    forms = {"iso": "yyyy-MM-dd'T'HH:mm", "us": "MM/dd/yyyy", "words": "MMMM d, yyyy"}
    flag = coerce.boolean_col(F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise("off")).alias("flag")
    return o.select("o_orderkey", *[coerce.date_col(F.date_format(d, f)).alias(k) for k, f in forms.items()], flag)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(coerce.json_col(F.col("props")), "$.k", "bigint").alias("k"))


@query("SELECT p_partkey, string_split(p_type, ' ') AS parts FROM part")
def q_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", coerce.list_col(F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit(" , ")), F.lit(" , "))).alias("parts"))


@query("SELECT p_partkey, '<li data-size=\"' || p_size || '\"><b>' || p_name || '</b></li>' AS markup FROM part")
def q_builder(spark, sf_dir):
    name = builder.tag_col("b", coerce.escape_col(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", builder.tag_col("li", name, data_size=F.col("p_size")).alias("markup"))


# --- fixtures: an operator over rows given inline ------------------------------------------------------------------------------


def _inline(spark: SparkSession, *html: str) -> DataFrame:
    return spark.createDataFrame([(i, "https://x.test/list?page=1", h) for i, h in enumerate(html)], "page_id long, url string, html string")


_LD = (
    '<script type="application/ld+json">{"@type":"Product","name":"A"}</script><script type="application/ld+json">broken</script>'
    '<script type="application/ld+json">[{"@graph":[{"name":"C"}]},{"@type":"Offer"}]</script>'
    '<script type="application/ld+json">{"@graph":[{"@type":["Person","Thing"],"name":"B"}]}</script>'
)


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS INTEGER), 'Product', '{"@type":"Product","name":"A"}'), (0, 1, NULL, '{"@graph":[{"name":"C"}]}'), (0, 2, 'Offer', '{"@type":"Offer"}'), (0, 3, 'Person', '{"@type":["Person","Thing"],"name":"B"}')) t(page_id, ord, type, item)""")
def q_json_ld(spark, sf_dir):
    return structured.json_ld(_inline(spark, _LD))


@query("""SELECT CAST(0 AS BIGINT) AS page_id, CAST(3 AS INTEGER) AS ord, '{"@type":["Person","Thing"],"name":"B"}' AS item""")
def q_schema_org(spark, sf_dir):
    return structured.schema_org(_inline(spark, _LD), "Person")


@query("SELECT CAST(0 AS BIGINT) AS page_id, 'First' AS title, 'article' AS type, 'summary' AS card")
def q_opengraph_twitter(spark, sf_dir):
    p = _inline(spark, '<meta property="og:title" content="First"><meta property="og:title" content="Second"><meta name="og:type" content="article"><meta name="twitter:card" content="summary">')
    og, tw = structured.opengraph(p), structured.twitter_card(p).withColumnRenamed("properties", "tw")
    get = lambda c, k: F.element_at(c, F.lit(k))
    return og.join(tw, "page_id").select("page_id", get("properties", "title").alias("title"), get("properties", "type").alias("type"), get("tw", "card").alias("card"))


@query("""SELECT CAST(0 AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS ord, 'https://schema.org/Product' AS type, '{"properties":{"image":["/a.png","/b.png"],"name":"Widget","offers":{"properties":{"price":"9"},"type":"https://schema.org/Offer"}},"type":"https://schema.org/Product"}' AS item""")
def q_microdata(spark, sf_dir):
    return structured.microdata(_inline(spark, '<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name"> Widget </h1><img itemprop="image" src="/a.png"><img itemprop="image" src="/b.png"><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="9"></div></div>'))


@query("""SELECT CAST(0 AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS ord, 'Person' AS type, '{"about":"#me","properties":{"birth":"May 1","headline":"Ann  B","name":["Ann  B","A."],"url":"x"},"type":"Person"}' AS item""")
def q_rdfa(spark, sf_dir):
    return structured.rdfa(_inline(spark, '<div typeof="Person" about="#me"><span property="name headline"> Ann  B </span><a property="url" href="/ann">x</a><time property="birth" datetime="1990-05-01">May 1</time><meta property="name" content="A."></div>'))


_KINDS = [
    ('<script type="application/ld+json">{"@type":"Product"}</script>', "product_page"),
    ('<meta property="og:type" content="article">', "article"),
    ('<input type="search"><ul></ul>', "search_results"),
    ("".join(f'<div class="product-card">{i}</div>' for i in range(6)), "product_listing"),
    ('<article>short<p class="byline">by</p></article>', "article"),
    ('<div class="avatar"></div><p class="bio">x</p>', "profile"),
    ('<div class="thread">1</div><div class="thread">2</div>', "forum_thread"),
    ("<h1>a</h1><h2>b</h2><h3>c</h3>" + "<pre><code>x</code></pre>" * 3, "documentation"),
    ("<p>nothing</p>", "unknown"),
]


@query("SELECT CAST(page_id AS BIGINT) AS page_id, page_type FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(_KINDS)) + ") t(page_id, page_type)")
def q_page_type_rules(spark, sf_dir):
    return structured.page_types(_inline(spark, *(h for h, _ in _KINDS)))


_ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 2\n\nUser-agent: special\nDisallow: /\nSitemap: https://x.test/s.xml\n"


@query("SELECT * FROM (VALUES ('https://x.test/', true), ('https://x.test/private/a', false), ('https://x.test/private/open/b', true), ('https://x.test/a.pdf', false), ('https://x.test/a.pdf?x=1', true), ('https://other.test/private', true)) t(url, allowed)")
def q_robots(spark, sf_dir):
    rules = robots.rules_table(spark.createDataFrame([("x.test", _ROBOTS)], "host string, body string"))
    urls = ["https://x.test/", "https://x.test/private/a", "https://x.test/private/open/b", "https://x.test/a.pdf", "https://x.test/a.pdf?x=1", "https://other.test/private"]
    return robots.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules, "crawler/1.0").select("url", "allowed")


@query("SELECT * FROM (VALUES ('m', 'https://x.test/a', '2024-01-02', 'daily', '0.8'), ('m', 'https://x.test/b', NULL, NULL, NULL)) t(file, loc, lastmod, changefreq, priority)")
def q_sitemap(spark, sf_dir):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x.test/a </loc><lastmod>2024-01-02</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url><url><loc>https://x.test/b</loc></url><url><loc> </loc></url></urlset>'
    return crawl.sitemaps(spark.createDataFrame([("m", xml)], "file string, xml string"))


@query("SELECT CAST(0 AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS ord, 'https://x.test/find' AS action, 'get' AS method, 'a b' AS q, 'on' AS box, '2' AS pick, 'note' AS memo, CAST(4 AS INTEGER) AS n")
def q_forms(spark, sf_dir):
    page = '<form action="/find"><input name="q" value="a b"><input type=checkbox name=box checked><input type=radio name=r value=1><input type=submit name=go value=Go><select name=pick><option value=1>x<option value=2 selected>y</select><textarea name=memo>note</textarea></form>'
    f = crawl.forms(_inline(spark, page))
    return f.select("page_id", "ord", "action", "method", *[F.element_at("values", F.lit(k)).alias(k) for k in ("q", "box", "pick", "memo")], F.size("values").alias("n"))


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'https://x.test/list?page=2'), (1, 'https://x.test/p3'), (2, 'https://x.test/more'), (3, NULL)) t(page_id, next_url)")
def q_next_page(spark, sf_dir):
    p = _inline(spark, '<link rel="next" href="?page=2"><a rel="next" href="/no">', '<a rel="prev next" href="/p3">3</a>', '<div class="more"><a href="/more">more</a></div>', "<p>end</p>")
    return crawl.next_pages(p, selector=".more")


@query("SELECT * FROM (VALUES ('u1', CAST(0 AS INTEGER), 'u1'), ('u1', 1, 'u2'), ('u1', 2, 'u3')) t(start, step, url)")
def q_follow_pages(spark, sf_dir):
    links = spark.createDataFrame([("u1", "u2"), ("u2", "u3"), ("u3", "u1"), ("u9", None)], "url string, next_url string")
    return crawl.follow(links, ["u1"])


@query(f"SELECT host, page_id FROM (SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, page_id, row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#:]+)', 1)) ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def q_first_page_of_host(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", coerce.host_col(F.col("url")).alias("host"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("r = 1").select("host", "page_id")
