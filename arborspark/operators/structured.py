"""Structured data that pages carry: JSON-LD, OpenGraph, Twitter cards, microdata, RDFa, and the kind of page they make."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions.html import Dom, clean
from ..plans import css
from .nodes import map_rows


def _dump(v) -> str:
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def json_ld_items(dom: Dom) -> list:
    """Items of all JSON-LD scripts that can be read: those of an array, those of an object's @graph, else the value itself."""
    out = []
    for i in css.select(dom, 'script[type="application/ld+json"]'):
        raw = dom.text(i)
        if not raw.strip():
            continue
        try:
            v = json.loads(raw)
        except ValueError:
            continue
        out += v if isinstance(v, list) else v["@graph"] if isinstance(v, dict) and isinstance(v.get("@graph"), list) else [v]
    return out


def meta(dom: Dom, prefix: str) -> dict[str, str]:
    """Content of meta tags whose property (else name) begins with the prefix; the first wins."""
    out: dict[str, str] = {}
    for i in dom.index[0].get("meta", ()):
        key = dom.attr(i, "property") or dom.attr(i, "name") or ""
        content = dom.attr(i, "content")
        if key.startswith(prefix) and content is not None:
            out.setdefault(key[len(prefix) :], content)
    return out


def types_of(item) -> list[str]:
    t = item.get("@type") if isinstance(item, dict) else None
    return [str(x) for x in (t if isinstance(t, list) else [t]) if x is not None]


# fixed values: where microdata reads its values
_SOURCES = {
    "meta": "content", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src",
    "a": "href", "area": "href", "link": "href", "object": "data", "data": "value", "meter": "value", "time": "datetime",
}


def _value(dom: Dom, i: int) -> str:
    name = _SOURCES.get(dom.tag[i])
    v = dom.attr(i, name) if name else None
    return v if v is not None else clean(dom.text(i))


def _item(dom: Dom, i: int) -> dict:
    props: dict = {}

    def walk(n: int) -> None:
        for k in dom.children[n]:
            names = (dom.attr(k, "itemprop") or "").split()
            nested = dom.attr(k, "itemscope") is not None
            if names:
                v = _item(dom, k) if nested else _value(dom, k)
                for name in names:
                    if name not in props:
                        props[name] = v
                    elif isinstance(props[name], list):
                        props[name].append(v)
                    else:
                        props[name] = [props[name], v]
            if not nested:
                walk(k)

    walk(i)
    out = {"type": dom.attr(i, "itemtype"), "properties": props}
    return {**out, "id": dom.attr(i, "itemid")} if dom.attr(i, "itemid") else out


def microdata_items(dom: Dom) -> list[dict]:
    """Items that no other item holds."""
    scopes = [i for i in dom.elements if dom.attr(i, "itemscope") is not None]
    return [_item(dom, i) for i in scopes if dom.attr(i, "itemprop") is None]


def rdfa_items(dom: Dom) -> list[dict]:
    """Typed nodes with the properties below them: the content attribute, else the text; a property may have several names."""
    out = []
    for i in dom.elements:
        if dom.attr(i, "typeof") is None:
            continue
        props: dict[str, list[str]] = {}
        for k in range(i + 1, dom.out[i] + 1):
            if names := (dom.attr(k, "property") or "").split():
                given = dom.attr(k, "content")
                for name in names:
                    props.setdefault(name, []).append(given if given is not None else dom.text(k).strip())
        flat = {k: v[0] if len(v) == 1 else v for k, v in props.items()}
        out.append({"type": dom.attr(i, "typeof"), "about": dom.attr(i, "about") or dom.attr(i, "resource"), "properties": flat})
    return out


# fixed values: the signals of each kind of page, in the order in which they are asked
_LD_KINDS = [
    ("product_page", {"Product"}), ("article", {"NewsArticle", "Article", "BlogPosting"}), ("search_results", {"SearchResultsPage"}),
    ("profile", {"Person", "ProfilePage"}), ("forum_thread", {"DiscussionForumPosting"}), ("documentation", {"TechArticle"}),
]
_OG_KINDS = [("product_page", ("product", "og:product", "product.item")), ("article", ("article", "news.article")), ("profile", ("profile", "person", "og:profile"))]
_CARDS = '.product-card, .product-tile, .product-item, .listing-item, [class*="product-grid"], [class*="card"], [class*="tile"]'


def page_type(dom: Dom) -> str:
    """From JSON-LD types, else the OpenGraph type, else the structure."""
    types = {t for item in json_ld_items(dom) for t in types_of(item)}
    if "ItemList" in types and types & {"Product", "Offer"}:
        return "product_listing"
    for kind, names in _LD_KINDS:
        if types & names:
            return kind
    og = meta(dom, "og:").get("type", "").lower()
    for kind, names in _OG_KINDS:
        if any(n in og for n in names):
            return kind
    count = lambda s: len(css.select(dom, s))
    if count('input[type="search"], form[role="search"], [class*="search-result"]'):
        return "search_results"
    if count(_CARDS) >= 6:
        return "product_listing"
    if articles := css.select(dom, "article", limit=1):
        if len(dom.text(articles[0]).split()) >= 200 or count(".byline, .author, [rel='author'], [itemprop='author']"):
            return "article"
    if count('[class*="avatar"], [class*="profile-header"]') and count('[class*="bio"], [class*="about"]'):
        return "profile"
    if count('.thread, .topic, [class*="post-message"]') >= 2:
        return "forum_thread"
    if count("pre code") >= 3 and count("h1, h2, h3") >= 3:
        return "documentation"
    return "unknown"


def fingerprint(dom: Dom, levels: int = 4) -> int:
    """A 64-bit rolling hash of the tags of the top levels, in document order; the same for pages of one template."""
    h = 1469598103934665603
    for i in dom.elements:
        if dom.depth[i] <= levels:
            for b in f"{dom.depth[i]}:{dom.tag[i]};".encode():
                h = (h ^ b) * 1099511628211 % (1 << 64)
    return h - (1 << 64) if h >= 1 << 63 else h


# --- over tables --------------------------------------------------------------------------------------------------------


def json_ld(pages: DataFrame, **options) -> DataFrame:
    """page_id, ord, type (first @type), item (canonical JSON)."""
    compute = lambda dom, row: [(k, next(iter(types_of(x)), None), _dump(x)) for k, x in enumerate(json_ld_items(dom))]
    return _over(pages, compute, "ord int, type string, item string", **options)


def schema_org(pages: DataFrame, type: str, **options) -> DataFrame:
    """The JSON-LD items that have the type."""
    compute = lambda dom, row: [(k, _dump(x)) for k, x in enumerate(json_ld_items(dom)) if type in types_of(x)]
    return _over(pages, compute, "ord int, item string", **options)


def opengraph(pages: DataFrame, prefix: str = "og:", **options) -> DataFrame:
    return _over(pages, lambda dom, row: [(list(meta(dom, prefix).items()),)], "properties map<string,string>", **options)


def twitter_card(pages: DataFrame, **options) -> DataFrame:
    return opengraph(pages, "twitter:", **options)


def microdata(pages: DataFrame, **options) -> DataFrame:
    return _over(pages, lambda dom, row: [(k, x["type"], _dump(x)) for k, x in enumerate(microdata_items(dom))], "ord int, type string, item string", **options)


def rdfa(pages: DataFrame, **options) -> DataFrame:
    return _over(pages, lambda dom, row: [(k, x["type"], _dump(x)) for k, x in enumerate(rdfa_items(dom))], "ord int, type string, item string", **options)


def page_types(pages: DataFrame, **options) -> DataFrame:
    return _over(pages, lambda dom, row: [(page_type(dom),)], "page_type string", **options)


def fingerprints(pages: DataFrame, **options) -> DataFrame:
    return _over(pages, lambda dom, row: [(fingerprint(dom),)], "fingerprint long", **options)


def _over(pages: DataFrame, compute, schema: str, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return map_rows(pages, html_col, compute, schema, keep)
