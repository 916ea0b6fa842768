"""What a crawl reads from pages: the next page, forms, and sitemaps."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import absolute
from ..functions.html import Dom
from ..operators.nodes import map_rows
from ..plans import css


def next_url(dom: Dom, current: str | None = None, selector: str | None = None) -> str | None:
    """link[rel~=next], else a[rel~=next] that leads elsewhere, else the selector's node or its first link."""
    for i in css.select(dom, 'link[rel~="next"][href]', limit=1):
        return absolute(dom.attr(i, "href"), current)
    for i in css.select(dom, 'a[rel~="next"][href]'):
        url = absolute(dom.attr(i, "href"), current)
        if url != current:
            return url
    if selector:
        for i in css.select(dom, selector, limit=1):
            href = dom.attr(i, "href") or next((dom.attr(k, "href") for k in css.select(dom, "a[href]", i)), None)
            return absolute(href, current) if href else None
    return None


def next_pages(pages: DataFrame, url_col: str = "url", selector: str | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return map_rows(pages, html_col, lambda dom, row: [(next_url(dom, row[url_col], selector),)], "next_url string", keep, (url_col,))


def follow(links: DataFrame, start: list[str], max_pages: int = 50) -> DataFrame:
    """start, step, url of the pages reached from each start over a table (url, next_url), at most max_pages, each page once.

    One join a step; the lineage is cut, as the number of steps is bounded but not small.
    """
    spark = links.sparkSession
    reached = spark.createDataFrame([(s, 0, s, [s]) for s in start], "start string, step int, url string, seen array<string>")
    reached = reached.join(links.select("url").distinct(), "url", "left_semi")
    parts = [reached.select("start", "step", "url")]
    for step in range(1, max_pages):
        nxt = reached.join(links.select("url", "next_url"), "url").where("next_url is not null and not array_contains(seen, next_url)")
        nxt = nxt.select("start", F.lit(step).alias("step"), F.col("next_url").alias("url"), F.concat("seen", F.array("next_url")).alias("seen"))
        nxt = nxt.join(links.select("url").distinct(), "url", "left_semi").select("start", "step", "url", "seen")
        if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
            nxt = nxt.checkpoint()
        if nxt.isEmpty():
            break
        parts.append(nxt.select("start", "step", "url"))
        reached = nxt
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- forms --------------------------------------------------------------------------------------------------------------


#: fixed values: kinds of controls that send nothing unless used
_NOT_SENT = ("submit", "button", "image", "reset", "file")


class Form:
    """A form's address, method, encoding and values as a browser would send them untouched."""

    def __init__(self, dom: Dom, i: int, base: str | None = None):
        self.action = absolute(dom.attr(i, "action") or base, base)
        self.method = (dom.attr(i, "method") or "get").lower()
        self.enctype = (dom.attr(i, "enctype") or "application/x-www-form-urlencoded").lower()
        self.values: dict[str, str] = {}
        for k in css.select(dom, "input[name]", i):
            kind, name = (dom.attr(k, "type") or "text").lower(), dom.attr(k, "name")
            if kind in _NOT_SENT:
                continue
            if kind in ("checkbox", "radio"):
                if dom.attr(k, "checked") is not None:
                    self.values[name] = dom.attr(k, "value") if dom.attr(k, "value") is not None else "on"
            else:
                self.values[name] = dom.attr(k, "value") or ""
        for k in css.select(dom, "select[name]", i):
            options = css.select(dom, "option", k)
            chosen = next((o for o in options if dom.attr(o, "selected") is not None), options[0] if options else None)
            if chosen is not None:
                v = dom.attr(chosen, "value")
                self.values[dom.attr(k, "name")] = v if v is not None else dom.text(chosen).strip()
        for k in css.select(dom, "textarea[name]", i):
            self.values[dom.attr(k, "name")] = dom.text(k)

    def __getitem__(self, name: str) -> str | None:
        return self.values.get(name)

    def __setitem__(self, name: str, value: str) -> None:
        self.values[name] = value

    def delete(self, name: str) -> Form:
        """The form without a value."""
        self.values.pop(name, None)
        return self

    def request(self, overrides: dict[str, str] | None = None) -> dict[str, str | None]:
        """method, url and body of a submission, url-encoded."""
        body = urlencode({**self.values, **(overrides or {})})
        if self.method == "get":
            url = (self.action or "").split("#")[0]
            return {"method": "GET", "url": url + ("&" if "?" in url else "?") + body if body else url, "body": None}
        return {"method": self.method.upper(), "url": self.action, "body": body}

    def submit(self, session, overrides: dict[str, str] | None = None, files: dict[str, tuple[str, bytes]] | None = None) -> dict:
        """The answer to a submission: by the address for GET, as multipart where the form or files ask for it, else url-encoded."""
        r = self.request(overrides)
        if self.method == "get":
            return session.get(r["url"])
        values = {**self.values, **(overrides or {})}
        if files or self.enctype == "multipart/form-data":
            return session.request(r["method"], r["url"], form=values, files=files or {}, multipart_form=True)
        return session.request(r["method"], r["url"], form=values)


def forms(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """ord, action, method, enctype, values of every form."""

    def compute(dom: Dom, row: dict):
        for k, i in enumerate(css.select(dom, "form")):
            f = Form(dom, i, row[url_col])
            yield k, f.action, f.method, f.enctype, list(f.values.items())

    return map_rows(pages, html_col, compute, "ord int, action string, method string, enctype string, `values` map<string,string>", keep, (url_col,))


# --- sitemaps -------------------------------------------------------------------------------------------------------------


def sitemap_entries(xml: str) -> tuple[list[dict[str, str | None]], list[str]]:
    """Entries of a urlset and addresses of a sitemapindex; blank locations are skipped, unreadable XML gives nothing."""
    try:
        root = ET.fromstring(re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", xml.strip()))
    except ET.ParseError:
        return [], []
    text = lambda e, name: (e.findtext(name) or "").strip() or None
    entries = [{k: text(u, k) for k in ("loc", "lastmod", "changefreq", "priority")} for u in root.iter("url")]
    return [e for e in entries if e["loc"]], [x for s in root.iter("sitemap") if (x := text(s, "loc"))]


def sitemap_urls(source: str, fetch: Callable[[str], str | None], max_depth: int = 5) -> list[dict[str, str | None]]:
    """Entries of a sitemap and of those it lists, to the depth, each file once."""
    out, seen, level = [], set(), [source]
    for _ in range(max_depth + 1):
        below = []
        for url in level:
            if url in seen:
                continue
            seen.add(url)
            entries, more = sitemap_entries(fetch(url) or "")
            out += entries
            below += more
        level = below
    return out


def sitemaps(files: DataFrame, xml_col: str = "xml", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """keep, loc, lastmod, changefreq, priority: an entry a row."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            out = [(*(r[k] for k in keep), e["loc"], e["lastmod"], e["changefreq"], e["priority"]) for r in pdf.to_dict("records") for e in sitemap_entries(r[xml_col] or "")[0]]
            yield pd.DataFrame(out, columns=[*keep, "loc", "lastmod", "changefreq", "priority"])

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keep)
    return files.select(*keep, xml_col).mapInPandas(rows, f"{kinds}, loc string, lastmod string, changefreq string, priority string")
