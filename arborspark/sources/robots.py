"""robots.txt rules as Python objects and as tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Robots:
    """Rules by user agent (lower case), delays and sitemaps."""

    rules: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    delays: dict[str, float] = field(default_factory=dict)
    sitemaps: list[str] = field(default_factory=list)

    def agent(self, user_agent: str) -> str | None:
        """The group whose name is the longest prefix of the agent's, else the one for all."""
        low = user_agent.lower()
        named = [a for a in self.rules if a != "*" and low.startswith(a)]
        return max(named, key=len) if named else "*" if "*" in self.rules else None

    def allowed(self, url: str, user_agent: str = "*") -> bool:
        """The longest matching pattern decides, the first of equals; nothing matching allows."""
        parts = urlsplit(url)
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        best, verdict = -1, True
        for kind, pattern in self.rules.get(self.agent(user_agent) or "", []):
            if len(pattern) > best and pattern_regex(pattern).match(path):
                best, verdict = len(pattern), kind == "allow"
        return verdict

    def crawl_delay(self, user_agent: str = "*") -> float | None:
        return self.delays.get(self.agent(user_agent) or "")


@lru_cache(maxsize=4096)
def pattern_regex(pattern: str) -> re.Pattern:
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*"))
    return re.compile(body + (r"\Z" if end else ""), re.S)


def parse(body: str, rfc9309: bool = False) -> Robots:
    """Rules of a file. Of user-agent lines in a row only the last gets the rules, unless rfc9309 shares them."""
    out, current, open_group = Robots(), [], False
    for line in body.splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            current = [*current, value.lower()] if rfc9309 and open_group else [value.lower()]
            out.rules.setdefault(value.lower(), [])
            open_group = True
            continue
        open_group = False if key in ("allow", "disallow", "crawl-delay") else open_group
        if key == "sitemap" and value:
            out.sitemaps.append(value)
        for agent in current:
            if key in ("allow", "disallow") and value:
                out.rules[agent].append((key, value))
            elif key == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                out.delays[agent] = float(value)
    return out


def rules_table(files: DataFrame, body_col: str = "body", keep: tuple[str, ...] = ("host",)) -> DataFrame:
    """keep, agent, ord, kind, pattern, regex: a row for each rule of each robots.txt."""

    def rows(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for agent, rules in parse(getattr(r, body_col) or "").rules.items():
                    out += [(*(getattr(r, k) for k in keep), agent, n, kind, p, pattern_regex(p).pattern) for n, (kind, p) in enumerate(rules)]
            import pandas as pd

            yield pd.DataFrame(out, columns=[*keep, "agent", "ord", "kind", "pattern", "regex"])

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keep)
    return files.select(*keep, body_col).mapInPandas(rows, f"{kinds}, agent string, ord int, kind string, pattern string, regex string")


def judge(urls: DataFrame, rules: DataFrame, user_agent: str, url_col: str = "url") -> DataFrame:
    """urls with allowed, by a join on host with the rules of the agent's group (longest prefix, else *).

    The rules are aggregated to one array for each host before the join, so a host with many pages meets one row.
    """
    agent = F.lit(user_agent.lower())
    fit = rules.where((F.col("agent") == "*") | F.startswith(agent, F.col("agent")))
    order = F.when(F.col("agent") == "*", -1).otherwise(F.length("agent"))
    groups = fit.groupBy("host", "agent").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), (-F.col("ord")).alias("o"), "kind", "regex")).alias("rules"))
    best = groups.groupBy("host").agg(F.max_by("rules", order).alias("rules"))
    host = F.lower(F.regexp_extract(url_col, r"://([^/?#:]+)", 1))
    path = F.regexp_extract(url_col, r"://[^/?#]+([^#]*)", 1)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    hits = F.filter("rules", lambda r: F.regexp_like(path, F.concat(F.lit("(?s)^(?:"), r["regex"], F.lit(")"))))
    verdict = F.array_max(hits)["kind"]
    out = urls.withColumn("_host", host).join(best.withColumnRenamed("host", "_host"), "_host", "left")
    return out.withColumn("allowed", F.coalesce(verdict == "allow", F.lit(True))).drop("_host", "rules")


def fetch(origins: DataFrame, origin_col: str = "origin", options=None) -> DataFrame:
    """host and body of each origin's robots.txt; an answer other than 200 gives an empty file, which allows everything."""
    from .http import fetch as ask

    asked = origins.select(F.concat(F.rtrim(F.col(origin_col), F.lit("/")), F.lit("/robots.txt")).alias("url")).distinct()
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]+)", 1))
    return ask(asked, options).select(host.alias("host"), F.when(F.col("status") == 200, F.decode("body", "UTF-8")).otherwise("").alias("body"))
