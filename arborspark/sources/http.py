"""HTTP as a source: request rows to response rows, grouped by host, with retries, throttling, a cache and decoding."""

from __future__ import annotations

import base64
import json
import os
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field, replace
from http.cookiejar import CookieJar
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import encoding
from ..functions.coerce import host_col
from ..functions.html import Dom

#: fixed values: answers worth asking again
RETRIED = frozenset((408, 425, 429, 500, 502, 503, 504))
RESPONSE = "status int, headers map<string,string>, body binary, final_url string, error string"


@dataclass(frozen=True)
class Options:
    """How to ask: headers, authentication, proxy, timeouts, redirects, retries and pauses."""

    headers: dict[str, str] = field(default_factory=lambda: {"User-Agent": "arborspark"})
    auth: tuple[str, str] | None = None
    bearer: str | None = None
    proxy: str | None = None
    timeout: float = 15.0
    max_redirects: int = 5
    retries: int = 2
    backoff: float = 0.5
    max_backoff: float = 30.0
    interval: float = 0.0
    transcode: bool = True
    verify: bool = True
    client_cert: tuple[str, str] | None = None
    max_bytes: int | None = None
    ca_file: str | None = None
    cookies: bool = True
    max_bytes_per_second: int | None = None

    def merged(self, **changes) -> Options:
        headers = {**self.headers, **changes.pop("headers", {})}
        return replace(self, headers=headers, **changes)


def features() -> dict[str, bool]:
    """What this build can decode."""
    try:
        import zstandard  # noqa: F401

        zstd = True
    except ImportError:
        zstd = False
    return {"gzip": True, "deflate": True, "zstd": zstd, "br": False, "http2": False}


def pause(attempt: int, options: Options, retry_after: str | None = None, rng: Callable[[], float] = random.random) -> float:
    """Seconds before attempt + 1: a numeric Retry-After, capped, else full jitter under an exponential bound."""
    if retry_after and retry_after.strip().isdigit():
        return min(float(retry_after), options.max_backoff)
    return rng() * min(options.max_backoff, options.backoff * 2**attempt)


def slots(times: list[float], interval: float) -> list[float]:
    """When requests that arrive at times may start, at least interval apart."""
    out, free = [], float("-inf")
    for t in times:
        start = max(t, free)
        out.append(start)
        free = start + interval
    return out


def decoded(body: bytes, coding: str) -> bytes:
    """The body without its content codings; what cannot be decoded stays."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = zlib.decompress(body, 31)
            elif name == "deflate":
                try:
                    body = zlib.decompress(body, -15)
                except zlib.error:
                    body = zlib.decompress(body)
            elif name == "zstd" and features()["zstd"]:
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zlib.error:
            return body
    return body


def multipart(fields: dict[str, str], files: dict[str, tuple[str, bytes]]) -> tuple[str, bytes]:
    """Content type and body of an upload."""
    mark = uuid.uuid4().hex
    out = b""
    for k, v in fields.items():
        out += f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode()
    for k, (name, raw) in files.items():
        out += f'--{mark}\r\nContent-Disposition: form-data; name="{k}"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + raw + b"\r\n"
    return f"multipart/form-data; boundary={mark}", out + f"--{mark}--\r\n".encode()


class StatusError(OSError):
    """An answer that says no; response holds it."""

    def __init__(self, response: dict):
        super().__init__(f"status {response['status']} for {response['final_url']}" if response["error"] is None else response["error"])
        self.response = response


def raise_for_status(response: dict) -> dict:
    """The response, unless it failed or has a status of 400 or more."""
    if response["error"] is not None or response["status"] is None or response["status"] >= 400:
        raise StatusError(response)
    return response


def document(response: dict) -> Dom:
    """The parsed body of a response."""
    return Dom((response["body"] or b"").decode("utf-8", "replace"))


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, limit: int):
        self.max_redirections = self.max_repeats = limit


class Session:
    """Requests that share cookies and defaults; one for each partition."""

    def __init__(self, options: Options | None = None, sleep: Callable[[float], None] = time.sleep):
        self.options, self.sleep = options or Options(), sleep
        self.cookies = CookieJar()
        self.last: dict[str, float] = {}

    def _opener(self, o: Options) -> urllib.request.OpenerDirector:
        import ssl

        context = ssl.create_default_context(cafile=o.ca_file) if o.verify else ssl._create_unverified_context()
        if o.client_cert:
            context.load_cert_chain(*o.client_cert)
        handlers = [_Redirects(o.max_redirects), urllib.request.HTTPSHandler(context=context)]
        if o.cookies:
            handlers.append(urllib.request.HTTPCookieProcessor(self.cookies))
        handlers.append(urllib.request.ProxyHandler({"http": o.proxy, "https": o.proxy} if o.proxy else {}))
        return urllib.request.build_opener(*handlers)

    def request(self, method: str, url: str, body: bytes | None = None, json_body=None, form: dict[str, str] | None = None, files: dict | None = None, multipart_form: bool = False, to: IO[bytes] | None = None, **changes) -> dict:
        """status, headers, body, final_url, error of one request, after retries. With to, a successful body goes there as it comes."""
        o = self.options.merged(**changes) if changes else self.options
        headers = {"Accept-Encoding": ", ".join(k for k in ("gzip", "deflate", "zstd") if features()[k]), **o.headers}
        if json_body is not None:
            body, headers["Content-Type"] = json.dumps(json_body).encode(), "application/json"
        elif files or multipart_form:
            headers["Content-Type"], body = multipart(form or {}, files or {})
        elif form is not None:
            body, headers["Content-Type"] = urllib.parse.urlencode(form).encode(), "application/x-www-form-urlencoded"
        if o.auth:
            headers["Authorization"] = "Basic " + base64.b64encode(":".join(o.auth).encode()).decode()
        if o.bearer:
            headers["Authorization"] = f"Bearer {o.bearer}"
        got: dict = {}
        for attempt in range(o.retries + 1):
            self._wait(url, o.interval)
            got = self._once(method, url, body, headers, o, to)
            if got["status"] not in RETRIED and got["error"] is None or attempt == o.retries:
                break
            self.sleep(pause(attempt, o, (got["headers"] or {}).get("retry-after")))
        return got

    def _wait(self, url: str, interval: float) -> None:
        if interval > 0:
            host = urllib.parse.urlsplit(url).hostname or ""
            now = time.monotonic()
            start = max(now, self.last.get(host, -1e9))
            self.last[host] = start + interval
            if start > now:
                self.sleep(start - now)

    def _once(self, method: str, url: str, body: bytes | None, headers: dict, o: Options, to: IO[bytes] | None = None) -> dict:
        req = urllib.request.Request(url, data=body, headers=headers, method=method)
        try:
            with self._opener(o).open(req, timeout=o.timeout) as r:
                return _response(r, o) if to is None else self._copy(r, o, to)
        except urllib.error.HTTPError as e:
            return _response(e, o)
        except (OSError, ValueError) as e:
            return {"status": None, "headers": {}, "body": None, "final_url": url, "error": str(e)}

    def _copy(self, r, o: Options, to: IO[bytes]) -> dict:
        """The body in pieces, no faster than the options allow; stored as it is sent."""
        sent, start = 0, time.monotonic()
        while piece := r.read(1 << 16):
            sent += len(piece)
            if o.max_bytes and sent > o.max_bytes:
                to.write(piece[: o.max_bytes - sent])
                break
            to.write(piece)
            if o.max_bytes_per_second:
                ahead = sent / o.max_bytes_per_second - (time.monotonic() - start)
                if ahead > 0:
                    self.sleep(ahead)
        return {"status": r.status, "headers": {k.lower(): v for k, v in r.headers.items()}, "body": None, "final_url": r.geturl(), "error": None}

    def download_to(self, url: str, path: str, **k) -> dict:
        """The answer, whose body is in the file if it says yes; what is there is only replaced by a whole body."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                got = self.request("GET", url, to=f, headers={**k.pop("headers", {}), "Accept-Encoding": "identity"}, **k)
            if got["error"] is None and got["status"] < 300:
                os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
        return got

    def get(self, url: str, **k) -> dict:
        return self.request("GET", url, **k)

    def post(self, url: str, **k) -> dict:
        return self.request("POST", url, **k)

    def put(self, url: str, **k) -> dict:
        return self.request("PUT", url, **k)

    def patch(self, url: str, **k) -> dict:
        return self.request("PATCH", url, **k)

    def delete(self, url: str, **k) -> dict:
        return self.request("DELETE", url, **k)

    def head(self, url: str, **k) -> dict:
        return self.request("HEAD", url, **k)

    def parallel(self, urls: list[str], threads: int = 8) -> list[dict]:
        """Answers in the order of the addresses."""
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(self.get, urls))

    def completed(self, urls: list[str], threads: int = 8) -> Iterator[tuple[int, dict]]:
        """(place, answer) of each address, as they come in."""
        with ThreadPoolExecutor(threads) as pool:
            asked = {pool.submit(self.get, u): i for i, u in enumerate(urls)}
            for done in as_completed(asked):
                yield asked[done], done.result()


def _response(r, o: Options) -> dict:
    headers = {k.lower(): v for k, v in r.headers.items()}
    raw = r.read(o.max_bytes) if o.max_bytes else r.read()
    raw = decoded(raw, headers.get("content-encoding", ""))
    kind = headers.get("content-type", "")
    if o.transcode and re.match(r"text/|application/(xhtml|xml)", kind):
        m = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", kind, re.I)
        raw = encoding.to_text(raw, m[1] if m else None).encode()
    return {"status": r.status if hasattr(r, "status") else r.code, "headers": headers, "body": raw, "final_url": r.geturl(), "error": None}


def fetch(requests: DataFrame, options: Options | None = None, url_col: str = "url", method_col: str | None = None, body_col: str | None = None, headers_col: str | None = None, json_col: str | None = None, form_col: str | None = None, bearer_col: str | None = None, threads: int = 4, in_order: bool = True) -> DataFrame:
    """requests with the response columns.

    Each row may bring its own method, body, headers (a map), JSON text, form (a map) and bearer token. Columns etag and
    last_modified, as conditional() gives them, are sent as validators, so that an unchanged page is answered by 304. With a
    pause between requests rows are dealt by host, so that a host's pauses are kept in one place; without one they stay where
    they are, so that a host of many rows is no single task. Answers come in the order of the rows, or as they arrive.
    """
    o = options or Options()
    names = requests.columns
    arrow = to_arrow_schema(StructType([*requests.schema.fields, *_parse_datatype_string(RESPONSE).fields]))

    def run(batches):
        session = Session(o)

        def one(r):
            headers = dict(r[headers_col] or {}) if headers_col else {}
            if r.get("etag"):
                headers["If-None-Match"] = r["etag"]
            if r.get("last_modified"):
                headers["If-Modified-Since"] = r["last_modified"]
            body, given = r[body_col] if body_col else None, {"headers": headers} if headers else {}
            if json_col and r[json_col] is not None:
                given["json_body"] = json.loads(r[json_col])
            if form_col and r[form_col] is not None:
                given["form"] = dict(r[form_col])
            if bearer_col and r[bearer_col] is not None:
                given["bearer"] = r[bearer_col]
            method = (r[method_col] if method_col else None) or ("POST" if "json_body" in given or "form" in given or body is not None else "GET")
            return session.request(method, r[url_col], body.encode() if isinstance(body, str) else body, **given)

        def batch(b, places, got):
            found = [pa.array([list(g[n].items()) if n == "headers" else g[n] for g in got], arrow.field(n).type) for n in ("status", "headers", "body", "final_url", "error")]
            return pa.RecordBatch.from_arrays([*(c.take(pa.array(places, pa.int64())) for c in b.columns), *found], schema=arrow)

        for b in batches:
            rows = [{k: dict(v) if isinstance(v, list) and k in (headers_col, form_col) else v for k, v in r.items()} for r in b.to_pylist()]
            if o.interval > 0:
                yield batch(b, range(len(rows)), [one(r) for r in rows])
                continue
            with ThreadPoolExecutor(threads) as pool:
                if in_order:
                    yield batch(b, range(len(rows)), list(pool.map(one, rows)))
                else:
                    asked = {pool.submit(one, r): i for i, r in enumerate(rows)}
                    for done in as_completed(asked):
                        yield batch(b, [asked[done]], [done.result()])

    dealt = requests.repartition(host_col(F.col(url_col))) if o.interval > 0 else requests
    return dealt.mapInArrow(run, StructType([*requests.schema.fields, *_parse_datatype_string(RESPONSE).fields])).select(*names, "status", "headers", "body", "final_url", "error")


def fetch_stream(requests: DataFrame, options: Options | None = None, **columns) -> DataFrame:
    """fetch() of a streaming table of requests: each micro-batch gives its answers as they arrive."""
    return fetch(requests, options, in_order=False, **columns)


def conditional(requests: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """requests with the validators (etag, last_modified) of what the cache holds."""
    known = cache.select(F.col("url").alias(url_col), F.element_at("headers", F.lit("etag")).alias("etag"), F.element_at("headers", F.lit("last-modified")).alias("last_modified"))
    return requests.join(known, url_col, "left")


def revalidated(responses: DataFrame) -> DataFrame:
    """responses with state: fresh (304), changed (2xx), missing (404 or 410), error."""
    s = F.col("status")
    return responses.withColumn("state", F.when(s == 304, "fresh").when(s.between(200, 299), "changed").when(s.isin(404, 410), "missing").otherwise("error"))


def from_cache(responses: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """Answers that say not modified take their body from the cache, and hit says so."""
    held = cache.select(F.col("url").alias("_url"), F.col("body").alias("_body"))
    out = responses.join(held, responses[url_col] == F.col("_url"), "left")
    hit = (F.col("status") == 304) & F.col("_body").isNotNull()
    return out.withColumn("body", F.when(hit, F.col("_body")).otherwise(F.col("body"))).withColumn("hit", hit).withColumn("status", F.when(hit, 200).otherwise(F.col("status"))).drop("_url", "_body")


def cache_key(url: Column) -> Column:
    """An opaque key of 32 hexadecimal digits for an address."""
    return F.substring(F.sha2(url, 256), 1, 32)
