import gzip
import json
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborspark import cli
from arborspark.functions.html import Dom
from arborspark.sources import cache, crawl, files, http, robots
from arborspark.streaming import rows

PAGE = '<ul><li class="r">1<ul><li>in</li></ul></li><!-- <li class="r">no</li> --><script>"<li class=r>"</script><li class="R" id=k>é 2</li><li class="r"/><li class="r">cut'


@pytest.mark.parametrize("size", [1, 3, 47, 1 << 16])
def test_rows_do_not_depend_on_chunks(size):
    raw = PAGE.encode()
    got = list(rows.split_rows((raw[i : i + size] for i in range(0, len(raw), size)), "li.r"))
    assert got == ['<li class="r">1<ul><li>in</li></ul></li>', '<li class="R" id=k>é 2</li>', '<li class="r"/>']
    assert list(rows.split_rows([raw], "li#k.r")) == ['<li class="R" id=k>é 2</li>']
    with pytest.raises(ValueError):
        list(rows.split_rows([raw], ".r"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<li>", "</li>", "<b>", "x", "<!--", "-->", "<script>", "</script>", "<li a='>'>", "<li/>", "é"]), max_size=20).map("".join), st.integers(1, 9))
def test_chunk_invariance(html, size):
    raw = html.encode()
    assert list(rows.split_rows((raw[i : i + size] for i in range(0, len(raw), size)), "li")) == list(rows.split_rows([raw], "li"))


def test_streaming_state(spark, tmp_path):
    raw = PAGE.encode()
    chunks = [(d, i, bytearray(raw[i * 11 : i * 11 + 11])) for d in (1, 2) for i in range(len(raw) // 11 + 1)]
    for k in range(3):
        part = [c for c in chunks if c[1] * 3 // (len(raw) // 11 + 1) == k]
        spark.createDataFrame(part, "doc_id long, seq int, chunk binary").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("doc_id long, seq int, chunk binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = rows.stream_rows(stream, "li.r").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("found").toPandas().sort_values(["doc_id", "ord"])
    assert got["row"].tolist() == list(rows.split_rows([raw], "li.r")) * 2


def test_robots():
    body = "User-agent: a\nUser-agent: b\nDisallow: /x\n# note\nUser-agent: *\nDisallow: /p\nAllow: /p/q\nDisallow: /*.gif$\nCrawl-delay: 1.5\nSitemap: https://x.test/m.xml"
    r = robots.parse(body)
    assert r.allowed("https://h/x", "A/1") and not r.allowed("https://h/x", "Bot") and robots.parse(body, rfc9309=True).agent("a") == "a"
    assert not robots.parse(body, rfc9309=True).allowed("https://h/x", "a")
    assert (r.allowed("https://h/p/q"), r.allowed("https://h/p/z"), r.allowed("https://h/i.gif"), r.allowed("https://h/i.gif?1")) == (True, False, False, True)
    assert r.crawl_delay("zzz") == 1.5 and r.sitemaps == ["https://x.test/m.xml"] and robots.parse("").allowed("https://h/x")


def test_sitemap_recursion_is_bounded():
    book = {"i": "<sitemapindex><sitemap><loc>i</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>", "a": "<urlset><url><loc> u </loc></url><url/></urlset>"}
    assert [e["loc"] for e in crawl.sitemap_urls("i", book.get)] == ["u"]
    assert crawl.sitemap_entries("<broken") == ([], [])


def test_forms_and_next_pages():
    d = Dom('<form action=/s method=POST><input name=a value=1><input type=hidden name=b value="x y"><input type=checkbox name=c value=z><select name=d><option>one</option><option value=2>two</option></select></form>')
    f = crawl.Form(d, 1, "https://x.test/p")
    assert f.values == {"a": "1", "b": "x y", "d": "one"}
    assert f.request({"a": "9"}) == {"method": "POST", "url": "https://x.test/s", "body": "a=9&b=x+y&d=one"}
    assert crawl.next_url(Dom('<a rel=next href="/p">'), "https://x.test/p") is None


class Handler(BaseHTTPRequestHandler):
    seen: dict = {}

    def log_message(self, *args):
        pass

    def answer(self, status=200, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        n = Handler.seen[self.path] = Handler.seen.get(self.path, 0) + 1
        if self.path == "/flaky" and n < 3:
            return self.answer(503, Retry_After="0")
        if self.path == "/gzip":
            return self.answer(body=gzip.compress("häuser".encode("latin-1")), Content_Encoding="gzip", Content_Type="text/html; charset=latin1")
        if self.path == "/deflate":
            return self.answer(body=zlib.compress(b"raw"), Content_Encoding="deflate")
        if self.path == "/go":
            return self.answer(302, Location="/done")
        if self.path == "/etag":
            return self.answer(304) if self.headers.get("If-None-Match") == "v1" else self.answer(body=b"one", ETag="v1")
        if self.path == "/missing":
            return self.answer(404)
        if self.path == "/cookie":
            return self.answer(body=(self.headers.get("Cookie") or "none").encode(), Set_Cookie="k=1")
        self.answer(body=json.dumps({"path": self.path, "auth": self.headers.get("Authorization")}).encode())

    def do_POST(self):
        self.answer(body=self.rfile.read(int(self.headers["Content-Length"])))

    do_PUT = do_PATCH = do_DELETE = do_POST


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_requests(server):
    s = http.Session(http.Options(backoff=0.01, retries=3), sleep=lambda t: None)
    assert s.get(server + "/flaky")["status"] == 200 and Handler.seen["/flaky"] == 3
    assert s.get(server + "/gzip")["body"].decode() == "häuser" and s.get(server + "/deflate")["body"] == b"raw"
    assert s.get(server + "/go")["final_url"].endswith("/done")
    assert s.get(server + "/cookie")["body"] == b"none" and s.get(server + "/cookie")["body"] == b"k=1"
    assert s.post(server + "/p", json_body={"a": 1})["body"] == b'{"a": 1}' and s.put(server + "/p", form={"a": "b c"})["body"] == b"a=b+c"
    assert b'filename="f.txt"' in s.post(server + "/p", form={"k": "v"}, files={"f": ("f.txt", b"data")})["body"]
    assert json.loads(s.get(server + "/x", auth=("u", "p"))["body"])["auth"].startswith("Basic ")
    assert [r["status"] for r in s.parallel([server + "/a", server + "/missing", "http://127.0.0.1:1/"])] == [200, 404, None]


def test_fetch_table_and_revalidation(spark, server):
    urls = spark.createDataFrame([(1, server + "/a"), (2, server + "/missing")], "k long, url string")
    got = http.revalidated(http.fetch(urls)).orderBy("k").collect()
    assert [(r["status"], r["state"]) for r in got] == [(200, "changed"), (404, "missing")]
    held = spark.createDataFrame([("u", {"etag": "v1"}, bytearray(b"one"))], "url string, headers map<string,string>, body binary")
    answers = spark.createDataFrame([("u", 304, None)], "url string, status int, body binary")
    r = http.from_cache(answers, held).first()
    assert (r["status"], bytes(r["body"]), r["hit"]) == (200, b"one", True)
    assert http.conditional(answers.select("url"), held).first()["etag"] == "v1"


class Pages(BaseHTTPRequestHandler):
    """Answers that depend on validators, headers, bodies and time."""

    def _send(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if self.path == "/page":
            same = self.headers.get("If-None-Match") == "v1" and self.headers.get("If-Modified-Since") == "Mon"
            self._send(304 if same else 200, b"" if same else b"<h1>hi</h1>", ETag="v1", Last_Modified="Mon")
        elif self.path == "/slow":
            time.sleep(0.6)
            self._send(200, b"slow")
        elif self.path == "/big":
            self._send(200, b"x" * 300_000)
        else:
            self._send(404)

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        shown = {"method": self.command, "body": body.decode(), "kind": self.headers.get("Content-Type"), "x": self.headers.get("X-One"), "auth": self.headers.get("Authorization")}
        self._send(200, json.dumps(shown).encode(), Content_Type="application/json")

    do_PUT = do_DELETE = do_PATCH = do_POST

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def pages_server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_validators_are_sent(spark, pages_server):
    """A second fetch with what the first answered brings 304, and the body from the cache."""
    asked = spark.createDataFrame([(pages_server + "/page",)], "url string")
    held = spark.createDataFrame(http.fetch(asked).collect(), "url string, status int, headers map<string,string>, body binary, final_url string, error string")
    again = http.fetch(http.conditional(asked, held))
    assert [r["state"] for r in http.revalidated(again).collect()] == ["fresh"]
    r = http.from_cache(again, held).first()
    assert (r["hit"], r["status"], bytes(r["body"])) == (True, 200, b"<h1>hi</h1>")


def test_rows_bring_their_own_requests(spark, pages_server):
    rows = [(1, None, {"X-One": "a"}, '{"k": 1}', None, "tok"), (2, "PUT", None, None, {"a": "b c"}, None), (3, "DELETE", None, None, None, None)]
    df = spark.createDataFrame([(pages_server + "/p", *r) for r in rows], "url string, k int, method string, headers_in map<string,string>, json string, form map<string,string>, token string")
    got = http.fetch(df, method_col="method", headers_col="headers_in", json_col="json", form_col="form", bearer_col="token")
    seen = {r["k"]: json.loads(bytes(r["body"])) for r in got.collect()}
    assert seen[1] == {"method": "POST", "body": '{"k": 1}', "kind": "application/json", "x": "a", "auth": "Bearer tok"}
    assert (seen[2]["method"], seen[2]["body"], seen[3]["method"]) == ("PUT", "a=b+c", "DELETE")
    assert got.columns[: len(df.columns)] == df.columns


def test_answers_as_they_arrive(spark, pages_server):
    urls = [pages_server + "/slow", pages_server + "/page"]
    assert [i for i, _ in http.Session().completed(urls)] == [1, 0]
    df = spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1)
    assert [r["url"] for r in http.fetch(df, in_order=False).collect()] == urls[::-1]
    assert [r["url"] for r in http.fetch(df).collect()] == urls


def test_streams_of_requests(spark, pages_server, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"url": pages_server + "/page"}) + "\n" + json.dumps({"url": pages_server + "/none"}))
    q = http.fetch_stream(spark.readStream.schema("url string").json(str(tmp_path / "in"))).writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["status"] for r in spark.table("answers").collect()) == [200, 404]


def test_downloads_and_refusals(pages_server, tmp_path):
    waits, path = [], tmp_path / "big"
    s = http.Session(http.Options(max_bytes_per_second=100_000, cookies=False), sleep=waits.append)
    assert s.download_to(pages_server + "/big", str(path))["status"] == 200 and path.read_bytes() == b"x" * 300_000 and max(waits) > 1
    assert s.download_to(pages_server + "/none", str(path))["status"] == 404 and path.stat().st_size == 300_000
    assert [p.name for p in tmp_path.iterdir()] == ["big"]
    assert http.document(http.raise_for_status(s.get(pages_server + "/page"))).text(1) == "hi"
    with pytest.raises(http.StatusError) as e:
        http.raise_for_status(s.get(pages_server + "/none"))
    assert e.value.response["status"] == 404


def test_forms_are_submitted(pages_server):
    s = http.Session()
    f = crawl.Form(Dom('<form action="/p" method="post"><input name=a value=1><input name=b value=2></form>'), 1, pages_server + "/x")
    f["c"] = "3"
    seen = json.loads(f.delete("b").submit(s, {"a": "9"})["body"])
    assert (seen["method"], seen["body"], seen["kind"]) == ("POST", "a=9&c=3", "application/x-www-form-urlencoded")
    f = crawl.Form(Dom('<form action="/p" method="put" enctype="multipart/form-data"><input name=a value=1></form>'), 1, pages_server + "/x")
    seen = json.loads(f.submit(s)["body"])
    assert seen["method"] == "PUT" and seen["kind"].startswith("multipart/form-data") and 'name="a"' in seen["body"]
    f = crawl.Form(Dom('<form action="/page"><input name=a value=1></form>'), 1, pages_server + "/x")
    assert f.submit(s)["status"] == 404 and f["a"] == "1"


def test_pauses():
    o = http.Options(backoff=1, max_backoff=5)
    assert http.pause(1, o, "3") == 3 and http.pause(1, o, "99") == 5 and http.pause(2, o, None, lambda: 1.0) == 4 and http.pause(9, o, "soon", lambda: 0.5) == 2.5
    assert http.slots([0, 0.1, 5], 1) == [0, 1, 5]


def test_parse_cache(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>a</p>"), (3, "<p>b</p>")], "page_id long, html string")
    c = cache.ParseCache(spark, str(tmp_path / "cache"))
    assert c.missing(pages).count() == 2
    c.store(pages)
    assert c.missing(pages).count() == 0 and c.load(pages).count() == 3 and c.disk_usage() > 0
    c.store(pages)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    c.clear()
    assert c.missing(pages).count() == 2 and cache.parse_distinct(pages).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes('<meta charset="latin1"><p>é'.encode("latin-1"))
    assert files.read_bytes(spark, str(tmp_path)).first()["html"].endswith("é")
    (tmp_path / "a.html").write_text("<p>x")
    assert files.read_text(spark, str(tmp_path)).first()["html"] == "<p>x"


def test_command_line(tmp_path, capsys):
    page = tmp_path / "p.html"
    page.write_text('<title>T</title><a href="/x">go</a><script type="application/ld+json">{"@type":"Article"}</script>')
    for command, extra in [("info", []), ("page-type", []), ("encoding", []), ("jsonld", []), ("opengraph", []), ("schema-org", ["--type", "Article"]), ("microdata", []), ("rdfa", []), ("sax", []), ("css", ["--select", "a::attr(href)"]), ("xpath", ["--select", "//a/@href"])]:
        assert cli.main([command, str(page), "--compact", *extra]) == 0
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[1]) == "article" and json.loads(out[-1]) == json.loads(out[-2]) == ["/x"]
    assert cli.main(["version"]) == 0 and isinstance(pd.DataFrame(), pd.DataFrame)


def test_robots_of_origins(spark, server):
    got = robots.fetch(spark.createDataFrame([(server + "/",)], "origin string")).first()
    assert got["host"] == "127.0.0.1" and "path" in got["body"]


def test_one_page_at_hand(spark, tmp_path):
    from arborspark import api
    from arborspark.plans.schema import Schema

    (tmp_path / "p.html").write_bytes("<h1>é</h1>".encode())
    schema = Schema().field("h", "h1")
    assert api.extract_file(str(tmp_path / "p.html"), schema) == api.extract("<h1>é</h1>".encode(), schema) == {"h": "é"}
    with open(tmp_path / "p.html", "rb") as f:
        assert len(api.parse_io(f)) == len(api.HTML("<h1>é</h1>")) == 3
    got = api.parallel_parse(spark, ["<p>", "", "<b>x"], 2).orderBy("page_id").collect()
    assert [len(r["dom"]) for r in got] == [2, 1, 3]
