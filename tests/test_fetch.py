import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestone.cli import main
from lodestone.sources.fetch import PageStore, http_pages
from lodestone.sources.tables import read_pages


class Web:
    """A server that counts what it is asked, and how many requests it has at once for each host's name."""

    def __init__(self):
        self.asked, self.now, self.most, self.version = Counter(), Counter(), Counter(), 1
        web = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def answer(self, status, body=b"", **headers):
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), v)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                host, path = self.headers["Host"], self.path
                web.asked[path] += 1
                web.now[host] += 1
                web.most[host] = max(web.most[host], web.now[host])
                time.sleep(0.02)
                try:
                    if path == "/moved":
                        self.answer(302, Location="/page")
                    elif path == "/flaky" and web.asked[path] < 3:
                        self.answer(503, Retry_After="0")
                    elif path == "/dead":
                        self.answer(500)
                    elif path == "/missing":
                        self.answer(404)
                    elif path == "/big":
                        self.answer(200, b"x" * 5000)
                    elif path == "/denied":
                        self.answer(200, b"<h1>Access Denied</h1>")
                    elif path == "/latin":
                        self.answer(200, "é ü".encode("latin-1"), Content_Type="text/html; charset=latin-1")
                    elif path == "/tagged":
                        tag = f'"v{web.version}"'
                        if self.headers["If-None-Match"] == tag:
                            self.answer(304)
                        else:
                            self.answer(200, f"version {web.version}".encode(), ETag=tag)
                    else:
                        self.answer(200, f"page {path} 規格 {self.headers['User-Agent'][:7]}".encode())
                finally:
                    web.now[host] -= 1

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.port = self.server.server_address[1]

    def url(self, path, host="127.0.0.1"):
        return f"http://{host}:{self.port}{path}"


@pytest.fixture
def web():
    w = Web()
    yield w
    w.server.shutdown()


def targets(spark, web, *paths):
    return spark.createDataFrame([(p.strip("/"), web.url(p)) for p in paths], "key string, url string")


def test_pages_and_errors(spark, web):
    asked = targets(spark, web, "/page", "/moved", "/flaky", "/dead", "/missing", "/big", "/denied", "/latin")
    asked = asked.unionByName(spark.createDataFrame([("nowhere", "http://127.0.0.1:1/x"), ("odd", "u")], "key string, url string"))
    got = {r.key: r for r in http_pages(asked, attempts=3, pause=0.01, max_bytes=1000, timeout=5).collect()}
    assert got["page"].html == "page /page 規格 Mozilla" and got["page"].bytes == len(got["page"].html.encode()) and got["page"].fetched_at
    assert got["moved"].html.startswith("page /page") and got["latin"].html == "é ü"
    assert got["flaky"].status == 200 and web.asked["/flaky"] == 3
    assert (got["dead"].error, web.asked["/dead"]) == ("status 500", 3) and (got["missing"].error, web.asked["/missing"]) == ("status 404", 1)
    assert "more than 1000 bytes" in got["big"].error and "refusal" in got["denied"].error
    assert got["nowhere"].status is None and got["nowhere"].error and "ValueError" in got["odd"].error
    assert all(r.html is None for r in got.values() if r.error)


def test_a_partition_for_each_host(spark, web):
    """Requests of one host come one after the other; hosts are separate partitions."""
    rows = [(f"{h}{i}", web.url(f"/{i}", h)) for i in range(8) for h in ("127.0.0.1", "localhost")]
    df = http_pages(spark.createDataFrame(rows, "key string, url string"))
    assert df.rdd.getNumPartitions() == 2 and df.filter("error IS NULL").count() == 16
    assert set(web.most.values()) == {1}


def test_a_store_commits_whole_runs(spark, web, tmp_path, monkeypatch):
    store = PageStore(spark, str(tmp_path / "pages"))
    sources = targets(spark, web, "/page", "/tagged", "/missing")
    assert store.pages().count() == 0
    first = {r.key: r for r in store.fetch(sources).collect()}
    assert first["missing"].error and {r.key for r in store.pages().collect()} == {"page", "tagged"}
    assert {r.key for r in store.fetch(sources).collect()} == {"missing"} and web.asked["/page"] == 1  # only what is left
    checked = {r.key: r.status for r in store.fetch(sources, check=True).collect()}
    assert checked["tagged"] == 304 and web.asked["/tagged"] == 2
    assert {r.key: r.html for r in store.pages().collect()}["tagged"] == "version 1"
    web.version = 2
    store.fetch(sources, check=True)
    assert {r.key: r.html for r in store.pages().collect()}["tagged"] == "version 2"
    store.fetch(sources, force=True)
    assert web.asked["/page"] == 4 and len(store.runs()) == 5
    before = store.runs()
    monkeypatch.setattr("lodestone.sources.fetch.replaced_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.fetch(sources, force=True)
    assert store.runs() == before and store.pages().count() == 2


def test_the_command(spark, web, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "manifest.json").write_text(json.dumps({"a": {"url": web.url("/page"), "fetched_at": None}, "b": {"url": web.url("/missing")}}))
    run = lambda *args: (main(["--data", str(tmp_path), "fetch", "--attempts", "1", *args], spark), *capsys.readouterr())
    code, out, err = run()
    rows = {r["key"]: r for r in map(json.loads, out.splitlines())}
    assert code == 1 and "status 404" in err and rows["a"]["status"] == 200 and rows["b"]["error"] == "status 404"
    assert read_pages(spark, f"{raw}/a.html").first().html.strip() == "page /page 規格 Mozilla"
    status = {r["key"]: r["cached"] for r in map(json.loads, run("--status")[1].splitlines())}
    assert status == {"a": True, "b": False}
    assert [json.loads(x)["key"] for x in run()[1].splitlines()] == ["b"] and web.asked["/page"] == 1
    run("--force")
    assert web.asked["/page"] == 2 and json.loads((raw / "manifest.json").read_text())["a"]["bytes"] > 10
