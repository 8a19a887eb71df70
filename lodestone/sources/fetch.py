"""Pages from the web as a data source: one partition for each host, asked politely, and a store whose manifest commits once.

    spark.dataSource.register(HttpPages)
    spark.read.format("lodestone_http").option("targets", json).load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.message import Message
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import hadoop, ready, replaced_text
from .tables import REFUSED, REFUSED_WITHIN

#: Fixed value: what a browser says of itself; servers refuse others.
HEADERS = {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0", "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.7,zh-TW;q=0.5"}
#: Answers after which a request is made again.
AGAIN = {408, 425, 429, 500, 502, 503, 504}
PAGES = "key string, url string, status int, html string, bytes long, fetched_at timestamp, etag string, last_modified string, error string"


@dataclass
class Limits:
    """Seconds of a request, bytes of a page, requests for a page, and seconds before the second one, doubled for each after that."""

    timeout: float = 30.0
    max_bytes: int = 16 << 20
    attempts: int = 4
    pause: float = 1.0
    longest_pause: float = 60.0


@dataclass
class Host(InputPartition):
    """The pages to be had from one host: (key, url, etag, last_modified)."""

    name: str
    targets: list[tuple] = field(default_factory=list)


def charset_of(headers: Message) -> str:
    name = headers.get_content_charset() or "utf-8"
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name


def page_of(url: str, etag: str | None, last_modified: str | None, limits: Limits, headers: dict[str, str]) -> dict:
    """status, html, bytes, etag, last_modified and error of a page. Redirects are followed; what was fetched before and is the same
    has status 304 and no html; refusals, pages beyond the size and answers other than 200 are errors.
    """
    asked = headers | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})
    found: dict = {"status": None, "html": None, "bytes": None, "etag": etag, "last_modified": last_modified, "error": None}
    for attempt in range(limits.attempts):
        wait = min(limits.longest_pause, limits.pause * 2**attempt)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=asked), timeout=limits.timeout) as answer:
                body = answer.read(limits.max_bytes + 1)
                found |= {"status": answer.status, "error": None}
                if len(body) > limits.max_bytes:
                    return found | {"error": f"more than {limits.max_bytes} bytes"}
                html = body.decode(charset_of(answer.headers), "replace")
                if REFUSED in html[:REFUSED_WITHIN]:
                    return found | {"error": "the page is a refusal"}
                return found | {"html": html, "bytes": len(html.encode()), "etag": answer.headers.get("ETag"), "last_modified": answer.headers.get("Last-Modified")}
        except urllib.error.HTTPError as e:
            found["status"] = e.code
            if e.code == 304:
                return found | {"error": None}
            found["error"] = f"status {e.code}"
            if e.code not in AGAIN:
                return found
            told = e.headers.get("Retry-After", "")
            wait = min(limits.longest_pause, float(told)) if told.isdigit() else wait
        except (OSError, ValueError) as e:
            found["error"] = f"{type(e).__name__}: {e}"
            if isinstance(e, ValueError):
                return found
        if attempt + 1 < limits.attempts:
            time.sleep(wait)
    return found


class HostReader(DataSourceReader):
    def __init__(self, targets: list[dict], limits: Limits, headers: dict[str, str]):
        self.targets, self.limits, self.headers = targets, limits, headers

    def partitions(self) -> list[Host]:
        hosts: dict[str, Host] = {}
        for t in self.targets:
            name = urlsplit(t["url"]).netloc.lower()
            hosts.setdefault(name, Host(name)).targets.append((t["key"], t["url"], t.get("etag"), t.get("last_modified")))
        return list(hosts.values()) or [Host("")]

    def read(self, partition: Host) -> Iterator[tuple]:
        for key, url, etag, last_modified in partition.targets:
            p = page_of(url, etag, last_modified, self.limits, self.headers)
            yield key, url, p["status"], p["html"], p["bytes"], datetime.now(timezone.utc).replace(microsecond=0), p["etag"], p["last_modified"], p["error"]


class HttpPages(DataSource):
    """PAGES of a registry. Options: targets (JSON: a list of key, url and, where known, etag and last_modified), the fields of Limits,
    and headers (JSON). A host's pages are asked for one after the other, hosts side by side. The registry is the list of pages to
    keep, and goes through the driver; their contents don't.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestone_http"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> HostReader:
        kinds = {"timeout": float, "max_bytes": int, "attempts": int, "pause": float, "longest_pause": float}
        limits = Limits(**{k: kind(self.options[k]) for k, kind in kinds.items() if k in self.options})
        return HostReader(json.loads(self.options["targets"]), limits, HEADERS | json.loads(self.options.get("headers", "{}")))


def http_pages(targets: DataFrame, **options) -> DataFrame:
    """PAGES for targets (key, url[, etag, last_modified])."""
    spark = targets.sparkSession
    ready(spark)
    spark.dataSource.register(HttpPages)
    rows = [r.asDict() for r in targets.select(*[c for c in ("key", "url", "etag", "last_modified") if c in targets.columns]).collect()]
    return spark.read.format("lodestone_http").options(targets=json.dumps(rows), **{k: str(v) for k, v in options.items()}).load()


@dataclass
class PageStore:
    """Fetched pages in a folder: a Parquet folder for each run, and a manifest that names the runs. A run that fails on its way leaves
    the manifest as it was, so a reader sees all of a run or nothing.
    """

    spark: SparkSession
    path: str

    def runs(self) -> list[str]:
        where, files = hadoop(self.spark, f"{self.path}/manifest.json")
        if not files.exists(where):
            return []
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest.json").collect()))["runs"]

    def _rows(self) -> DataFrame:
        """PAGES with run, the number of the run, of all runs."""
        out = self.spark.createDataFrame([], f"{PAGES}, run int")
        for n, run in enumerate(self.runs()):
            out = out.unionByName(self.spark.read.schema(PAGES).parquet(f"{self.path}/{run}").withColumn("run", F.lit(n)))
        return out

    def pages(self) -> DataFrame:
        """PAGES: of each key the copy of the last run that has one."""
        whole = self._rows().filter("html IS NOT NULL")
        last = whole.groupBy("key").agg(F.max("run").alias("run"))
        return whole.join(last, ["key", "run"]).drop("run")

    def known(self) -> DataFrame:
        """(key, fetched_at, bytes, status, etag, last_modified) of what is cached."""
        return self.pages().select("key", "fetched_at", "bytes", "status", "etag", "last_modified")

    def fetch(self, sources: DataFrame, force: bool = False, check: bool = False, **options) -> DataFrame:
        """PAGES of this run, without html. sources: (key, url). Of what is cached nothing is asked for, but with `check` whether it
        has changed, and with `force` all. What was had is committed; errors are in the rows and change nothing.
        """
        known = self.known()
        if force:
            wanted = sources.select("key", "url")
        elif check:
            wanted = sources.select("key", "url").join(known.select("key", "etag", "last_modified"), "key", "left")
        else:
            wanted = sources.select("key", "url").join(known.select("key"), "key", "left_anti")
        run = f"run-{uuid.uuid4().hex}"
        http_pages(wanted, **options).write.parquet(f"{self.path}/{run}")
        replaced_text(self.spark, f"{self.path}/manifest.json", json.dumps({"runs": [*self.runs(), run]}))
        return self.spark.read.schema(PAGES).parquet(f"{self.path}/{run}").drop("html")
