import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import common
from lodestone.llm import exact_dedup as X
from lodestone.llm import url_filter as U


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((str(r.doc_id), str(keep), len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_the_index_decides(spark, monkeypatch):
    """Whatever the index says of a text is what its documents are told."""
    docs = spark.createDataFrame([(i, f"t{i % 3}") for i in range(30)], "doc_id bigint, text string")
    true = X.owned

    def other(*args):
        return true(*args).withColumn("keep_id", F.col("keep_id") - 100).withColumn("group_size", F.col("group_size") + 1)

    monkeypatch.setattr(X, "owned", other)
    got = X.exact_dedup(docs).collect()
    assert len(got) == 30 and all(r.keep_id < 0 and r.group_size == 11 and not r.kept for r in got)


def test_popular_texts(spark, monkeypatch):
    """Keys of all kinds of popularity: joined where they are, or by a shuffle."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"warm{rng.randrange(9)}" if i % 3 == 1 else f"cold{i}") for i in range(900)], "doc_id bigint, text string").repartition(6)
    want = brute(docs.collect())
    for share, hot in ((2, 5), (20, 64), (10**9, 10**6)):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        monkeypatch.setattr(X, "HOT", hot)
        assert rows_of(X.exact_dedup(docs)) == want


def test_edges(edge_docs, no_docs):
    assert rows_of(X.exact_dedup(edge_docs)) == brute(edge_docs.collect())
    assert X.exact_dedup(no_docs).count() == 0


def test_splitting_buckets(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"text {rng.randrange(300)}" if i % 3 else "hot") for i in range(1500)], "doc_id bigint, text string")
    assert rows_of(X.exact_dedup(docs, capacity=8)) == brute(docs.collect())
    distinct = X.distinct_texts(docs)
    entries, depth = X.directory(distinct, capacity=8)
    found = entries.collect()
    assert 2 < len(found) <= 2**depth and all(e.bucket <= e.entry < e.bucket + 2 ** (depth - e.depth) for e in found)
    index = X.build_index(distinct, capacity=8)
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 8
    assert index.count() == distinct.count()


def test_colliding_keys_are_chained(spark):
    one = [(0, b"b", 1, 1), (0, b"a", 2, 1), (5, b"c", 3, 1)]
    index = X.build_index(spark.createDataFrame(one, "h bigint, sha binary, keep_id bigint, group_size bigint"), capacity=1, max_depth=4)
    assert sorted((r.h, bytes(r.sha), r.chain) for r in index.collect()) == [(0, b"a", 1), (0, b"b", 2), (5, b"c", 1)]


def test_owners_group_what_is_routed_to_them(spark):
    """Parts of a text from several tasks become one row of the index, in the task that they are routed to."""
    some = [(0, b"a", 2, 3), (0, b"b", 7, 1), (0, b"a", 9, 1), (5, b"c", None, 1), (5, b"c", 4, 2)]
    index = X.build_index(spark.createDataFrame(some, "h bigint, sha binary, keep_id bigint, group_size bigint").repartition(3), capacity=1, max_depth=4)
    assert sorted((r.h, bytes(r.sha), r.chain, r.keep_id, r.group_size) for r in index.collect()) == [(0, b"a", 1, 9, 4), (0, b"b", 2, 7, 1), (5, b"c", 1, 4, 3)]


def judge(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, default))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://Org/", "https://A.EXAMPLE.org/es/x?q=/de/", "http://example.org/en/1", "http://example.org/en/123#f", "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/fr",
    "http://x.com?/de/", "ftp://a://b/c", "http://com/de/", "http://a..org/", "http://.com/de/1", "http://x.org:80/", "http://ÄÖ.com/de/", "http://x.com/de/" + "y" * 5000, "x://" + "a." * 500 + "com/de/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i % 7 or None, u, "h") for i, u in enumerate(URLS + URLS[5:9])], "page_id bigint, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in U.filter_urls(pages, U.default_rules(spark)).collect())
    want = sorted((str(i % 7 or None), *(str(x) if x is None else x for x in judge(u, U.RULES))) for i, u in enumerate(URLS + URLS[5:9]))
    assert got == want
    assert U.filter_urls(pages.limit(0), U.default_rules(spark)).count() == 0
    none = U.filter_urls(pages, U.default_rules(spark).limit(0), default="block").collect()
    assert len(none) == pages.count() and {r.verdict for r in none} == {"block"}


def test_many_random_rules(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 5)
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in U.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == sorted((i, *(str(x) if x is None else x for x in judge(u, rules))) for i, u in enumerate(urls))
