import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import segments
from lodestone.operators.dense import tokens_of
from lodestone.operators.lexical import bm25_search, build_index
from lodestone.operators.segments import SegmentIndex, posting_blocks
from lodestone.plans.retrieval import load_retriever


def plain(docs, queries, top_k):
    """BM25 with every document scored: (qid, ord, score, rank), ties by ord."""
    bags = [(o, tokens_of(t or "")) for o, t in docs]
    df = Counter(w for _, ws in bags for w in set(ws))
    n, avg = len(bags), sum(len(ws) for _, ws in bags) / max(len(bags), 1)
    out = []
    for qid, text in queries:
        scores = []
        for o, ws in bags:
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in sorted(set(tokens_of(text))) if tf[w])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), o))
        out += [(qid, o, -s, r) for r, (s, o) in enumerate(sorted(scores)[:top_k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.qid, r.ord, round(r.score, 6), r.rank) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame(docs, "ord bigint, text string").repartition(3)


def corpus(rng, n, words=60):
    vocabulary = [f"w{k}" for k in range(words)]
    return [(o, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(words)], k=rng.randint(1, 60)))) for o in range(n)]


QUERIES = [("a", "w0 w1 w40"), ("b", "w59 w3"), ("c", "w0"), ("d", "nothing"), ("e", "w7 w8 w9 w10 w11 w12 w50"), ("f", "")]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "SHARD", 150)


@pytest.mark.parametrize("top_k", [1, 3, 10, 1000])
def test_pruned_search_equals_scoring_everything(spark, small_blocks, top_k):
    """Many documents tie at the threshold: half of them are copies of others."""
    docs = corpus(random.Random(1), 300)
    docs += [(1000 + o, t) for o, t in docs]
    asked = spark.createDataFrame(QUERIES, "qid string, text string")
    index = SegmentIndex.temporary(frame(spark, docs))
    assert rows_of(index.search(asked, top_k)) == plain(docs, QUERIES, top_k)
    assert rows_of(bm25_search(build_index(frame(spark, docs)), asked, top_k)) == plain(docs, QUERIES, top_k)
    work = {r.qid: r for r in index.work(asked, top_k).collect()}
    assert all(r.scored <= r.postings for r in work.values())
    if top_k <= 3:
        assert work["a"].scored < work["a"].postings / 2 and work["e"].scored < work["e"].postings


def test_many_queries_come_in_blocks(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(segments, "TERM_ROWS", 5)
    monkeypatch.setattr(segments, "PUSHED", 2)
    docs = corpus(random.Random(2), 200)
    asked = [(q, t) for q, t in QUERIES]
    assert rows_of(SegmentIndex.temporary(frame(spark, docs)).search(spark.createDataFrame(asked, "qid string, text string"), 5)) == plain(docs, asked, 5)


def test_changes_equal_a_whole_rebuild(spark, small_blocks, tmp_path):
    rng = random.Random(3)
    docs = corpus(rng, 240)
    asked = spark.createDataFrame(QUERIES, "qid string, text string")
    now = dict(docs[:100])
    index = SegmentIndex.create(spark, str(tmp_path / "index"), frame(spark, docs[:100]))
    same = lambda: rows_of(index.search(asked, 8)) == plain(sorted(now.items()), QUERIES, 8)
    assert same()
    index = index.append(frame(spark, docs[100:200]))
    now |= dict(docs[100:200])
    assert same() and index.n_docs == 200
    index = index.delete(frame(spark, docs[50:150]).select("ord"))
    for o, _ in docs[50:150]:
        del now[o]
    assert same() and index.n_docs == 100
    changed = [(o, t + " w59 w59") for o, t in docs[30:60]]  # some are there, some were deleted
    index = index.replace(frame(spark, changed))
    now |= dict(changed)
    assert same()
    index = index.append(frame(spark, [(900, None), (901, ""), (902, "...")]))
    now |= {900: None, 901: "", 902: "..."}
    assert same()
    index = index.delete(frame(spark, [(900, ""), (12345, ""), (0, "")]).select("ord"))
    del now[900], now[0]
    assert same()
    merged = index.merged()
    assert rows_of(merged.search(asked, 8)) == rows_of(index.search(asked, 8)) and len(merged.segments) == 1 and not merged.marks
    assert (merged.n_docs, merged.avg_len) == (index.n_docs, index.avg_len)
    df = {r.term: r.df for r in merged.term_df().collect()}
    assert df == {r.term: r.df for r in index.term_df().collect()} == dict(Counter(w for t in now.values() for w in set(tokens_of(t or ""))))
    # Older versions stay until they are swept out; then only the named folders are left.
    old = SegmentIndex.open(spark, str(tmp_path / "index"), 1)
    assert rows_of(old.search(asked, 8)) == plain(docs[:100], QUERIES, 8)
    assert merged.vacuum() and {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")} == {"manifest", merged.segments[0]["id"]}
    index = SegmentIndex.open(spark, str(tmp_path / "index"))
    assert same() and index.version == merged.version


def test_two_writers(spark, tmp_path):
    first = SegmentIndex.create(spark, str(tmp_path), frame(spark, [(1, "a b")]))
    again = SegmentIndex.open(spark, str(tmp_path))
    first.append(frame(spark, [(2, "b")]))
    with pytest.raises(FileExistsError, match="open the index again"):
        again.append(frame(spark, [(3, "b")]))
    found = SegmentIndex.open(spark, str(tmp_path))
    assert found.n_docs == 2 and len(json.loads((tmp_path / "manifest" / "2.json").read_text())["segments"]) == 2


def test_empty_indexes(spark, tmp_path):
    asked = spark.createDataFrame([("q", "a")], "qid string, text string")
    with pytest.raises(FileNotFoundError):
        SegmentIndex.open(spark, str(tmp_path / "none"))
    index = SegmentIndex.create(spark, str(tmp_path / "i"))
    assert index.search(asked).count() == 0 and index.n_docs == 0 and index.avg_len is None
    index = index.append(frame(spark, [(1, None)]))
    assert index.search(asked).count() == 0 and index.n_docs == 1
    index = index.append(frame(spark, [(2, "a a"), (2, "a")])).delete(frame(spark, [(2, "")]).select("ord"))
    assert index.search(asked).count() == 0 and index.term_df().count() == 0 and index.merged().search(asked).count() == 0


def test_blocks_know_their_best_postings(spark, monkeypatch):
    """No posting is beaten by all that a block keeps, and what it keeps are the largest for any mean length."""
    monkeypatch.setattr(segments, "BLOCK", 16)
    rng = random.Random(4)
    postings = [(0, "t", o, rng.randint(1, 6), rng.randint(6, 40)) for o in range(100)]
    blocks = posting_blocks(spark.createDataFrame(postings, "shard int, term string, ord bigint, tf bigint, doc_len int")).orderBy("block").collect()
    assert [len(b.ords) for b in blocks] == [16] * 6 + [4] and [o for b in blocks for o in b.ords] == list(range(100))
    for b in blocks:
        for avg in (3, 20, 200):
            gain = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
            assert max(map(gain, b.best_tf, b.best_len)) == pytest.approx(max(map(gain, b.tfs, b.lens)), abs=1e-12)
        assert len(b.best_tf) <= 6


def test_only_the_queries_terms_are_read(spark):
    docs = corpus(random.Random(5), 100)
    plan = SegmentIndex.temporary(frame(spark, docs)).search(spark.createDataFrame([("q", "w3 w4")], "qid string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(term, [" in plan


def test_a_kept_index_is_opened(spark, tmp_path, monkeypatch):
    """load_retriever reads what is there, builds nothing, and says so if it is of another corpus."""
    chunks = spark.createDataFrame([(0, "d", "fact", "alpha beta", "", ""), (1, "d", "fact", "beta", "", "")], "ord bigint, doc_id string, kind string, text string, key_zh string, key_en string")
    SegmentIndex.create(spark, str(tmp_path / "lexical"), chunks)
    monkeypatch.setattr(SegmentIndex, "temporary", None)
    asked = spark.createDataFrame([("q", "alpha")], "qid string, text string")
    assert [r.ord for r in load_retriever(chunks, str(tmp_path), mode="bm25").search(asked).collect()] == [0]
    with pytest.raises(ValueError, match="build it again"):
        load_retriever(chunks.filter(F.col("ord") == 0), str(tmp_path), mode="bm25")


def test_a_shard_stays_small(spark, monkeypatch):
    """What a task holds doesn't grow with the corpus: shards follow its documents and its characters; and what is shuffled to build
    them are texts, once.
    """
    index = SegmentIndex(spark, "unused")
    assert index._shards(4_000_000) * 4096 >= 4_000_000 and index._shards(10, 1 << 30) >= 64
    plans = []
    monkeypatch.setattr(SegmentIndex, "_write", lambda self, blocks: plans.append(blocks._jdf.queryExecution().executedPlan().toString()) or {})
    index._segment(frame(spark, corpus(random.Random(6), 50)), "text", "ord")
    assert plans[0].count("hashpartitioning") == 1 and "MapInArrow" not in plans[0]


def test_changed_postings_are_not_exploded(spark, small_blocks, monkeypatch):
    """Deleted documents meet the postings of their shard as lists, and leave every other one."""
    import numpy as np
    import pyarrow as pa

    blocks = pa.table([pa.array(["a", "b", "c"]), pa.array([[1, 2], [2], [3, 4, 5]]), pa.array([[1, 2], [3], [4, 5, 6]], pa.list_(pa.int32())), pa.array([[9, 8], [8], [7, 6, 5]], pa.list_(pa.int32()))], names=["term", "ords", "tfs", "lens"])
    gone = pa.table([pa.array([2, 4, 99])], names=["ord"])
    assert segments.lost_terms(blocks, gone).to_pylist() == [{"term": "a", "df": 1}, {"term": "b", "df": 1}, {"term": "c", "df": 1}]
    left = segments.live_lists(blocks, gone)
    assert left.column("ords").to_pylist() == [[1], [], [3, 5]] and left.column("tfs").to_pylist() == [[1], [], [4, 6]] and left.column("lens").to_pylist() == [[9], [], [7, 5]]
    assert np.array_equal(segments.live_lists(blocks, gone.slice(0, 0)).column("ords").to_pylist()[2], [3, 4, 5])
    assert segments.live_lists(blocks.slice(0, 0), gone).num_rows == segments.lost_terms(blocks.slice(0, 0), gone).num_rows == 0
