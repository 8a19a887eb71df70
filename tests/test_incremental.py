import pytest

from lodestone.operators.dense import HashingEmbedder
from lodestone.operators.segments import SegmentIndex
from lodestone.plans import incremental
from lodestone.plans.incremental import KeptCorpus
from tests.test_html_facts import FEATURE, SKU, SPEC


def frames(spark, own):
    """own: page_id to (product, specification, prose)."""
    spec = spark.createDataFrame([(k, v[1]) for k, v in own.items()], "page_id bigint, html string")
    prose = spark.createDataFrame([(k, v[2]) for k, v in own.items()], "page_id bigint, html string")
    return {"spec_zh": spec, "spec_en": spec, "feature_en": prose}, spark.createDataFrame([(k, v[0]) for k, v in own.items()], "page_id bigint, product string")


def contents(corpus):
    chunks = {(r.page_id, r.ord, r.chunk_id, r.text) for r in corpus.chunks().collect()}
    vectors = {(r.ord, tuple(round(x, 6) for x in r.v)) for r in corpus.vectors().collect()}
    return chunks, vectors


def test_updates_equal_a_whole_build(spark, tmp_path, monkeypatch):
    """Inserts, changes, deletions and a bucket that empties: the same as a build of all that is there, and only changes are parsed."""
    monkeypatch.setattr(incremental, "BUCKETS", 5)
    parsed = []
    real = incremental.build_corpora
    monkeypatch.setattr(incremental, "build_corpora", lambda *a, **k: parsed.append(sorted(r.page_id for r in a[0].collect())) or real(*a, **k))
    page = lambda n, hz="240Hz", name="Pro 16": (name, SPEC.replace("240Hz", hz) + SKU, FEATURE.replace("Cooling", f"Cooling {n}"))
    own = {k: page(k) for k in range(1, 7)}
    kept = KeptCorpus(spark, str(tmp_path / "kept"), HashingEmbedder(32))
    assert kept.update(*frames(spark, own), validate=False) == {"built": 6, "gone": 0}
    assert kept.update(*frames(spark, own), validate=False) == {"built": 0, "gone": 0}
    own[2], own[9] = page(2, "165Hz"), page(9)
    own[5] = (own[5][0], own[5][1], FEATURE)
    del own[4]
    assert kept.update(*frames(spark, own), validate=False) == {"built": 3, "gone": 1}
    own = {k: own[k] for k in (2, 9)}
    assert kept.update(*frames(spark, own), validate=False) == {"built": 0, "gone": 4}
    own[7] = page(7, "99Hz", "Other")
    assert kept.update(*frames(spark, own), validate=False) == {"built": 1, "gone": 0}
    assert parsed == [[1, 2, 3, 4, 5, 6], [2, 5, 9], [], [7]]
    whole = KeptCorpus(spark, str(tmp_path / "whole"), HashingEmbedder(32))
    whole.update(*frames(spark, own), validate=False)
    assert contents(kept) == contents(whole)
    assert {r.page_id for r in kept.digests().collect()} == {2, 7, 9}
    asked = spark.createDataFrame([("a", "display refresh rate 165Hz"), ("b", "cooling fans")], "qid string, text string")
    hits = lambda c, mode: sorted((r.qid, r["rank"], r.page_id, r.chunk_id, round(r.score, 6)) for r in c.retriever(mode).search(asked, 4).collect())
    assert hits(kept, "bm25") == hits(whole, "bm25") and hits(kept, "hybrid") == hits(whole, "hybrid")
    one, two = (SegmentIndex.open(spark, f"{c.path}/lexical") for c in (kept, whole))
    assert (one.n_docs, one.avg_len) == (two.n_docs, two.avg_len)


def test_a_failed_update_is_done_again(spark, tmp_path, monkeypatch):
    kept = KeptCorpus(spark, str(tmp_path / "kept"))
    own = {1: ("Pro 16", SPEC, FEATURE)}
    with monkeypatch.context() as m:
        m.setattr(SegmentIndex, "replace", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.update(*frames(spark, own), validate=False)
    assert kept.digests().count() == 0
    assert kept.update(*frames(spark, own), validate=False) == {"built": 1, "gone": 0}
    n = kept.chunks().count()
    assert n == SegmentIndex.open(spark, f"{kept.path}/lexical").n_docs == kept.chunks().select("ord").distinct().count()
