import numpy as np
import pytest

from lodestone.operators import dense
from lodestone.operators.dense import cosine_search
from lodestone.operators.pivots import PivotIndex, chosen_pivots


def plain(vectors, queries, top_k):
    unit = lambda v: np.array(v, float) / max(float(np.linalg.norm(v)), 1e-12)
    out = []
    for qid, q in queries:
        if q is None:
            continue
        scores = sorted((-(round(float(unit(q) @ unit(v)), 6) + 0.0), o) for o, v in vectors if v is not None)
        out += [(qid, o, -s + 0.0, r) for r, (s, o) in enumerate(scores[:top_k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.qid, r.ord, round(r.score, 6) + 0.0, r.rank) for r in df.collect())


def clustered(seed, n=1200, dim=6, centres=12):
    """Points about some directions, one of which has a third of them; copies, zeros, and one without a vector."""
    rng = np.random.default_rng(seed)
    about = rng.normal(size=(centres, dim))
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centres, n))
    v = np.round(about[which] + rng.normal(scale=0.05, size=(n, dim)), 3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000 + i, v[i].tolist()) for i in range(60)]
    return rows + [(9000, [0.0] * dim), (9001, [0.0] * dim), (9002, None), (9003, (-v[0]).tolist())]


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "ord bigint, v array<double>").repartition(5), spark.createDataFrame(asked, "qid string, v array<double>")


@pytest.mark.parametrize("top_k", [1, 7, 2000])
def test_both_searches_against_all_pairs(spark, top_k):
    rows = clustered(1)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(rows[::130])] + [("zero", [0.0] * 6), ("none", None), ("far", [1.0, -2.0, 3.0, -4.0, 5.0, -6.0])]
    want = plain(rows, asked, top_k)
    vectors, queries = frames(spark, rows, asked)
    assert rows_of(cosine_search(vectors, queries, top_k)) == want
    index = PivotIndex.temporary(vectors, 20)
    assert rows_of(index.search(queries, top_k)) == want
    if top_k < 10:
        compared, total = index.compared(queries.filter("qid LIKE 'q%'"), top_k)
        assert compared < total / 2


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    rows = clustered(2, 300)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(rows[:40:3])]
    vectors, queries = frames(spark, rows, asked)
    want = plain(rows, asked, 5)
    assert rows_of(cosine_search(vectors, queries, 5)) == want == rows_of(PivotIndex.temporary(vectors, 8).search(queries, 5))


def test_a_task_gives_no_more_than_its_best(spark, monkeypatch):
    """However many batches a task reads, at most top_k rows a query leave it; over many tasks they are merged in two steps."""
    rows = clustered(3, 900)
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(rows[:3])]
    vectors, queries = frames(spark, rows, asked)
    ids, q = next(iter(dense.query_blocks(queries)))
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        sent = spark.sparkContext.broadcast((pa.array(ids), q))
        out = vectors.filter("v IS NOT NULL").mapInArrow(dense.best_of(sent, 4), "qid string, ord bigint, score double, task int")
        assert out.groupBy("task", "qid").count().filter("count > 4").isEmpty() and out.count() <= 5 * 3 * 4
        monkeypatch.setattr(dense, "MANY_BYTES", 0)
        monkeypatch.setattr(dense, "FAN", 2)
        assert rows_of(cosine_search(vectors, queries, 4)) == plain(rows, asked, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    none, asked = frames(spark, [], [("q", [1.0, 2.0])])
    assert cosine_search(none, asked, 3).count() == 0 == PivotIndex.temporary(none).search(asked, 3).count()
    some, nobody = frames(spark, [(1, [1.0, 2.0])], [])
    assert cosine_search(some, nobody, 3).count() == 0 == PivotIndex.temporary(some).search(nobody, 3).count()
    zeros, _ = frames(spark, [(2, [0.0, 0.0]), (1, [0.0, 0.0])], [])
    assert [r.ord for r in PivotIndex.temporary(zeros).search(asked, 1).collect()] == [1]
    odd, _ = frames(spark, [(1, [1.0, 2.0, 3.0])], [])
    with pytest.raises(Exception, match="the queries' have 2"):
        cosine_search(odd, asked, 3).collect()
    assert chosen_pivots(np.zeros((3, 4)), 5).shape == (0, 4)


def test_a_kept_index(spark, tmp_path):
    rows = clustered(4, 200)
    asked = [("q", rows[5][1])]
    vectors, queries = frames(spark, rows, asked)
    PivotIndex.create(vectors, str(tmp_path / "p"), 6)
    assert rows_of(PivotIndex.open(spark, str(tmp_path / "p")).search(queries, 9)) == plain(rows, asked, 9)


def test_scores_are_held_for_some_queries_at_a_time(monkeypatch):
    """A task's product of matrices stays small, however many queries were sent and rows come at once."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators import dense

    rng, sizes, true = np.random.default_rng(7), [], dense.rounded
    q, v = rng.normal(size=(700, 8)), rng.normal(size=(3000, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    monkeypatch.setattr(dense, "rounded", lambda score: sizes.append(score.shape) or true(score))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(v.tolist())], names=["ord", "v"])
    sent = type("Sent", (), {"value": (pa.array(range(700), pa.int64()), q)})
    got = [r for b in dense.best_of(sent, 3)(iter([batch])) for r in b.to_pylist()]
    assert max(a * b for a, b in sizes) <= 256 * 1024
    score = true(q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T)
    want = {(k, int(o)) for k in range(700) for o in np.lexsort((np.arange(3000), -score[k]))[:3]}
    assert {(r["qid"], r["ord"]) for r in got} == want and len(got) == 2100
