"""The stages of the pipeline on awkward rows; test_near_and_leaks holds them against brute force on whole tables."""

import hashlib

import pytest

import corpus_pipeline as P

LONG = "every word of this text is said once more so that it is long enough to be compared with others"
ITEM = "seven brave foxes jump over thirteen sleepy dogs while nobody near the river looks at them at all tonight"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, kept boolean, node int, t string, leak int, gone_id int, score double"


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, 1, None, 2, 3, 0.0) for i, t in rows], SCHEMA).repartition(3)


def told(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels by which long texts are good, and a benchmark with odd rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, i % 2 if i % 5 else None, None) for i in range(40)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "another item that no document of these holds, whatever its words may be")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_quality(spark, folder):
    docs = rows_of(spark, *((i, "$$$ %%% " * 9 if i % 2 == 0 else f"{LONG} {i}") for i in range(40)), (None, None), (41, ""), (41, LONG), (41, "$$$ %%% " * 9), (41, "$$$ %%% " * 9))
    kept = P.quality_classifier(spark, docs, folder)
    assert set(kept.columns) == set(docs.columns)
    got = told(kept)
    assert [x for x in got if "$$$" in x[1]] == [] and ("41", LONG) in got and sum(LONG in t for _, t in got) == 21
    assert P.quality_classifier(spark, docs.limit(0), folder).count() == 0


def test_exact_duplicates(spark, folder):
    docs = rows_of(spark, (1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (None, "c"), (None, None), (None, ""), (7, "d" * 60_000), (8, "d" * 60_000))
    kept = P.exact_duplicates(spark, docs, folder)
    assert set(kept.columns) == set(docs.columns)
    # The row 2 with text a and the row 3 with text c stay though other rows with their ids go.
    assert told(kept) == sorted([("2", "a"), ("2", "a"), ("3", "b"), ("3", "c"), ("None", "None"), ("None", ""), ("8", "d" * 60_000)])
    assert P.exact_duplicates(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates(spark, folder):
    near = LONG.replace("once", "twice") * 3
    docs = rows_of(spark, (1, LONG * 3), (2, LONG * 3 + " end"), (1, "a text of its own that is near to no other one here"), (None, LONG * 3 + " END"), (None, "one without an id that is like no other of all these"), (5, None), (6, ""), (6, ""), (7, near), (7, near + " end"))
    kept = P.near_duplicates(spark, docs, folder)
    assert set(kept.columns) == set(docs.columns)
    got = told(kept)
    assert ("1", LONG * 3) in got and ("1", "a text of its own that is near to no other one here") in got and ("None", "one without an id that is like no other of all these") in got
    assert ("2", LONG * 3 + " end") not in got and ("None", LONG * 3 + " END") not in got
    # Of the texts without words the one with the least id stays, and of two near texts with one id one.
    assert [x for x in got if x[0] in "567" or x[1] == "None"].count(("5", "None")) == 1 and not [x for x in got if x[0] == "6"]
    assert sum(x[0] == "7" for x in got) == 1
    assert P.near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_decontamination(spark, folder):
    docs = rows_of(spark, (1, f"{LONG} {ITEM} {LONG}"), (1, LONG), (None, ITEM), (None, LONG), (None, None), (4, ""), (5, ITEM.upper()), (5, ITEM.upper()), (6, " ".join([LONG] * 3000 + [ITEM])))
    kept = P.benchmark_decontamination(spark, docs, folder)
    assert set(kept.columns) == set(docs.columns)
    assert told(kept) == sorted([("1", LONG), ("None", LONG), ("None", "None"), ("4", "")])
    assert P.benchmark_decontamination(spark, docs.limit(0), folder).count() == 0


def test_bpe(spark, folder):
    docs = rows_of(spark, (1, "a b"), (1, "a b"), (None, None), (2, ""), (2, "x" * 5000))
    got = sorted((str(r.doc_id), r.n_tokens > 0, r.decoded_sha256) for r in P.byte_level_bpe(spark, docs, folder).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([("1", True, digest("a b")), ("1", True, digest("a b")), ("None", False, digest("")), ("2", False, digest("")), ("2", True, digest("x" * 5000))])
    assert P.byte_level_bpe(spark, docs.limit(0), folder).count() == 0


def test_whole_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    rows_of(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
