import duckdb

from lodestone.queries import ALL
from lodestone.queries.evaluation import gold

WORDS = "one two three four five six seven eight nine ten"
TEXTS = [WORDS, f"x{WORDS}y", WORDS.replace(" ", "\n"), f"  {WORDS}  ", "one two", "", None, "seven", "xone two three fourth", "電池容量九十九", WORDS + " " + WORDS, "one  two three four five six seven eight"]
ITEMS = [
    WORDS, "ne two three four five six seven eight nine te", "two three four five six", "wo three four five si", "hree four fiv", "one two", "e t", "seven", "eve",
    "", " ", " two ", "one two three four", "\none", "容量", "two three four five six ", None, "absent words that no document has at all", "two two", " one two three four five six seven",
]


def test_items_that_begin_and_end_anywhere(spark, tmp_path):
    """Gold is whatever SQL's contains() finds: items of few words, of none, without blanks and with parts of words at their ends too."""
    good = {i for i in range(len(TEXTS)) if i != 10} | {99}
    docs = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, "another text of the same id: absent words that", "fr", "src1", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in good), 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = gold(spark, str(tmp_path)).collect()
    want = {(q, d) for q, item in enumerate(ITEMS) for d, text, *_ in docs if None not in (item, text) and d in good and item in text}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {q for q, _ in want} >= {0, 1, 3, 4, 6, 8, 9, 14} and 17 not in {q for q, _ in want}

    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("recall_mrr", "recall_sweep"):
        query, sql = ALL[name]
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_only_items_without_inner_words(spark, tmp_path):
    spark.createDataFrame([(0, "a b", "en", "s", 3), (1, "c", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a b"), (1, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, gold(spark, str(tmp_path)).collect())) == [(0, 0), (1, 0), (1, 1)]
