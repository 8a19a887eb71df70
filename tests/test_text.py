import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.dense import tokens_of


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("RTX 5080 Wi-Fi v5.4", ["rtx", "5080", "wi-fi", "v5.4"]),
        ("螢幕更新率 240Hz", ["240hz", "螢", "幕", "更", "新", "率", "螢幕", "幕更", "更新", "新率"]),
        ("電 a 池", ["a", "電", "池"]),
        ("Schöpf한", ["sch", "pf"]),
        ("", []),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, T.tokenize) == tokens
    assert sorted(tokens_of(text)) == sorted(tokens)


@pytest.mark.parametrize(("text", "lang"), [("What is it?", "en"), ("電池容量多少", "zh"), ("這台的 refresh rate 是多少", "zh"), ("What's the 電池 capacity?", "en"), ("", "en"), ("豈", "zh")])
def test_language(spark, text, lang):
    assert one(spark, text, T.detect_language) == lang


def test_cleaning(spark):
    assert one(spark, "　 a \t b\nc  ", T.clean) == "a b\nc"
    assert one(spark, "螢幕 /（Display）(x)", T.normalise_key) == "螢幕displayx"
    assert one(spark, None, T.clean) is None


def test_windows_pack_sentences_and_overlap(spark):
    a, b, c = "a" * 150 + "!", "b" * 80 + "!", "c" * 50 + "!"
    got = one(spark, f"{a}  {b}\n{c}", T.windows)
    assert got == [f"{a} {b}", ("b" * 39 + "!") + " " + c]
    assert one(spark, "short one", T.windows) == ["short one"]
    assert one(spark, "x" * 300, T.windows) == ["x" * 300]
    assert one(spark, "3!3!" * 80, T.sentences) == ["3!"] * 160


def test_answers(spark):
    assert one(spark, "That is NOT mentioned here", T.is_refusal) is True
    assert one(spark, "99Wh", T.is_refusal) is False
    groups = F.array(F.array(F.lit("left"), F.lit("左")), F.array(F.lit("TB5")))
    assert one(spark, "在左側 tb5", lambda c: T.keyword_hit(c, groups)) is True
    assert one(spark, "在左側", lambda c: T.keyword_hit(c, groups)) is False
    assert one(spark, "", lambda c: T.keyword_hit(c, F.array().cast("array<array<string>>"))) is True
    g = one(spark, "1,000,000:1 and 24 [3] 7", lambda c: T.number_grounding(c, F.lit("contrast 1000000 at 240")))
    assert (g.grounded, g.total) == (3, 4)  # the 1 of the ratio and 24 are in 1000000 and 240; 7 isn't


def test_thinking(spark):
    assert one(spark, "<think>a\nb</think>\n x", T.strip_thinking) == "x"
    assert one(spark, "rest</think> y /no_think ", T.strip_thinking) == "y"
    assert one(spark, "a</think>b</think>c", T.strip_thinking) == "b</think>c"
    assert one(spark, "<think></think>答 /no_output 案", T.strip_thinking) == "答 案"


def test_hash_embedding_query(spark, tmp_path):
    """The query's rows, dimension by dimension, against hashing each token plainly."""
    import hashlib
    import math

    from lodestone.queries.text import hash_embedding

    texts = ["Alpha beta alpha", "", None, "x-1 電池容量 y.2", "word " * 300 + "other"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(texts):
        v = [0.0] * 512
        for w in tokens_of(t or ""):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 512] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        want |= {(i, d, round(x / norm, 6)) for d, x in enumerate(v) if x}
    assert {(r.doc_id, r.dim, r.x) for r in hash_embedding(spark, str(tmp_path)).collect()} == want
