import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe as B
from lodestone.llm import token_counts as T

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "日本", "　", "\x85", "\x1c", "²", "!", "!!", "the", "ing", "\r\n", "\u00a0", "😀", "'ll", "▁", "\x00"]
mixed = st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PARTS), max_size=60).map("".join))


@settings(max_examples=400, deadline=None)
@given(mixed, st.integers(1, 9), st.integers(1, 4))
def test_tree_equals_the_whole(text, leaf, window):
    codec = B.load_codec(RANKS, P.PATTERN)
    ids = codec.encode(text, leaf=leaf, window=window)
    assert ids == codec.leaf(text)
    assert codec.decode(ids, leaf=leaf) == text.encode()


@settings(max_examples=100, deadline=None)
@given(mixed, mixed, mixed)
def test_join_is_a_monoid(a, b, c):
    codec, text = B.load_codec(RANKS, P.PATTERN), a + b + c
    i, j, n = len(a), len(a + b), len(text)
    one, two, three = codec.leaf(a), codec.leaf(b), codec.leaf(c)
    left = codec.join(text, 0, j, n, codec.join(text, 0, i, j, one, two), three)
    right = codec.join(text, 0, i, n, one, codec.join(text, i, j, n, two, three))
    assert left == right == codec.leaf(text)
    assert codec.join(text, 0, 0, n, [], codec.leaf(text)) == codec.leaf(text)


@settings(max_examples=400, deadline=None)
@given(mixed)
def test_counts_equal_the_model(text):
    sp = T.load_model(MODEL)
    found = T.Counter(T.pre_tokens(text)) if text else {}
    one_by_one = [T.pieces(sp, [t])[0] for t in found]
    assert one_by_one == T.pieces(sp, list(found))
    assert sum(n * k for n, k in zip(found.values(), one_by_one, strict=True)) + text.count("\n") == len(sp.encode(text))


def test_bpe_rows(spark, edge_docs, no_docs):
    codec = B.load_codec(RANKS, P.PATTERN)
    got = B.round_trip(edge_docs, RANKS, P.PATTERN).collect()
    assert len(got) == edge_docs.count()
    want = sorted((str(r.doc_id), len(codec.leaf(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == want
    assert B.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    encoded = B.encode_texts(edge_docs.filter("doc_id < 7"), RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in B.decode_ids(encoded, RANKS, P.PATTERN).collect()}
    assert back == {r.doc_id: r.text or "" for r in edge_docs.filter("doc_id < 7").collect()}


def test_whole_queries_against_the_libraries(spark):
    """op1 and op9 over a whole table, every column held against the libraries run on each whole text."""
    import os

    import sentencepiece
    import tiktoken

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    codec, sp = B.load_codec(RANKS, P.PATTERN), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ranks = {t: i for i, t in enumerate(codec.bytes_of) if t}
    library = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op1_byte_bpe(spark, sf).collect()}
    ids = {i: library.encode_ordinary(t) for i, t in texts.items()}
    assert got == {(i, len(x), digest(" ".join(map(str, x)).encode()), digest(texts[i].encode())) for i, x in ids.items()}
    assert max(map(len, texts.values())) > 8 * B.LEAF and sum(len(t) > B.LEAF for t in texts.values()) > 0.9 * len(texts)  # trees, not leaves
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.op9_token_counts(spark, sf).collect()}
    assert got == {(i, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts.items()}


def test_count_rows(spark, edge_docs, no_docs):
    sp = T.load_model(MODEL)
    got = T.count_tokens(edge_docs, MODEL, limit=2).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 2) for r in edge_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert T.count_tokens(no_docs, MODEL).count() == 0


def test_each_pre_token_is_counted_once(spark):
    rng = random.Random(3)
    long = "x" * 300
    docs = [(i if i % 9 else None, " ".join([rng.choice(["the", "of", long, long + "y", *PARTS]) for _ in range(40)])) for i in range(60)]
    df = spark.createDataFrame([*docs, docs[0], docs[1]], "doc_id bigint, text string").repartition(5)
    sp = T.load_model(MODEL)
    want = sorted((str(d), len(sp.encode(t))) for d, t in [*docs, docs[0], docs[1]])
    for hot in (0, 1, 7, 10_000):  # joined by a shuffle, partly, and by broadcast only
        assert sorted((str(r.doc_id), r.n_tokens) for r in T.count_tokens(df, MODEL, hot=hot).collect()) == want
    known = T.frequent(df.select("text").coalesce(1), MODEL, 5)
    assert len(known) == 5 and all(len(k) <= T.KEY for k in known)
    pairs = T.frequencies(df.select("doc_id", "text"), known).select(F.monotonically_increasing_id().alias("row"), F.inline("rest")).cache()
    assert not {r.token for r in pairs.collect()} & set(known)
    want = T.Counter()
    for r in pairs.collect():
        want[r.row] += r.k * T.pieces(sp, [r.token])[0]
    got = T.Counter()
    for r in T.joined(pairs, MODEL).collect():
        got[r.row] += r.n
    assert got == want


def test_each_distinct_pre_token_is_counted_once(monkeypatch):
    """Batches of two rows: what the sorted stream hands to the model holds no pre-token twice."""
    counted, true = [], T.pieces
    monkeypatch.setattr(T, "pieces", lambda sp, tokens: counted.extend(tokens) or true(sp, tokens))
    rows = sorted((f" w{i % 23}", i) for i in range(200))
    cut = [rows[i : i + 2] for i in range(0, 200, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r for _, r in c]), pa.array([t for t, _ in c]), pa.array([3, 3])], ["row", "token", "k"]) for c in cut]
    got = [x for out in T.sorted_counts(MODEL)(iter(batches)) for x in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    sp = T.load_model(MODEL)
    assert got == [(i, 3 * true(sp, [t])[0]) for t, i in rows]
    assert sorted(counted) == sorted({t for t, _ in rows})


def test_other_models_are_refused():
    class Odd:
        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"

    with pytest.raises(ValueError, match="join"):
        T.check_model(Odd())
