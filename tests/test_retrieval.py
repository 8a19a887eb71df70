import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate as E
from lodestone.operators import fusion
from lodestone.operators.dense import HashingEmbedder, ModelEmbedder, build_embedder, cosine_search
from lodestone.operators.generation import ExtractiveGenerator, sse_pieces, stream_stats
from lodestone.operators.lexical import bm25_search, build_index
from lodestone.operators.prompt import build_plain_prompts, build_prompts, context, packed, with_thinking_switch
from lodestone.plans.retrieval import Answering, Retriever, evaluate_generation, evaluate_retrieval, in_memory_retriever, load_retriever
from lodestone.sources.tables import check_index, load_index, read_corpus, read_questions, save_index, write_corpus
from lodestone.streaming.ingest import ingest, read_documents

CHUNKS = [
    (0, "c0", "fact.display", "fact", "螢幕更新率 / Display refresh rate: 240Hz", "螢幕更新率", "Display refresh rate"),
    (1, "c1", "fact.battery", "fact", "電池容量 / Battery capacity: 99Wh", "電池容量", "Battery capacity"),
    (2, "c2", "spec.weight", "spec_row", "重量 / Weight: 2.5 kg", "重量", "Weight"),
]


def chunks(spark, data=CHUNKS):
    df = spark.createDataFrame(data, "ord bigint, chunk_id string, doc_id string, kind string, text string, key_zh string, key_en string")
    return df.withColumns({"lang": F.lit("bi"), "source": F.lit(""), "meta": F.create_map().cast("map<string,string>")})


def queries(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, text string")


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "a b b"), (1, "b c"), (2, "")], "ord bigint, text string")
    got = {r.ord: r.score for r in bm25_search(build_index(docs), queries(spark, "b b z")).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5)), 5 / 3
    want = {o: round(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avg)), 6) for o, f, n in ((0, 2, 3), (1, 1, 2))}
    assert got == want
    assert bm25_search(build_index(docs), queries(spark, "z")).count() == 0


def test_bm25_in_blocks(spark, monkeypatch):
    """However the queries' terms are split, and however documents are dealt, the hits are the same; and nothing is shuffled
    by query and document.
    """
    from lodestone.operators import lexical

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(80)], "ord bigint, text string")
    asked = queries(spark, *(f"w{i} w{i + 1} w{(i * 7) % 13} the" for i in range(25)), "", "nothing")
    want = sorted(map(tuple, bm25_search(build_index(docs), asked, 5).collect()))
    assert len(want) == 25 * 5
    plan = bm25_search(build_index(docs), asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ord#" in plan and not re.search(r"hashpartitioning\(qid#\w+, ord#", plan)
    monkeypatch.setattr(lexical, "TERM_ROWS", 20)
    assert sorted(map(tuple, bm25_search(build_index(docs.repartition(7)), asked, 5).collect())) == want


def test_bm25_adds_up_in_bounded_parts(spark, monkeypatch):
    """Pairs of query and document make no rows of Spark, and batches that cut a document in two change nothing."""
    from lodestone.operators import lexical

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(80)], "ord bigint, text string")
    asked = queries(spark, *(f"w{i} w{i + 1} w{(i * 7) % 13}" for i in range(25)))
    index = build_index(docs)
    want = sorted(map(tuple, bm25_search(index, asked, 5).collect()))
    plan = bm25_search(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "sum(" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(lexical, "SUMS", 30)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, bm25_search(index, asked, 5).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cosine_batch_is_single(spark):
    v = spark.createDataFrame([(i, [math.sin(i * k + 1) for k in range(8)]) for i in range(20)], "ord bigint, v array<double>")
    q = spark.createDataFrame([(str(i), [math.cos(i + k) for k in range(8)]) for i in range(3)], "qid string, v array<double>")
    both = {(r.qid, r["rank"]): r.ord for r in cosine_search(v, q, 5).collect()}
    for i in range(3):
        one = {(r.qid, r["rank"]): r.ord for r in cosine_search(v.repartition(5), q.filter(F.col("qid") == str(i)), 5).collect()}
        assert one == {k: o for k, o in both.items() if k[0] == str(i)}
    zero = spark.createDataFrame([(0, [0.0] * 8)], "ord bigint, v array<double>")
    assert cosine_search(zero, q, 1).first().score == 0


def test_cosine_in_blocks_of_queries(spark, monkeypatch):
    """More queries than a block: products of matrices give what the JVM gives, ties and all."""
    from lodestone.operators import dense

    v = spark.createDataFrame([(i, [float((i * k) % 5) for k in range(6)]) for i in range(40)] + [(99, [0.0] * 6)], "ord bigint, v array<double>").repartition(4)
    q = spark.createDataFrame([(str(i), [float((i + k) % 4) for k in range(6)]) for i in range(30)], "qid string, v array<double>")
    whole = sorted(map(tuple, cosine_search(v, q, 7).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 8)
    assert sorted(map(tuple, cosine_search(v, q, 7).collect())) == whole and len(whole) == 30 * 7


def ranking(spark, *rows):
    return spark.createDataFrame([("q", o, float(s), r) for r, (o, s) in enumerate(rows)], "qid string, ord bigint, score double, rank int")


def result(df):
    return [(r.ord, round(r.score, 6)) for r in df.orderBy("rank").collect()]


def test_rrf_prefers_consensus(spark):
    arms = fusion.arms_of(ranking(spark, (1, 0.9), (2, 0.8)), ranking(spark, (2, 9.0), (3, 8.0)))
    got = {r.ord: (r.score, r.first_seen.arm) for r in fusion.rrf_fuse(arms).collect()}
    assert got == {1: (round(1 / 61, 9), 0), 2: (round(1 / 62 + 1 / 61, 9), 0), 3: (round(1 / 62, 9), 1)}
    weighted = {r.ord: r.score for r in fusion.rrf_fuse(arms, weights=[2.0, 1.0]).collect()}
    assert weighted[1] == round(2 / 61, 9)


def selected(spark, *rows):
    return ranking(spark, *rows)


def test_rescue_quirks(spark):
    dense, sparse = ranking(spark, (7, 0.9)), ranking(spark, (7, 5.0))
    # Both arms miss the same hit: two places are freed, one is filled.
    got = result(fusion.rescue(selected(spark, (1, 0.5), (2, 0.4), (3, 0.3)), fusion.arms_of(dense, sparse), 3))
    assert got == [(1, 0.5), (7, round(0.3 * 0.99, 6))]
    # With one place, the other arm's first hit takes it.
    got = result(fusion.rescue(selected(spark, (7, 0.5)), fusion.arms_of(dense, ranking(spark, (8, 5.0))), 1))
    assert got == [(8, 0.495)]
    # Truncation can put out the other arm's first hit.
    got = result(fusion.rescue(selected(spark, (1, 0.5), (7, 0.4)), fusion.arms_of(dense, ranking(spark, (8, 5.0))), 2))
    assert got == [(1, 0.5), (8, 0.396)]
    # Nothing is missing.
    assert result(fusion.rescue(selected(spark, (7, 0.5)), fusion.arms_of(dense, sparse), 1)) == [(7, 0.5)]


def test_cap_ties_and_zero(spark):
    many = [(i, f"c{i}", "same", "fact" if i == 3 else "feature", "battery", "", "") for i in range(5)]
    scored = fusion.fuse(fusion.arms_of(ranking(spark, *[(i, 1.0) for i in range(5)]), ranking(spark)), "dense")
    got = result(fusion.diversify(scored, chunks(spark, many), 4))
    assert got == [(3, 1.0), (0, 1.0)]
    assert len(result(fusion.diversify(scored, chunks(spark, many), 0))) == 1


def test_key_boost_guards(spark):
    c = chunks(spark, [(0, "", "", "fact", "", "重", ""), (1, "", "", "fact", "", "", "ab"), (2, "", "", "fact", "", "重量", ""), (3, "", "", "fact", "", "", "I/O Port"), (4, "", "", "fact", "", "", "")])
    fused = fusion.fuse(fusion.arms_of(ranking(spark, *[(i, 1.0) for i in range(5)]), ranking(spark)), "dense")
    asked = spark.createDataFrame([("q", "重量 ab ioport")], "qid string, text string")
    assert {r.ord: r.score for r in fusion.key_boost(fused, asked, c).collect()} == {0: 1.0, 1: 1.0, 2: 1.35, 3: 1.35, 4: 1.0}


def test_hybrid_bilingual_and_modes(spark):
    r = in_memory_retriever(chunks(spark), HashingEmbedder(256))
    hits = r.search(queries(spark, "電池容量是多少", "display refresh rate?"), 2).collect()
    assert {h.qid: h.ord for h in hits if h["rank"] == 0} == {"0": 1, "1": 0}
    with pytest.raises(ValueError):
        fusion.fuse(r.arms(queries(spark, "x")), "other")
    told = []
    lexical = load_retriever(chunks(spark), on_degrade=told.append)
    assert told and lexical.mode == "bm25"
    assert lexical.search(queries(spark, "weight"), 1).first().ord == 2
    no_vectors = Retriever(chunks(spark), build_index(chunks(spark)))  # hybrid without dense results: BM25's scores
    assert no_vectors.search(queries(spark, "weight"), 1).first().score == lexical.search(queries(spark, "weight"), 1).first().score


def test_index_round_trip(spark, tmp_path):
    e = HashingEmbedder(16)
    from lodestone.operators.dense import embed_corpus

    v = embed_corpus(chunks(spark), e)
    save_index(v, str(tmp_path / "i"), e.name, e.dim)
    back = load_index(spark, str(tmp_path / "i"), "hash")
    check_index(back, chunks(spark))
    with pytest.raises(ValueError, match="build it again"):
        load_index(spark, str(tmp_path / "i"), "other")
    with pytest.raises(ValueError, match="don't match"):
        check_index(back.filter("ord > 0"), chunks(spark))
    with pytest.raises(KeyError):
        build_embedder("nothing")


def test_model_embedder_averages_tokens(spark):
    e = ModelEmbedder("m", 2, lambda: lambda texts: [[[3.0, 0.0], [3.0, 8.0]] for _ in texts], query_prefix="q: ")
    v = spark.createDataFrame([("a",)], "t string").select(e.encode(F.col("t"), True).alias("v")).first().v
    assert v == pytest.approx([0.6, 0.8])


def test_registries(spark):
    from lodestone.operators import dense, generation

    dense.register_embedder("Toy", 2, lambda: lambda texts: [[len(t), 1.0] for t in texts], query_prefix="q: ")
    row = spark.createDataFrame([("a",)], "t string").select(build_embedder("toy").encode(F.col("t")).alias("p"), build_embedder("TOY").encode(F.col("t"), True).alias("q"), generation.count_tokens(F.col("t"), lambda: len).alias("n")).first()
    assert row.p == pytest.approx([0.5**0.5] * 2) and row.q[0] == pytest.approx(4 / 17**0.5) and row.n == 1
    generation.register_generator("short", lambda **options: ExtractiveGenerator(**options))
    assert generation.build_generator("short", max_tokens=3).max_tokens == 3
    with pytest.raises(KeyError):
        generation.build_generator("nothing")


def test_a_server_is_asked_by_the_workers(spark):
    import http.server
    import json
    import threading

    from lodestone.operators.generation import ServerGenerator

    class Chat(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            for piece in ("<think>hm", "</think>", asked["messages"][-1]["content"].upper(), f" {asked['max_tokens']}"):
                self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': piece}}]})}\n\n".encode())
            self.wfile.write(b": ping\n\ndata: broken\n\ndata: {}\n\ndata: [DONE]\n\ndata: {\"choices\":[{\"delta\":{\"content\":\"late\"}}]}\n\n")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        g = ServerGenerator("m", f"http://127.0.0.1:{server.server_port}/v1/chat/completions", max_tokens=7)
        prompts = build_plain_prompts(queries(spark, "one", "two"), {"zh": "z", "en": "e"})
        assert sorted(r.answer for r in g.answer(prompts).collect()) == ["<think>hm</think>ONE 7", "<think>hm</think>TWO 7"]
        pieces = g.pieces(prompts).cache()
        got = stream_stats(pieces, pieces.select("req_id", "t0", "t_end").distinct()).collect()
        assert [(r.n_tokens, r.thinking_tokens) for r in got] == [(4, 1)] * 2 and all(0 < r.ttft_s <= r.ttft_answer_s <= r.total_s for r in got)
    finally:
        server.shutdown()


def test_corpus_and_questions(spark, tmp_path):
    write_corpus(chunks(spark), str(tmp_path / "c"))
    assert read_corpus(spark, str(tmp_path / "c")).orderBy("ord").first().text == CHUNKS[0][4]
    (tmp_path / "q.jsonl").write_text('{"id": "a", "question": "電池", "lang": "zh", "type": "fact", "gold_docs": ["fact.battery"], "must_include": ["99Wh", ["L", "左"]]}\n\n{"id": "b", "question": "?", "lang": "en", "type": "negative", "must_refuse": true}\n', encoding="utf-8")
    a, b = read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("qid").collect()
    assert a.must_include == [["99Wh"], ["L", "左"]] and a.gold_docs == ["fact.battery"]
    assert b.must_include == [] and b.gold_docs == [] and b.must_refuse


def test_context_budget(spark):
    hits = spark.createDataFrame([("q", 0, "aaaa"), ("q", 1, "bbbb"), ("q", 2, "c"), ("r", 0, "d" * 40)], "qid string, rank int, text string")
    got = {r.qid: r.context for r in context(packed(hits, 17)).collect()}
    assert got == {"q": "[1] aaaa\n[2] bbbb"}  # 8 + 1 + 8
    prompts = {r.qid: r for r in build_prompts(queries(spark, "x").withColumn("qid", F.lit("r")), hits, {"zh": "z", "en": "e"}, 17).collect()}
    assert prompts["r"].user == "Reference:\n\n\nQuestion:x" and prompts["r"].n_used == 0
    switched = spark.createDataFrame([("s",)], "t string").select(with_thinking_switch(F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))), "/no_think").alias("m")).first().m
    assert [(m.role, m.content) for m in switched] == [("system", "/no_think"), ("user", "s")]


def test_stream_stats(spark):
    rows = [("a", 0, 1.0, ""), ("a", 1, 2.0, "<think>"), ("a", 2, 3.0, "hm"), ("a", 3, 4.0, "</think>"), ("a", 4, 5.0, " "), ("a", 5, 7.0, "yes"), ("b", 0, 1.5, "<"), ("b", 1, 2.0, "think>"), ("c", 0, 1.0, "<think>x</think>"), ("c", 1, 2.0, "y")]
    pieces = spark.createDataFrame(rows, "req_id string, seq int, t double, piece string")
    starts = spark.createDataFrame([(r, 0.0, 10.0) for r in "abcd"], "req_id string, t0 double, t_end double")
    got = {r.req_id: r for r in stream_stats(pieces, starts).collect()}
    a = got["a"]
    assert (a.n_tokens, a.thinking_tokens, a.ttft_s, a.ttft_answer_s, a.decode_s, a.tps, a.e2e_tps) == (5, 2, 2.0, 7.0, 5.0, 0.8, 0.5)
    assert got["b"].ttft_answer_s == 1.5  # a tag in two pieces counts as an answer
    assert got["c"].ttft_answer_s == 1.0  # a whole block in one piece leaves it unset: the first piece stands in
    assert (got["d"].n_tokens, got["d"].tps) == (0, 0.0)


def plain_stats(pieces):
    """n, time of the first piece that a reader sees, and pieces of thinking, from all that was said up to each piece."""
    import re

    seen, thought, answer, thinking, n = "", False, None, 0, 0
    for t, piece in pieces:
        if not piece:
            continue
        n += 1
        seen += piece
        now = "<think>" in seen and "</think>" not in seen
        thought |= now
        thinking += now and answer is None
        text = re.sub(r"(?s)<think>.*?</think>\s*", "", seen)
        if "</think>" in text:
            text = re.sub(r"(?s)\A.*?</think>\s*", "", text)
        text = re.sub(r"\s*/no_(?:think|output)\b\s*", " ", text).strip()
        if answer is None and not now and (thought or "<think>" not in seen) and text:
            answer = t
    return n, answer, thinking


def test_stream_stats_against_all_prefixes(spark):
    import random

    rng = random.Random(3)
    parts = ["<think>", "</think>", "<thi", "nk>", "</th", "ink>", " ", "\n", "word", "", "/no_think", "a b", "<think>x</think>", "y</think> z"]
    streams = {r: [(float(k), rng.choice(parts)) for k in range(rng.randint(1, 12))] for r in range(400)}
    rows = [(r, k, t, p) for r, s in streams.items() for k, (t, p) in enumerate(s)]
    starts = spark.createDataFrame([(r, 0.0, 99.0) for r in streams], "req_id int, t0 double, t_end double")
    got = {x.req_id: x for x in stream_stats(spark.createDataFrame(rows, "req_id int, seq int, t double, piece string").repartition(5), starts).collect()}
    for r, s in streams.items():
        n, answer, thinking = plain_stats(s)
        first = next((t for t, p in s if p), 0.0)
        assert (got[r].n_tokens, got[r].thinking_tokens, got[r].ttft_answer_s) == (n, thinking, answer if answer is not None else first), s


def test_reader_sees_no_reasoning():
    from lodestone.operators.generation import shown_to_reader

    say = lambda *pieces: list(shown_to_reader(pieces))
    assert say("Hello", " <b>", "you") == ["Hello", " <b>", "you"]
    assert say(" ", "<thi", "nk>hm", "m</think>\n ", "Yes", " no") == ["Yes", " no"]
    assert say("<think>a</think> b", "c") == ["b", "c"]
    assert say("<think>", "never ends") == [] and say() == [] and say("<") == ["<"]


def test_sse(spark):
    lines = ['data: {"choices":[{"delta":{"content":"Hi"}}]}', ": ping", "data: broken", 'data: {"choices":[{"delta":{}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    df = spark.createDataFrame([("r", i, float(i), x) for i, x in enumerate(lines)], "req_id string, seq int, t double, line string")
    assert [(r.seq, r.piece) for r in sse_pieces(df).collect()] == [(0, "Hi")]


def test_evaluation(spark):
    q = spark.createDataFrame([("a", "battery capacity", "en", "fact", ["fact.battery"], [["99wh"]]), ("b", "nothing at all", "en", "negative", [], []), ("c", "zzz", "en", "fact", ["none"], [["x"]])], "qid string, text string, lang string, type string, gold_docs array<string>, must_include array<array<string>>")
    r = in_memory_retriever(chunks(spark), HashingEmbedder(256), "bm25")
    got = evaluate_retrieval(r, q).first()
    assert (got.n_questions, got.recall_at_1, got.recall_at_5, got.mrr) == (2, 0.5, 0.5, 0.5)
    scores = evaluate_generation(Answering(r, ExtractiveGenerator(), "Pro 16"), q).first()
    assert (scores.keyword_accuracy, scores.refusal_rate_on_negatives, scores.false_refusal_rate, scores.number_grounding) == (0.5, 1.0, 0.5, 1.0)
    none = E.generation_scores(E.score_answers(spark.createDataFrame([], "qid string, type string, answer string, context string, must_include array<array<string>>"))).first()
    assert (none.n_questions, none.keyword_accuracy, none.number_grounding) == (0, 0.0, 1.0)


def test_streaming_ingest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string").write.parquet(src)
    ingest(read_documents(spark, src, "doc_id int, text string"), lambda d: d.withColumn("n", F.length("text")), out, str(tmp_path / "ck"), "doc_id").awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "cc")], "doc_id int, text string").write.mode("append").parquet(src)
    ingest(read_documents(spark, src, "doc_id int, text string"), lambda d: d.withColumn("n", F.length("text")), out, str(tmp_path / "ck"), "doc_id").awaitTermination()
    assert sorted((r.doc_id, r.n) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_the_corpus_is_read_once_for_its_candidates(spark):
    """Boost, order, cap and hits work on the chunks that the arms name, a stored table; the corpus itself isn't in their plan."""
    corpus = chunks(spark)
    arms = spark.createDataFrame([("q", 1), ("r", 1)], "qid string, ord bigint")
    kept = Retriever(corpus, None).candidates(arms)
    assert [r.ord for r in kept.collect()] == [1] and kept.columns == corpus.columns and hasattr(kept, "stored_at")
