import json
import random
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.operators.answers import KeptAnswers, Patience
from lodestone.operators.dense import HashingEmbedder
from lodestone.operators.generation import ExtractiveGenerator, ModelGenerator, ServerGenerator
from lodestone.plans.retrieval import Answering, evaluate_generation, evaluate_retrieval, generation_rows, in_memory_retriever, retrieval_rows

QUESTIONS = "qid string, text string, lang string, type string, gold_docs array<string>, must_include array<array<string>>"


class Chat:
    """A chat server: it says the question's last word, after the seconds that the question names; every so many-th request fails."""

    def __init__(self, fail_every=0):
        self.asked, self.n, self.now, self.most, self.lock = Counter(), 0, 0, 0, threading.Lock()
        chat = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                text = body["messages"][-1]["content"]
                with chat.lock:
                    chat.n += 1
                    chat.now += 1
                    chat.most = max(chat.most, chat.now)
                    number = chat.n
                    chat.asked[text] += 1
                try:
                    if fail_every and number % fail_every == 0:
                        self.send_response(503)
                        self.end_headers()
                        return
                    words = text.split()
                    wait = next((float(w[1:]) for w in words if w.startswith("@")), 0.0)
                    self.send_response(200)
                    self.end_headers()
                    for piece in ("<think>", "hm", "</think>", words[-1]):
                        time.sleep(wait / 4)
                        self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': piece}}]})}\n\n".encode())
                        self.wfile.flush()
                    self.wfile.write(b"data: [DONE]\n\n")
                finally:
                    with chat.lock:
                        chat.now -= 1

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1/chat/completions"


@pytest.fixture
def chat(request):
    c = Chat(getattr(request, "param", 0))
    yield c
    c.server.shutdown()


def prompts(spark, texts):
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, text string").withColumn("messages", message).repartition(4)


@pytest.mark.parametrize("chat", [3], indirect=True)
def test_a_server_that_fails_now_and_then(spark, chat, tmp_path):
    """Every third request fails: all prompts are answered, some requests at once, and what is kept is never asked again."""
    texts = [f"say w{i}" for i in range(60)]
    g = ServerGenerator("m", chat.url, patience=Patience(at_once=4, attempts=6, pause=0.01)).kept(str(tmp_path / "a"), per_task=10)
    got = {r.text: r.answer for r in g.answer(prompts(spark, texts)).collect()}
    assert got == {t: f"<think>hm</think>{t.split()[-1]}" for t in texts}
    assert chat.most <= 4 * 4
    before = chat.n
    more = g.answer(prompts(spark, [*texts, *texts[:5], "say new"]))
    assert more.count() == 66 and chat.n - before <= 2 and sum(chat.asked[t] for t in texts) == before
    with_server = {r.answer for r in ServerGenerator("m", chat.url, patience=Patience(3, 6, 0.01)).answer(prompts(spark, texts[:6])).collect()}
    assert with_server == {f"<think>hm</think>w{i}" for i in range(6)}


@pytest.mark.parametrize("chat", [2], indirect=True)
def test_what_was_answered_stays(spark, chat, tmp_path):
    """With no second attempts half are left: the error says so, and the next run asks only for these."""
    g = ServerGenerator("m", chat.url, patience=Patience(at_once=2, attempts=1)).kept(str(tmp_path / "a"), per_task=10)
    asked = prompts(spark, [f"say w{i}" for i in range(40)])
    with pytest.raises(RuntimeError, match="20 prompts have no answer yet"):
        g.answer(asked)
    kept = {r.digest for r in g.kept(spark).collect()}
    with pytest.raises(RuntimeError, match="10 prompts"):
        g.answer(asked)
    assert len(kept) == 20 and kept < {r.digest for r in g.kept(spark).collect()} and chat.n == 60
    while g.ask(asked):
        pass
    assert g.answer(asked).filter("answer IS NULL").count() == 0 and max(chat.asked.values()) <= 7


def test_a_lost_task_takes_only_its_own_along(spark, tmp_path):
    """A worker that dies on one prompt fails the job; the answers of the tasks that had ended are kept."""

    def load(poisoned):
        def make():
            def ask(messages):
                if poisoned and messages[-1]["content"] == "w7":
                    time.sleep(3)
                    raise RuntimeError("lost")
                return ["<", messages[-1]["content"], ">"]

            return ask

        return make

    asked = prompts(spark, [f"w{i}" for i in range(40)])
    path = str(tmp_path / "a")
    with pytest.raises(Exception, match="lost"):
        KeptAnswers("m", load(True), path, per_task=5).answer(asked)
    kept = KeptAnswers("m", load(False), path, per_task=5).kept(spark).count()
    assert 5 <= kept <= 39
    again = KeptAnswers("m", load(False), path, per_task=5)
    assert {r.answer for r in again.answer(asked).collect()} == {f"<w{i}>" for i in range(40)}
    # Another model's answers, or those by other options, are others.
    assert KeptAnswers("other", load(False), path).digest(F.col("messages")) is not None
    assert KeptAnswers("m", load(False), path, {"temperature": 1}).ask(asked) == 0 and again.kept(spark).count() == 80


def corpus(spark):
    rows = [(0, "fact.a", "fact", "alpha beta"), (1, "fact.b", "fact", "gamma delta"), (2, "fact.c", "fact", "epsilon zeta")]
    return spark.createDataFrame([(o, f"c{o}", d, k, t, "", "", "en", "") for o, d, k, t in rows], "ord bigint, chunk_id string, doc_id string, kind string, text string, key_zh string, key_en string, lang string, source string")


def questions(spark, texts):
    return spark.createDataFrame([(f"q{i}", t, "en", "fact", [f"fact.{'abc'[i % 3]}"], [["w"]]) for i, t in enumerate(texts)], QUESTIONS)


def test_the_medians_are_those_of_the_requests(spark, chat):
    """Questions whose answers take 0.2, 0.8 and 2 seconds: their own rows say so, and the median is the second's."""
    waits = [0.2, 0.8, 2.0]
    asked = questions(spark, [f"alpha gamma epsilon @{w} w{i}" for i, w in enumerate(waits)])
    answering = Answering(in_memory_retriever(corpus(spark), HashingEmbedder(64), "bm25"), ServerGenerator("m", chat.url, patience=Patience(at_once=8)), "Pro")
    rows = {r.qid: r for r in generation_rows(answering, asked, repeats=3, warmup=True).collect()}
    for i, w in enumerate(waits):
        r = rows[f"q{i}"]
        assert r.answer_s == pytest.approx(w, abs=0.25) and r.ttft_s == pytest.approx(w / 4, abs=0.2) and r.ttft_answer_s == pytest.approx(w, abs=0.25)
        assert (r.visible, r.answer, r.thinking_tokens, r.prompt_tokens > 5) == (f"w{i}", f"<think>hm</think>w{i}", 2.0, True)
        assert 0 < r.retrieval_ms < 500
    scores = evaluate_generation(answering, asked, repeats=3).first()
    assert scores.answer_s_median == pytest.approx(0.8, abs=0.25) and scores.keyword_accuracy == 1.0 and scores.tps_median > 0
    plain = evaluate_generation(answering, asked, use_context=False).first()
    assert plain.retrieval_ms_median == 0.0 and plain.context_chars_median == 0.0 and plain.answer_s_median == pytest.approx(0.8, abs=0.25)


def test_retrieval_rows(spark):
    retriever = in_memory_retriever(corpus(spark), HashingEmbedder(64), "hybrid")
    asked = questions(spark, ["alpha", "gamma", "nothing"])
    rows = {r.qid: r for r in retrieval_rows(retriever, asked).collect()}
    assert (rows["q0"]["first"], rows["q0"].retrieved[0]) == (0, "fact.a") and set(rows) == {"q0", "q1", "q2"}
    assert all(0 <= r.retrieval_s < 1 for r in rows.values()) and any(r.retrieval_s > 0 for r in rows.values())
    scores = evaluate_retrieval(retriever, asked).first()
    assert scores.n_questions == 3 and scores.recall_at_5 >= 0.6667 and scores.latency_ms_median >= 0


def test_generators_that_have_pieces_say_the_same(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "電池", "容量", "x-1"]
    lines = lambda: "\n".join(f"[{k}] {' '.join(rng.choices(words, k=4))}" for k in range(1, 5))
    rows = [(f"q{i}", " ".join(rng.choices([*words, "other"], k=2)), rng.choice(["en", "zh"]), rng.choice([lines(), "", lines() + "\n\nno number here"])) for i in range(60)]
    asked = spark.createDataFrame(rows, "qid string, question string, lang string, context string")
    for most in (None, 3):
        g = ExtractiveGenerator(most)
        want = {r.qid: r.answer for r in g.answer(asked).collect()}
        assert {r.req_id: r.piece for r in g.pieces(asked).collect()} == want
    model = ModelGenerator("m", lambda: lambda messages: messages[-1]["content"].upper())
    got = model.pieces(prompts(spark, ["a", "b"])).collect()
    assert {r.piece for r in got} == {"A", "B"} and all(r.t0 <= r.t <= r.t_end for r in got)
