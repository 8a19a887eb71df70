"""Queries of evaluation and of generation figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import fusion
from ..operators.generation import REFUSAL, build_generator, stream_stats
from ..plans.retrieval import Answering, sweep
from ..sources.shared import stored
from .common import table, tokens_sql
from .retrieval import DENSE_FUSED, FUSED, SPARSE_FUSED, TOP, bm25_sql, bm25_topk, rescued_sql, retriever


#: Words that items and documents meet on.
MEET_WORDS = 5


def gold(spark, sf) -> DataFrame:
    """(qid, doc_id): the documents labelled as good that hold the item's text, wherever it begins and ends; each pair once.

    All words of an item but the first and the last are whole words of any document that holds it. Documents and items meet on a hash
    of the first five of these, or of all if they are fewer; then the whole text must be there. An item without such words is looked
    for in every document.
    """
    words = F.split("text", r"\s+")
    items = table(spark, sf, "benchmark").filter("text IS NOT NULL").select(F.col("item_id").alias("qid"), F.col("text").alias("item"), words.alias("w"))
    items = items.withColumn("inner", F.slice("w", F.lit(2), F.least(F.greatest(F.size("w") - 2, F.lit(0)), F.lit(MEET_WORDS)))).withColumn("n", F.size("inner"))
    sizes = sorted(r.n for r in items.select("n").distinct().collect())
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text")

    def runs(n: int):
        """Hashes of all runs of n words."""
        hashes = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))
        return F.when(F.size("w") >= n, hashes).otherwise(F.array().cast("array<bigint>"))

    every = F.array_distinct(F.flatten(F.array(*[runs(n) for n in sizes if n]).cast("array<array<bigint>>")))
    keys = items.filter("n > 0").select(F.xxhash64("inner").alias("h"), "qid", "item")
    # Only pairs are shuffled, with the items' texts: labels are asked for these, and documents' texts come back for what is left.
    met = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode(every).alias("h")).join(keys, "h").select("doc_id", "qid", "item").distinct()
    found = docs.join(stored(met.join(good, "doc_id", "left_semi")), "doc_id").filter(F.contains("text", "item")).select("qid", "doc_id")
    if 0 in sizes:
        anywhere = docs.join(items.filter("n = 0"), F.contains("text", "item")).select("qid", "doc_id").distinct()
        found = found.unionByName(anywhere.join(good, "doc_id", "left_semi").select("qid", "doc_id"))
    return found.distinct()


def ranked_hits(spark, sf) -> DataFrame:
    return stored(bm25_topk(spark, sf).select("qid", "rank", F.col("ord").alias("doc_id")))


def recall_mrr(spark, sf) -> DataFrame:
    pairs = stored(gold(spark, sf))
    return E.retrieval_scores(pairs.select("qid").distinct().join(E.first_found(ranked_hits(spark, sf), pairs), "qid", "left"), (1, 3, 5))


def recall_sweep(spark, sf) -> DataFrame:
    pairs, found = stored(gold(spark, sf)), ranked_hits(spark, sf)
    configs = spark.createDataFrame([("narrow", 3), ("wide", TOP)], "config string, top_k int")
    swept = E.sweep(found, configs)
    first = E.first_found(swept, pairs, by=["config"])
    return E.retrieval_scores(pairs.select("qid").distinct().crossJoin(F.broadcast(configs.select("config"))).join(first, ["config", "qid"], "left"), (1, 3), by=["config"])


def mode_sweep(spark, sf) -> DataFrame:
    """Each mode's own hits, scored against the same gold."""
    pairs = stored(gold(spark, sf))
    r, asked = retriever(spark, sf)
    modes = spark.createDataFrame([(m, m, fusion.RRF_K, fusion.POOL, 1.0, 1.0) for m in ("dense", "bm25", "hybrid")], fusion.CONFIGS)
    hits = sweep(r, asked, modes).select("config", "qid", "rank", F.col("ord").alias("doc_id"))
    found = E.first_found(hits, pairs, by=["config"])
    every = pairs.select("qid").distinct().crossJoin(F.broadcast(modes.select("config"))).join(found, ["config", "qid"], "left")
    return E.retrieval_scores(every.withColumnRenamed("config", "mode"), by=["mode"])


def answers(spark, sf) -> DataFrame:
    """Items answered from the context of their lexical hits, by the generator that quotes."""
    r, asked = retriever(spark, sf)
    r.mode = "bm25"
    made = Answering(r, build_generator("extractive"), "Pro 16", 5).answer(asked.select("qid", "text"))
    return made.select("qid", "lang", "n_used", "context_chars", F.md5("answer").alias("answer_md5"))


def latency_medians(spark, sf) -> DataFrame:
    runs = table(spark, sf, "events").select(F.col("user_id").alias("qid"), "event_type", "value")
    per = runs.groupBy("qid", "event_type").agg(F.percentile("value", 0.5).alias("value"))
    return per.groupBy("event_type").agg(E.median_of_nonzero("value").alias("value_median"), F.count(F.lit(1)).alias("n"))


def pieces(spark, sf, request: str = "user_id") -> DataFrame:
    """Events as pieces of a stream: views open a reasoning block, clicks close it, the rest is text."""
    e = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    piece = F.when(F.col("event_type") == "view", "<think>").when(F.col("event_type") == "click", "</think>").when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return e.select(F.expr(request).alias("req_id"), micros.alias("seq"), (micros / 1e6).alias("t"), piece.alias("piece"))


def token_stats(spark, sf) -> DataFrame:
    p = pieces(spark, sf)
    spans = p.groupBy("req_id").agg((F.min("t") - 1).alias("t0"), (F.max("t") + 1).alias("t_end"))
    s = stream_stats(p, spans)
    return s.select("req_id", "n_tokens", "thinking_tokens", *[F.round(c, 3).alias(c) for c in ("ttft_s", "ttft_answer_s", "decode_s", "total_s")], F.round("tps", 9).alias("tps"), F.round("e2e_tps", 9).alias("e2e_tps"))


def question_figures(spark, sf) -> DataFrame:
    """Each user's events as three runs of one question: figures of each run's pieces, and their medians over the runs."""
    p = pieces(spark, sf, "user_id * 3 + event_id % 3")
    spans = p.groupBy("req_id").agg((F.min("t") - 1).alias("t0"), (F.max("t") + 1).alias("t_end"))
    runs = stream_stats(p, spans).withColumn("qid", F.floor(F.col("req_id") / 3))
    medians = E.per_question_medians(runs, ["n_tokens", "thinking_tokens", "ttft_s", "ttft_answer_s", "decode_s"])
    return medians.select("qid", *[F.round(c, 3).alias(c) for c in medians.columns[1:]])


def answer_scores(spark, sf) -> DataFrame:
    """Assistant turns as answers, the turns before them as context; user turns of 1 as negative."""
    c = table(spark, sf, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat("text", F.lit(" 42 [1] 7,000")).alias("answer"))
    asked = c.select("conv_id", "turn", F.concat("text", F.lit(" 7000 ")).alias("context"))
    rows = answers.join(asked, ["conv_id", "turn"]).select(
        F.struct("conv_id", "turn").alias("qid"), F.when(F.col("conv_id") % 5 == 0, "negative").otherwise("fact").alias("type"),
        F.when(F.col("conv_id") % 10 == 0, F.lit("Sorry, no information.")).otherwise(F.col("answer")).alias("answer"), "context", F.array(F.array(F.lit("de"), F.lit("the"))).alias("must_include"),
    )
    return E.generation_scores(E.score_answers(rows))


GOLD = f"""{bm25_sql(TOP)},
gold AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS ord FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1),
qs AS (SELECT DISTINCT qid FROM gold)"""
FIRST = "SELECT q.qid, min(s.rank) AS first FROM qs q LEFT JOIN (SELECT s.* FROM sparse s JOIN gold g USING (qid, ord)) s USING (qid) GROUP BY q.qid"
RATE = "round(avg(CASE WHEN first < {0} THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_at_{0}"
MRR = "round(avg(coalesce(1.0::DOUBLE / (first + 1), 0.0)), 4) AS mrr"
MODES = " UNION ALL ".join(f"SELECT '{mode}' AS mode, qid, ord, rank FROM (WITH {rescued_sql(5, fused)} SELECT qid, ord, rank FROM final)" for mode, fused in (("dense", DENSE_FUSED), ("bm25", SPARSE_FUSED), ("hybrid", FUSED)))
PIECES = """p AS (SELECT user_id AS req_id, epoch_us(ts) AS seq, epoch_us(ts) / 1e6 AS t,
       CASE event_type WHEN 'view' THEN '<think>' WHEN 'click' THEN '</think>' WHEN 'error' THEN '' ELSE event_type END AS piece FROM events),
k AS (SELECT *, max((piece = '<think>')::INT) OVER w AS opened, max((piece = '</think>')::INT) OVER w AS closed, string_agg(piece, '') OVER w AS seen
      FROM p WHERE piece <> '' WINDOW w AS (PARTITION BY req_id ORDER BY seq)),
v AS (SELECT *, opened = 1 AND closed = 0 AS thinking FROM k),
x AS (SELECT *, max(thinking::INT) OVER (PARTITION BY req_id ORDER BY seq) AS thought, regexp_replace(seen, '(?s)<think>.*?</think>\\s*', '', 'g') AS cut FROM v),
y AS (SELECT *, NOT thinking AND (thought = 1 OR opened = 0)
            AND trim(CASE WHEN contains(cut, '</think>') THEN regexp_replace(cut, '(?s)^.*?</think>\\s*', '') ELSE cut END) <> '' AS visible FROM x),
z AS (SELECT *, coalesce(max(visible::INT) OVER (PARTITION BY req_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS answered FROM y),
f AS (SELECT req_id, count(*) AS n, min(t) AS t_first, max(t) AS t_last, min(CASE WHEN visible THEN t END) AS t_answer, sum(CASE WHEN thinking AND answered = 0 THEN 1 ELSE 0 END) AS th FROM z GROUP BY req_id),
spans AS (SELECT req_id, min(t) - 1 AS t0, max(t) + 1 AS t_end FROM p GROUP BY req_id)"""

QUERIES = {
    "recall_mrr": (recall_mrr, f"WITH {GOLD}, f AS ({FIRST}) SELECT count(*) AS n_questions, {RATE.format(1)}, {RATE.format(3)}, {RATE.format(5)}, {MRR} FROM f"),
    "recall_sweep": (
        recall_sweep,
        f"WITH {GOLD}, cfg AS (SELECT * FROM (VALUES ('narrow', 3), ('wide', {TOP})) t(config, top_k)), f AS (SELECT c.config, q.qid, min(s.rank) AS first FROM cfg c CROSS JOIN qs q LEFT JOIN (SELECT s.* FROM sparse s JOIN gold g USING (qid, ord)) s ON s.qid = q.qid AND s.rank < c.top_k GROUP BY ALL) SELECT config, count(*) AS n_questions, {RATE.format(1)}, {RATE.format(3)}, {MRR} FROM f GROUP BY config",
    ),
    "mode_sweep": (
        mode_sweep,
        f"""WITH hits AS ({MODES}), gold AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS ord FROM benchmark b JOIN documents d ON contains(d.text, b.text) JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1),
qs AS (SELECT DISTINCT qid, mode FROM gold, (SELECT unnest(['dense', 'bm25', 'hybrid']) AS mode)), f AS (SELECT q.mode, q.qid, min(h.rank) AS first FROM qs q LEFT JOIN (SELECT * FROM hits JOIN gold USING (qid, ord)) h ON h.qid = q.qid AND h.mode = q.mode GROUP BY ALL)
SELECT mode, count(*) AS n_questions, {RATE.format(1)}, {RATE.format(3)}, {RATE.format(5)}, {MRR} FROM f GROUP BY mode""",
    ),
    "answers": (
        answers,
        f"""WITH {rescued_sql(5, SPARSE_FUSED)},
l AS (SELECT f.qid, f.rank, '[' || row_number() OVER (PARTITION BY f.qid ORDER BY f.rank) || '] ' || d.text AS line FROM final f JOIN documents d ON d.doc_id = f.ord),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY qid ORDER BY rank) - 1 AS upto FROM l),
c AS (SELECT qid, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS context FROM u WHERE upto <= 2400 GROUP BY qid),
a AS (SELECT item_id AS qid, {tokens_sql("text")} AS asked, coalesce(n, 0) AS n_used, coalesce(context, '') AS context FROM benchmark LEFT JOIN c ON c.qid = item_id),
x AS (SELECT qid, asked, unnest(list_filter(string_split(context, chr(10)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(string_split(context, chr(10)), lambda x: x <> ''), 1) AS i FROM a),
y AS (SELECT qid, line, i, len(list_intersect(asked, {tokens_sql("line")})) AS n FROM x),
best AS (SELECT qid, arg_max(line, n * 100000 - i) AS line FROM y WHERE n > 0 GROUP BY qid)
SELECT a.qid, 'en' AS lang, n_used, length(context)::INT AS context_chars, md5(CASE WHEN line IS NULL THEN '{REFUSAL["en"]}' ELSE regexp_replace(line, '^(\\[\\d+\\]) (.*)$', '\\2 \\1') END) AS answer_md5 FROM a LEFT JOIN best USING (qid)""",
    ),
    "latency_medians": (latency_medians, "SELECT event_type, coalesce(round(quantile_cont(CASE WHEN v <> 0 THEN v END, 0.5), 4), 0.0) AS value_median, count(*) AS n FROM (SELECT user_id, event_type, quantile_cont(value, 0.5) AS v FROM events GROUP BY ALL) GROUP BY event_type"),
    "token_stats": (
        token_stats,
        f"""WITH {PIECES} SELECT s.req_id, coalesce(n, 0) AS n_tokens, coalesce(th, 0)::BIGINT AS thinking_tokens, round(coalesce(t_first - t0, 0.0), 3) AS ttft_s,
       round(coalesce(t_answer - t0, t_first - t0, 0.0), 3) AS ttft_answer_s, round(coalesce(t_last - t_first, 0.0), 3) AS decode_s, round(t_end - t0, 3) AS total_s,
       round(CASE WHEN t_last > t_first AND n > 1 THEN (n - 1) / (t_last - t_first) ELSE 0.0 END, 9) AS tps, round(coalesce(n, 0) / (t_end - t0), 9) AS e2e_tps
FROM spans s LEFT JOIN f USING (req_id)""",
    ),
    "question_figures": (
        question_figures,
        f"""WITH {PIECES.replace("user_id AS req_id", "user_id * 3 + event_id % 3 AS req_id")},
r AS (SELECT s.req_id // 3 AS qid, coalesce(n, 0) AS n, coalesce(th, 0) AS th, coalesce(t_first - t0, 0.0) AS ttft, coalesce(t_answer - t0, t_first - t0, 0.0) AS answer, coalesce(t_last - t_first, 0.0) AS decode FROM spans s LEFT JOIN f USING (req_id))
SELECT qid, round(median(n::DOUBLE), 3) AS n_tokens, round(median(th::DOUBLE), 3) AS thinking_tokens, round(median(ttft), 3) AS ttft_s, round(median(answer), 3) AS ttft_answer_s, round(median(decode), 3) AS decode_s FROM r GROUP BY qid""",
    ),
    "generation_scores": (
        answer_scores,
        """WITH r AS (SELECT a.conv_id % 5 = 0 AS negative, CASE WHEN a.conv_id % 10 = 0 THEN 'Sorry, no information.' ELSE a.text || ' 42 [1] 7,000' END AS answer, replace(q.text || ' 7000 ', ',', '') AS c
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'),
s AS (SELECT *, contains(lower(answer), 'de') OR contains(lower(answer), 'the') AS ok, contains(lower(answer), 'no information') AS refused,
        regexp_extract_all(regexp_replace(answer, '\\[\\d+\\]', ' ', 'g'), '\\d+(?:[.,]\\d+)*') AS ns FROM r),
g AS (SELECT *, len(list_filter(ns, lambda n: contains(c, replace(n, ',', '')))) AS good FROM s)
SELECT count(*) AS n_questions, round(avg(CASE WHEN NOT negative THEN ok::INT::DOUBLE END), 4) AS keyword_accuracy, round(avg(CASE WHEN negative THEN refused::INT::DOUBLE END), 4) AS refusal_rate_on_negatives,
       round(avg(CASE WHEN NOT negative THEN refused::INT::DOUBLE END), 4) AS false_refusal_rate, round(sum(good) FILTER (NOT negative)::DOUBLE / sum(len(ns)) FILTER (NOT negative), 4) AS number_grounding FROM g""",
    ),
}
