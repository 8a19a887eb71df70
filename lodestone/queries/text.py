"""Queries of text functions over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunks import dedupe, kind_counts
from ..operators.dense import HashingEmbedder, Md5Embedder
from ..operators.prompt import context, packed
from ..sources.shared import ready
from .common import collapse_sql, table, tokens_sql


def tokenize_terms(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def language(spark, sf) -> DataFrame:
    docs, items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    of = lambda df, name: df.select(F.lit(name).alias("source"), "id", T.detect_language(F.col("text")).alias("lang"))
    return of(docs, "documents").unionByName(of(items, "benchmark"))


def normalised_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.normalise_key(F.concat("p_name", F.lit(" / ("), "p_type", F.lit(")"))).alias("key"))


def cleaned(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("clean_md5"))


def anchors(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select("p_partkey", T.anchored(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")).when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.lit("")), F.col("p_name")).alias("text"))


def sentence_split(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("sentences_md5"))


def sentence_windows(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("window_no", "w"))
    return rows.select("doc_id", "window_no", F.length("w").alias("n_chars"), F.md5(F.col("w").cast("binary")).alias("window_md5"))


def dedupe_first(spark, sf) -> DataFrame:
    return dedupe(table(spark, sf, "documents"), ord_col="doc_id").select("doc_id", "lang", "source")


def counts_by_kind(spark, sf) -> DataFrame:
    return kind_counts(table(spark, sf, "documents").withColumnRenamed("lang", "kind"))


def refusal(spark, sf) -> DataFrame:
    answers = table(spark, sf, "conversations").filter("role = 'assistant'")
    marked = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" It is Not Listed."))).otherwise(F.col("text"))
    return answers.select("conv_id", "turn", T.is_refusal(marked).alias("refused"))


def keyword_groups(spark, sf) -> DataFrame:
    groups = F.array(F.array(F.lit("the"), F.lit("QUE")), F.array(F.lit("en")))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.keyword_hit(F.col("text"), groups).alias("keyword_ok"))


def grounding(spark, sf) -> DataFrame:
    g = T.number_grounding(F.concat("text", F.lit(" [1] 1,024 and 3.5")), F.concat("text", F.lit(" 1024")))
    return table(spark, sf, "documents").select("doc_id", g.alias("g")).select("doc_id", "g.grounded", "g.total")


def thinking(spark, sf) -> DataFrame:
    turn = F.col("turn") % 3
    told = F.when(turn == 0, F.concat(F.lit("<think>a\nb</think>\n "), "text")).when(turn == 1, F.concat(F.lit("left over</think> "), "text", F.lit(" /no_think "))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.strip_thinking(told).cast("binary")).alias("visible_md5"))


def context_pack(spark, sf) -> DataFrame:
    hits = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text")
    return context(packed(hits, 900)).select("qid", "n_used", F.length("context").alias("context_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def md5_embedding(spark, sf) -> DataFrame:
    """The embeddings' dimensions that are not 0, and each embedding's norm, which is 1 unless a text has no tokens."""
    v = table(spark, sf, "documents").select("doc_id", Md5Embedder(64).encode(F.col("text")).alias("v"))
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6)
    return v.select("doc_id", norm.alias("norm"), F.posexplode("v").alias("dim", "x")).filter("x <> 0").select("doc_id", "norm", "dim", F.round("x", 6).alias("x"))


def hash_embedding(spark, sf) -> DataFrame:
    """The embeddings' dimensions that are not 0."""
    ready(spark)
    v = table(spark, sf, "documents").select("doc_id", HashingEmbedder(512).encode(F.col("text")).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("dim", "x")).filter("x <> 0").select("doc_id", "dim", F.round("x", 6).alias("x"))


S = "regexp_replace({0}, '([。！？；!?;])\\s*', '\\1' || chr(31), 'g')"
SENTENCES = "list_filter(list_transform(string_split(" + S.format(collapse_sql("text")) + ", chr(31)), lambda x: trim(x)), lambda x: x <> '')"
LAST = "list_last(string_split(a, chr(30)))"
PACK = f"list_reduce(ss, lambda a, x: CASE WHEN length({LAST}) + length(x) + 1 > 240 THEN a || chr(30) || trim(right({LAST}, 40) || ' ' || x) ELSE trim(a || ' ' || x) END)"
NUMBERS = "regexp_extract_all(regexp_replace(text || ' [1] 1,024 and 3.5', '\\[\\d+\\]', ' ', 'g'), '\\d+(?:[.,]\\d+)*')"
LANGUAGE = "len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{8c48}-\\x{faff}]'))"
MARKERS = " OR ".join(f"contains(lower(a), '{m}')" for m in T.REFUSAL_MARKERS)
NON_SPACE_ENDS = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    "tokenize_terms": (tokenize_terms, f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)"),
    "detect_language": (
        language,
        f"SELECT source, id, CASE WHEN c > 0 AND c * 2 >= len(regexp_extract_all(text, '[A-Za-z]')) THEN 'zh' ELSE 'en' END AS lang FROM (SELECT *, {LANGUAGE} AS c FROM (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark))",
    ),
    "normalise_key": (normalised_keys, "SELECT p_partkey, lower(regexp_replace(p_name || ' / (' || p_type || ')', '[\\s/()（）]+', '', 'g')) AS key FROM part"),
    "clean_text": (cleaned, f"SELECT doc_id, md5({NON_SPACE_ENDS.format('regexp_replace(replace(text, chr(160), chr(32)), ' + chr(39) + '[ ' + chr(92) + 't' + chr(92) + 'x{3000}]+' + chr(39) + ', chr(32), ' + chr(39) + 'g' + chr(39) + ')')}) AS clean_md5 FROM documents"),
    "anchors": (
        anchors,
        "SELECT p_partkey, CASE WHEN p_size > 25 AND p_type <> p_brand THEN p_brand || ' / ' || p_type || ': ' || p_name ELSE p_brand || ': ' || p_name END AS text FROM part",
    ),
    "sentence_split": (sentence_split, f"SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)"),
    "sentence_windows": (
        sentence_windows,
        f"SELECT doc_id, (i - 1)::INT AS window_no, length(w[i])::INT AS n_chars, md5(w[i]) AS window_md5 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, CASE WHEN length(n) <= 240 THEN [n] ELSE string_split({PACK}, chr(30)) END AS w FROM (SELECT doc_id, {collapse_sql('text')} AS n, {SENTENCES} AS ss FROM documents)))",
    ),
    "dedupe_first": (dedupe_first, f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lower({collapse_sql('text')}) ORDER BY doc_id) = 1"),
    "kind_counts": (counts_by_kind, "SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang"),
    "refusal": (refusal, f"SELECT conv_id, turn, {MARKERS} AS refused FROM (SELECT *, CASE WHEN turn % 3 = 1 THEN text || ' It is Not Listed.' ELSE text END AS a FROM conversations WHERE role = 'assistant')"),
    "keyword_groups": (keyword_groups, "SELECT conv_id, turn, (contains(lower(text), 'the') OR contains(lower(text), 'que')) AND contains(lower(text), 'en') AS keyword_ok FROM conversations"),
    "number_grounding": (grounding, f"SELECT doc_id, len(list_filter(ns, lambda n: contains(c, replace(n, ',', ''))))::INT AS grounded, len(ns)::INT AS total FROM (SELECT doc_id, {NUMBERS} AS ns, replace(text || ' 1024', ',', '') AS c FROM documents)"),
    "strip_thinking": (thinking, f"SELECT conv_id, turn, md5({NON_SPACE_ENDS.format('text')}) AS visible_md5 FROM conversations"),
    "context_pack": (
        context_pack,
        "SELECT qid, count(*) AS n_used, length(string_agg(line, chr(10) ORDER BY rank))::INT AS context_chars, md5(string_agg(line, chr(10) ORDER BY rank)) AS context_md5 FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY qid ORDER BY rank) - 1 AS upto FROM (SELECT conv_id AS qid, turn AS rank, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || text AS line FROM conversations)) WHERE upto <= 900 GROUP BY qid",
    ),
    "hash_embed_norms": (
        md5_embedding,
        f"WITH h AS (SELECT doc_id, md5(t) AS m FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS t FROM documents)), s AS (SELECT doc_id, (('0x' || substr(m, 1, 7))::BIGINT % 64)::INT AS dim, sum(CASE WHEN substr(m, 8, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS x FROM h GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY doc_id) SELECT doc_id, 1.0::DOUBLE AS norm, dim, round(x / norm, 6) AS x FROM s JOIN n USING (doc_id) WHERE x <> 0",
    ),
    "hash_embedding_blake2b": (hash_embedding, None),
}
