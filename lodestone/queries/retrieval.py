"""Queries of retrieval: all benchmark items against all documents, vectors whose id is divisible by 50 against all."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators.dense import cosine_search
from ..operators import lexical as L
from ..operators.lexical import build_index
from ..operators.pivots import PivotIndex
from ..operators.segments import SegmentIndex
from ..plans.retrieval import Retriever, load_retriever
from ..sources.shared import hadoop, shared_dir, stored
from .common import table, tokens_sql

TOP, POOL = 10, 25


def corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")


def questions(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def term_df_topk(spark, sf) -> DataFrame:
    """The 20 most frequent terms: a report."""
    return build_index(corpus(spark, sf)).term_df.orderBy(F.desc("df"), "term").limit(20)


def corpus_stats(spark, sf) -> DataFrame:
    return L.corpus_stats(corpus(spark, sf)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def kept_index(spark, sf) -> SegmentIndex:
    """The lexical index of the folder's documents, kept in the shared folder for as long as their files are the same."""
    docs = corpus(spark, sf)
    where, files = hadoop(spark, f"{sf}/documents.parquet")
    listed, found = files.listFiles(where, True), []
    while listed.hasNext():
        status = listed.next()
        found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    key = hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/lodestone-lexical-{key}"
    return SegmentIndex.open(spark, path) if SegmentIndex.exists(spark, path) else SegmentIndex.create(spark, path, docs)


def bm25_topk(spark, sf) -> DataFrame:
    return kept_index(spark, sf).search(questions(spark, sf), TOP)


def bm25_whole(spark, sf) -> DataFrame:
    """The same by scoring every posting of every question."""
    return build_index(corpus(spark, sf)).search(questions(spark, sf), TOP)


def index_changes(spark, sf) -> DataFrame:
    """An index that was changed: other languages first, then English with the texts of one source lost, these put back in their
    documents' place, another source's documents deleted, all merged, and that source's appended and deleted again.
    """
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text", "lang", "source")
    lost = F.when(F.col("source") == "src1", "").otherwise(F.col("text"))
    index = SegmentIndex.temporary(docs.filter("lang <> 'en'"))
    index = index.append(docs.filter("lang = 'en'").withColumn("text", lost))
    index = index.replace(docs.filter("lang = 'en' AND source = 'src1'"))
    gone = docs.filter("source = 'src0'")
    index = index.delete(gone).merged().append(gone).delete(gone)
    return index.search(questions(spark, sf), TOP)


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"))


def cosine_topk(spark, sf) -> DataFrame:
    rows = vectors(spark, sf)
    return cosine_search(rows, rows.filter("ord % 50 = 0").select(F.col("ord").alias("qid"), "v"), TOP)


def cosine_pivots(spark, sf) -> DataFrame:
    """The same search over an index that skips what is too far."""
    rows = vectors(spark, sf)
    return PivotIndex.temporary(rows).search(rows.filter("ord % 50 = 0").select(F.col("ord").alias("qid"), "v"), TOP)


def chunks(spark, sf) -> DataFrame:
    """Documents as chunks: the source is the document of the per-document cap, the first word the key."""
    kind = F.when(F.col("lang") == "en", "fact").when(F.col("lang") == "fr", "spec_line").when(F.col("lang") == "de", "spec_row").otherwise("feature")
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.col("source").alias("doc_id"), kind.alias("kind"), "text", F.lit("").alias("key_zh"), F.split("text", " ")[0].alias("key_en"))


def retriever(spark, sf) -> tuple[Retriever, DataFrame]:
    """Vectors and documents, and items and vectors, are paired by their ids."""
    c, v = chunks(spark, sf), vectors(spark, sf)
    asked = questions(spark, sf).join(v.select(F.col("ord").alias("qid"), "v"), "qid", "left")
    own = v.join(c.select("ord"), "ord", "left_semi")
    return Retriever(c, kept_index(spark, sf), own), asked


def arms(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, asked = retriever(spark, sf)
    dense = cosine_search(r.vectors, asked.filter("v IS NOT NULL").select("qid", "v"), POOL)
    return stored(fusion.arms_of(dense, r.lexical.search(asked, POOL))), r.chunks, asked


def rrf(spark, sf) -> DataFrame:
    a, _, _ = arms(spark, sf)
    return fusion.rrf_fuse(a).select("qid", "ord", "score", F.col("first_seen.arm").alias("arm"), F.col("first_seen.rank").cast("int").alias("rank"))


def boosted(spark, sf) -> DataFrame:
    a, c, asked = arms(spark, sf)
    return fusion.key_boost(fusion.rrf_fuse(a), asked, c).select("qid", "ord", "score")


def diversified(spark, sf) -> DataFrame:
    a, c, asked = arms(spark, sf)
    return fusion.diversify(fusion.key_boost(fusion.rrf_fuse(a), asked, c), c, TOP)


def rescued(spark, sf) -> DataFrame:
    a, c, asked = arms(spark, sf)
    return fusion.rescue(fusion.diversify(fusion.key_boost(fusion.rrf_fuse(a), asked, c), c, 3), a, 3)


def hybrid(spark, sf) -> DataFrame:
    a, c, asked = arms(spark, sf)
    selected = fusion.rescue(fusion.diversify(fusion.key_boost(fusion.fuse(a), asked, c), c, 5), a, 5)
    found = fusion.hits(selected, a, c)
    return found.select("qid", "rank", "ord", "score", "rescued", "dense_rank", "bm25_rank", "doc_id", "kind")


def bm25_mode(spark, sf) -> DataFrame:
    """Single-arm search: BM25's own scores through boost, order, cap and rescue."""
    r, asked = retriever(spark, sf)
    r.mode = "bm25"
    return r.search(asked.select("qid", "text"), 5).select("qid", "rank", "ord", "score", "bm25_rank")


def dense_mode(spark, sf) -> DataFrame:
    """Single-arm search: the cosines themselves through boost, order, cap and rescue."""
    r, asked = retriever(spark, sf)
    r.mode = "dense"
    return r.search(asked, 5).select("qid", "rank", "ord", "score", "dense_rank")


def degraded(spark, sf) -> DataFrame:
    """Without an embedder a hybrid retriever is loaded as a lexical one."""
    said: list[str] = []
    r = load_retriever(chunks(spark, sf), mode="hybrid", on_degrade=said.append)
    if len(said) != 1:
        raise ValueError("nobody was told")
    return r.search(questions(spark, sf), 5).select("qid", "rank", "ord", "score", "bm25_rank")


@lru_cache
def bm25_sql(top: int, name: str = "sparse", rows: str = "documents") -> str:
    return f"""
toks AS (SELECT doc_id AS ord, {tokens_sql("coalesce(text, '')")} AS ts FROM {rows}),
stats AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_len FROM toks),
postings AS (SELECT ord, doc_len, term, count(*) AS tf FROM (SELECT ord, len(ts) AS doc_len, unnest(ts) AS term FROM toks) GROUP BY ALL),
term_df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
terms AS (SELECT DISTINCT item_id AS qid, unnest({tokens_sql("text")}) AS term FROM benchmark),
scored AS (SELECT qid, ord, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 6) AS score
           FROM postings JOIN terms USING (term) JOIN term_df USING (term), stats GROUP BY qid, ord),
{name} AS (SELECT qid, ord, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) - 1)::INT AS rank FROM scored WHERE score > 0 QUALIFY rank < {top})"""


def cosine_sql(rows: str, asked: str, top: int, name: str) -> str:
    return f"""
{name} AS (SELECT q.qid, d.ord, round(list_cosine_similarity(d.v::DOUBLE[], q.v::DOUBLE[]), 6) AS score,
                  (row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(d.v::DOUBLE[], q.v::DOUBLE[]), 6) DESC, d.ord) - 1)::INT AS rank
           FROM ({rows}) d CROSS JOIN ({asked}) q QUALIFY rank < {top})"""


PAIRED = "SELECT vec_id AS ord, embedding AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)"
ASKED = "SELECT item_id AS qid, embedding AS v FROM benchmark JOIN embeddings ON item_id = vec_id"
ARMS = f"""{bm25_sql(POOL)}, {cosine_sql(PAIRED, ASKED, POOL, "dense")},
arms AS (SELECT *, 0 AS arm FROM dense UNION ALL SELECT *, 1 AS arm FROM sparse)"""
FUSED = f"""{ARMS},
fused AS (SELECT qid, ord, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score, min(arm * 1000 + rank) AS seen FROM arms GROUP BY qid, ord)"""
NORM = "lower(regexp_replace({0}, '[\\s/()（）]+', '', 'g'))"
SPARSE_FUSED = f"""{bm25_sql(POOL)},
arms AS (SELECT *, 1 AS arm FROM sparse),
fused AS (SELECT qid, ord, score, 1000 + rank AS seen FROM sparse)"""


DENSE_FUSED = f"""{cosine_sql(PAIRED, ASKED, POOL, "dense").strip()},
arms AS (SELECT *, 0 AS arm FROM dense),
fused AS (SELECT qid, ord, score, rank AS seen FROM dense)"""


def boosted_sql(fused: str = FUSED) -> str:
    return f"""{fused},
boosted AS (SELECT f.qid, f.ord, f.seen, source AS doc_id,
                   CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS priority,
                   CASE WHEN length({NORM.format("split_part(d.text, ' ', 1)")}) >= 3 AND contains({NORM.format("b.text")}, {NORM.format("split_part(d.text, ' ', 1)")})
                        THEN round(f.score * 1.35::DOUBLE, 9) ELSE f.score END AS score
            FROM fused f JOIN documents d ON d.doc_id = f.ord JOIN benchmark b ON b.item_id = f.qid)"""


def diversified_sql(top: int, fused: str = FUSED) -> str:
    return f"""{boosted_sql(fused)},
capped AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, priority, seen, ord) AS n FROM boosted QUALIFY n <= 2),
chosen AS (SELECT qid, ord, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, priority, seen, ord) - 1)::INT AS rank FROM capped QUALIFY rank < {top})"""


def rescued_sql(top: int, fused: str = FUSED) -> str:
    return f"""{diversified_sql(top, fused)},
missing AS (SELECT a.qid, a.ord, a.arm FROM arms a WHERE a.rank = 0 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.qid = a.qid AND c.ord = a.ord)),
freed AS (SELECT qid, count(*) AS n_missing FROM missing GROUP BY qid),
floors AS (SELECT qid, arg_max(score, rank) AS floor, count(*) AS n FROM chosen GROUP BY qid),
kept AS (SELECT c.* FROM chosen c LEFT JOIN freed f USING (qid) WHERE f.qid IS NULL OR c.rank < greatest(0, {top} - n_missing)),
added AS (SELECT m.qid, m.ord, round(f.floor * 0.99::DOUBLE, 9) AS score, least(f.n, greatest(0, {top} - r.n_missing)) AS n_kept,
                 row_number() OVER (PARTITION BY m.qid ORDER BY min(m.arm)) AS place
          FROM missing m JOIN floors f USING (qid) JOIN freed r USING (qid) GROUP BY m.qid, m.ord, f.floor, f.n, r.n_missing),
final AS (SELECT qid, ord, score, rank, false AS rescued FROM kept
          UNION ALL SELECT qid, ord, score, (n_kept + place - 1)::INT, true FROM added WHERE place <= {top} - n_kept)"""


HYBRID_SQL = f"""WITH {rescued_sql(5)}
SELECT f.qid, f.rank, f.ord, f.score, f.rescued, d.rank AS dense_rank, s.rank AS bm25_rank, x.source AS doc_id,
       CASE x.lang WHEN 'en' THEN 'fact' WHEN 'fr' THEN 'spec_line' WHEN 'de' THEN 'spec_row' ELSE 'feature' END AS kind
FROM final f LEFT JOIN dense d USING (qid, ord) LEFT JOIN sparse s USING (qid, ord) JOIN documents x ON x.doc_id = f.ord"""

COSINE_SQL = "WITH " + cosine_sql("SELECT vec_id AS ord, embedding AS v FROM embeddings", "SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 50 = 0", TOP, "found") + " SELECT * FROM found"
WITHOUT_SRC0 = "(SELECT * FROM documents WHERE source <> 'src0')"

QUERIES = {
    "term_df_topk": (term_df_topk, f"WITH {bm25_sql(1)} SELECT term, df FROM term_df ORDER BY df DESC, term LIMIT 20"),
    "corpus_stats": (corpus_stats, f"WITH {bm25_sql(1)} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats"),
    "bm25_topk": (bm25_topk, f"WITH {bm25_sql(TOP)} SELECT * FROM sparse"),
    "bm25_whole": (bm25_whole, f"WITH {bm25_sql(TOP)} SELECT * FROM sparse"),
    "index_changes": (index_changes, f"WITH {bm25_sql(TOP, rows=WITHOUT_SRC0)} SELECT * FROM sparse"),
    "cosine_topk": (cosine_topk, COSINE_SQL),
    "cosine_pivots": (cosine_pivots, COSINE_SQL),
    "rrf_fuse": (rrf, f"WITH {FUSED} SELECT qid, ord, score, (seen // 1000)::INT AS arm, (seen % 1000)::INT AS rank FROM fused"),
    "key_boost": (boosted, f"WITH {boosted_sql()} SELECT qid, ord, score FROM boosted"),
    "diversify_cap": (diversified, f"WITH {diversified_sql(TOP)} SELECT * FROM chosen"),
    "rescue": (rescued, f"WITH {rescued_sql(3)} SELECT * FROM final"),
    "hybrid_search": (hybrid, HYBRID_SQL),
    "dense_mode_search": (dense_mode, f"WITH {rescued_sql(5, DENSE_FUSED)} SELECT f.qid, f.rank, f.ord, f.score, d.rank AS dense_rank FROM final f LEFT JOIN dense d USING (qid, ord)"),
    "degraded_search": (degraded, f"WITH {rescued_sql(5, SPARSE_FUSED)} SELECT f.qid, f.rank, f.ord, f.score, s.rank AS bm25_rank FROM final f LEFT JOIN sparse s USING (qid, ord)"),
    "bm25_mode_search": (bm25_mode, f"WITH {rescued_sql(5, SPARSE_FUSED)} SELECT f.qid, f.rank, f.ord, f.score, s.rank AS bm25_rank FROM final f LEFT JOIN sparse s USING (qid, ord)"),
}
