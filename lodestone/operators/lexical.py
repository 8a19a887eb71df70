"""BM25 over an inverted index that is three DataFrames, every matching posting scored; for an index that is kept see segments.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize
from ..sources.shared import ready, stored

#: Fixed values of the ranking function.
K1, B = 1.5, 0.75
DIGITS = 6
#: Rows of queries and terms that are broadcast at once: some 20 MB.
TERM_ROWS = 262_144
#: Sums of documents and queries, and what is added up in them, that a task holds at once: 16 MB each.
SUMS = 2 << 20


@dataclass
class LexicalIndex:
    """postings (term, ord, tf, doc_len), term_df (term, df), stats (n_docs, avg_len): one row."""

    postings: DataFrame
    term_df: DataFrame
    stats: DataFrame

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return bm25_search(self, queries, top_k)


def term_counts(docs: DataFrame, text: str = "text", ord_col: str = "ord") -> DataFrame:
    """(ord, doc_len, term, tf): one row per document and distinct term. A task counts the terms of its documents before
    the one shuffle, which moves no more than these rows.
    """
    tokens = docs.select(F.col(ord_col).alias("ord"), tokenize(F.col(text)).alias("tokens"))
    counted = tokens.select("ord", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return counted.groupBy("ord", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, avg_len), one row, in one pass: no postings are needed for it."""
    lengths = docs.select(F.size(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("n"))
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))


def build_index(docs: DataFrame, text: str = "text", ord_col: str = "ord") -> LexicalIndex:
    """Documents are tokenised once: the postings are stored, and the rest follows from them. Documents without tokens
    have no postings, but count in n_docs and avg_len.
    """
    postings = stored(term_counts(docs, text, ord_col).select("term", "ord", "tf", "doc_len"))
    term_df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(total)  # one row each
    return LexicalIndex(postings, term_df, stats.select("n_docs", F.try_divide("total", "n_docs").alias("avg_len")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def ranked(scored: DataFrame, top_k: int, by: Column | None = None) -> DataFrame:
    """(qid, ord, score, rank): the top_k of each query by score, then ord; rank starts with 0."""
    order = Window.partitionBy("qid").orderBy(F.desc("score") if by is None else by, "ord")
    return scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < top_k)


def bm25_search(index: LexicalIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, ord, score, rank) for queries (qid, text): distinct query terms, scores above 0, rounded to 6 digits.

    Only postings of query terms are moved, once, by document. They then meet the queries' terms, which are sent in
    blocks of TERM_ROWS or so, where they are: every posting is scored, a document's scores for all queries are added up in one
    place, in a matrix for some documents at a time, and no more than top_k rows of a query leave a task. So neither a frequent term
    nor the number of pairs of query and document is shuffled, sorted or kept.
    """
    terms = stored(queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")))
    asked = index.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    term_df = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # of the queries' terms only
    weighted = terms.join(term_df, "term").crossJoin(F.broadcast(index.stats))  # stats: one row
    weighted = stored(weighted.select("qid", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len"))
    blocks = max(1, -(-weighted.count() // TERM_ROWS))
    ready(queries.sparkSession)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, ord bigint, score double"
    found = None
    for k in range(blocks):
        block = weighted if blocks == 1 else weighted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        here = index.postings.join(F.broadcast(block.select("term").distinct()), "term", "left_semi").repartition("ord").sortWithinPartitions("ord")
        best = here.select("term", F.col("ord").cast("bigint").alias("ord"), "tf", "doc_len").mapInArrow(scored_by(block, top_k), schema)
        found = best if found is None else found.unionByName(best)
    return ranked(found, top_k)


def scored_by(weighted: DataFrame, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (qid, ord, score): the top_k of a task's postings (term, ord, tf, doc_len), which come by ord, for each query of
    weighted (qid, term, idf, avg_len). A batch's postings are added up for all queries; the last document waits for what follows.
    """
    kind = to_arrow_type(weighted.schema["qid"].dataType)
    rows = weighted.collect()  # TERM_ROWS rows or so
    qids = list(dict.fromkeys(r.qid for r in rows))
    place, names = {q: k for k, q in enumerate(qids)}, sorted({r.term for r in rows})
    code = {t: k for k, t in enumerate(names)}
    by_term = sorted((code[r.term], place[r.qid], r.idf) for r in rows)
    at = np.searchsorted(np.array([x[0] for x in by_term], np.int64), np.arange(len(names) + 1))
    query, weight = np.array([x[1] for x in by_term], np.int64), np.array([x[2] for x in by_term], np.float64)
    sent = weighted.sparkSession.sparkContext.broadcast((pa.array(qids, kind), names, at, query, weight, float(rows[0].avg_len) if rows else 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .dense import Best, rounded

        ids, names, at, query, weight, avg_len = sent.value
        known, best = pa.array(names, pa.string()), Best(len(ids), top_k)
        best.least[:] = 10.0**-DIGITS / 2  # scores above 0

        def add(postings: pa.Table) -> None:
            terms = pc.index_in(postings.column("term"), value_set=known).to_numpy()
            tf, length = postings.column("tf").to_numpy().astype(np.float64), postings.column("doc_len").to_numpy()
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
            ords, own = np.unique(postings.column("ord").to_numpy(), return_inverse=True)
            most = max(len(ids), int(np.diff(at)[terms].sum()) // len(ords), 1)
            documents = max(1, SUMS // most)
            for k in range(0, len(ords), documents):
                a, e = np.searchsorted(own, (k, k + documents))
                size = np.diff(at)[terms[a:e]]
                pairs = np.arange(size.sum()) + np.repeat(at[terms[a:e]] - (np.cumsum(size) - size), size)
                n = min(documents, len(ords) - k)
                cell = query[pairs] * n + np.repeat(own[a:e] - k, size)
                score = rounded(np.bincount(cell, np.repeat(gain[a:e], size) * weight[pairs], len(ids) * n).reshape(len(ids), n))
                best.offer(score, ords[k : k + n])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ords = batch.column("ord").to_numpy()
            cut = int(np.searchsorted(ords, ords[-1]))
            if cut or (held and held[-1].column("ord")[0].as_py() != ords[-1]):
                add(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            add(pa.Table.from_batches(held).combine_chunks())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), pa.array(best.ord), pa.array(best.score)], names=["qid", "ord", "score"])

    return run
