"""A corpus pipeline: from raw documents to digests of their tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet before
the next one reads it. All but the last return rows of `documents` with all its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, exact_dedup, near_dedup, quality
from lodestone.llm.common import stored, table


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: their id and text, so that rows with the same id and other texts are not taken for one."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(text.cast("binary")), F.xxhash64(text).cast("string"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is trained on the labels of the first stage's documents.

    A null text is scored as an empty one. Rows with equal texts have equal scores, so they stay or go together, whatever
    their ids; null ids and further columns are kept as they are. An empty table stays empty, and without labels of both
    kinds all documents get the same score.
    """
    return quality.keep_good(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id; null texts count as empty, null ids as the smallest.

    Rows that repeat id and text tie and stay; rows that share only their id do not concern one another. Further columns
    are kept; an empty table stays empty.
    """
    found = exact_dedup.exact_dedup(docs)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "text_sha256").distinct()
    same_text = F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == gone["text_sha256"]
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & same_text, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id; a null id comes after all others.

    Rows are told apart by id and text. All texts without words, null ones too, are one class. Rows that repeat id and text
    tie and stay or go together. Further columns are kept; an empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    same_text = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["text_hash"]
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & same_text, "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Rows are told apart by id and text, so a leak takes no other row with
    its id along, and one without an id goes as well. Null and empty texts hold nothing; repeated rows stay or go together;
    further columns are kept; empty tables take nothing away.
    """
    own = docs.select(row_key(docs).alias("row"), "text")
    leaks = decontamination.find_leaks(own, table(spark, sf_dir, "benchmark"), id_col="row").select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, row_key(docs) == leaks["leak"], "left_anti")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left, a row for each row. A null text is an empty one, with
    no tokens; null and repeated ids are kept; further columns are left out; an empty table gives no rows.
    """
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: Three of the stages have no equivalent in SQL; the tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder: see the stages on nulls, ties, repeats and empty tables. Each
    stage but the last is stored before the next one reads it.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
