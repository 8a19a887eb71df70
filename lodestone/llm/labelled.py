"""Bounded samples of documents, chosen by a hash of the id: the same for any order and partitioning.

A sample has two bounds that its caller states: documents, and characters in all. Texts are taken whole, in the order of
the hash; one that would go beyond the bound is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, texts

PARTS = 1_000_000


def share_for(most: int, n: int) -> int:
    """So many of PARTS that `most` of n rows are surely among them, and few more."""
    return int(min(1.0, (1.3 * most + 100) / max(n, 1)) * PARTS)


def part_of(column: str = "doc_id"):
    return F.pmod(F.xxhash64(column), F.lit(PARTS))


def fitting(rows: list, total: int) -> list:
    """Of rows that end with a length, in their order, those that fit into `total` beside the ones before: a text that is too
    long is passed over, and the next ones are tried.
    """
    out = []
    for r in rows:
        if r[-1] <= total:
            total -= r[-1]
            out.append(r)
    return out


def drawn(rows: DataFrame, most: int, total: int) -> tuple[list[str], list]:
    """Texts and labels of rows (doc_id, text, label): at most `most`, of `total` characters in all, in order of the hashes of their
    ids, then of ids, of their texts' hashes and of labels. Rows that are equal in all of these count once.

    Texts are read after the choice: until then a row is its id, label, and the text's hash and length.
    """
    keyed = rows.withColumns({"t": F.xxhash64("text"), "n": F.length("text").cast("long")})
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("t"), F.col("label")]
    first = keyed.select("doc_id", "t", "label", "n").distinct().orderBy(*order).limit(most).collect()
    chosen = fitting(first, total)
    if not chosen:
        return [], []
    wanted = rows.sparkSession.createDataFrame([(r.doc_id, r.t, r.n) for r in chosen], keyed.select(F.col("doc_id").alias("d"), F.col("t").alias("h"), F.col("n").alias("m")).schema)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("h")) & (F.col("n") == F.col("m"))
    found = keyed.join(F.broadcast(wanted.distinct()), same, "left_semi").groupBy("doc_id", "t", "n").agg(F.min("text").alias("text"))
    text = {(r.doc_id, r.t, r.n): r.text for r in found.collect()}
    return [text[r.doc_id, r.t, r.n] for r in chosen], [r.label for r in chosen]


def sample(rows: DataFrame, label: str | None, most: int, total: int) -> tuple[list[str], list]:
    """Texts and labels of a sample of rows (doc_id, text, label), see drawn(): whole texts, chosen by the ids' hashes. An id that
    is repeated with other texts or labels is a row for each. No rows: empty lists.
    """
    keyed = rows.select("doc_id", "text", (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    found, labels = drawn(keyed.filter(part_of() < share_for(most, rows.count())), most, total)
    return found, labels if label else []


def sample_texts(docs: DataFrame, most: int, total: int) -> list[str]:
    """At most `most` texts of `total` characters in all; null texts count as empty."""
    return sample(texts(docs), None, most, total)[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, total: int, held_out: int = 0, of: int = 5) -> tuple[list[str], list[int]]:
    """At most `most` texts, of `total` characters in all, and their labels, of documents whose crc32 modulo `of` is not
    `held_out`.

    The sample is taken from the labels, so that only its own texts are moved. Null labels and ids are left out; of
    several labels of a document the largest counts; several texts of one id are a row each.
    """
    marked = labels.select("doc_id", F.col(column).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.filter(crc_mod(F.col("doc_id"), of) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marked.filter(part_of() < share_for(most, marked.count())).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found, known = drawn(texts(docs).join(F.broadcast(chosen), "doc_id"), most, total)  # `most` rows of two numbers
    order = sorted(range(len(found)), key=lambda i: (found[i], known[i]))
    return [found[i] for i in order], [known[i] for i in order]
