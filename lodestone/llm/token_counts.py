"""Token counts of a SentencePiece BPE model, summed over pre-tokens.

No piece of such a model holds a word mark after other characters, and none holds a line feed, so merges never cross
from a word into the blanks before the next one or over a line end: a text's count is the sum over its pre-tokens
(blanks and the word after them) plus one byte piece for each line feed. `check_model` proves both facts about the
vocabulary before anything is counted.

The frequent pre-tokens are found in a first pass, counted once and broadcast: a table of at most HOT rows of at most KEY
characters. A second pass turns each document into its pre-token frequencies, joins the frequent ones at once and stores
the rest. These are shuffled by pre-token and sorted, so that all documents' frequencies of one lie side by side: each
distinct pre-token is counted once and joined with them, and the products are summed by document. No id is ever made, and
no key of the shuffle is hot: one that is not broadcast is in less than a SHARE of all documents, or in less than 1/HOT of
all pairs of document and pre-token.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, stored, table, texts

MARK = "▁"
LIMIT = 4096
#: Pre-tokens that are broadcast with their counts (longer ones by a digest), so some 20 MB at most.
HOT, KEY = 65_536, 64
#: Frequent is what so many of the documents of some block hold, and at least LEAST of them.
SHARE, LEAST = 0.001, 8
#: Distinct pre-tokens at which a block ends.
BLOCK = 400_000
#: Characters of text whose frequencies leave Python at once.
PART = 1 << 20


def check_model(sp) -> None:
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or "\n" in piece:
            raise ValueError(f"piece {piece!r} may join pre-tokens: counts would not add up")
    if ["".join(sp.encode(x, out_type=str)) for x in ("a", " a ")] != [MARK + "a", MARK * 2 + "a" + MARK]:
        raise ValueError("the model must add a leading blank and keep blanks")


@lru_cache(maxsize=2)
def load_model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(sp)
    return sp


def pre_tokens(text: str) -> Iterator[str]:
    """The pre-tokens of a text but line feeds; each blank stands for one mark, and the first line gains one."""
    text = " " + text.replace(MARK, " ")
    for line in text.split("\n"):
        if "  " not in line and not line.endswith(" "):
            words = line.split(" ")
            if words[0]:
                yield words[0]
            for word in words[1:]:
                yield " " + word
            continue
        blanks = ""
        for i, word in enumerate(line.split(" ")):
            blanks += " " * (i > 0)
            if word:
                yield blanks + word
                blanks = ""
        if blanks:
            yield blanks


def pieces(sp, tokens: list[str]) -> list[int]:
    """The number of pieces of each pre-token, as they are inside a text."""
    # The model puts a mark before any text: a blank is taken off for it, or a line feed (2 pieces) shields the start.
    whole = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
    found = map(len, sp.encode(whole, num_threads=1))
    return [1 if t == " " else n - 2 * (t[0] != " ") for t, n in zip(tokens, found, strict=True)]


def key_of(token: str) -> str:
    """The pre-token; a digest of it, behind a line feed, which no pre-token has, if it is long."""
    return token if len(token) <= KEY else "\n" + hashlib.sha256(token.encode()).hexdigest()[: KEY - 1]


def frequent(rows: DataFrame, model: str, hot: int = HOT) -> dict[str, int]:
    """Pieces of the `hot` pre-tokens that most documents hold, by key_of; at most HOT short rows come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = Counter(), 0

        def block() -> pd.DataFrame:
            least = max(SHARE * n, LEAST)
            often = [(key_of(t), t, k) for t, k in held.items() if k >= least]
            return pd.DataFrame(often, columns=["key", "token", "held"])

        for batch in batches:
            for text in batch["text"]:
                if text:
                    held.update(set(pre_tokens(text)))
                    n += 1
                if len(held) > BLOCK:
                    yield block()
                    held.clear()
                    n = 0
        yield block()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = load_model(model)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "pieces": pieces(sp, batch["token"].tolist())})

    found = rows.select("text").mapInPandas(run, "key string, token string, held long")
    often = found.groupBy("key").agg(F.any_value("token").alias("token"), F.sum("held").alias("held"))
    most = often.orderBy(F.desc("held"), "key").limit(hot)
    return {r.key: r.pieces for r in most.mapInPandas(counted, "key string, pieces long").collect()}


def frequencies(rows: DataFrame, known: dict[str, int]) -> DataFrame:
    """(doc_id, n_bytes, n, rest array<struct<token, k>>) of rows (doc_id, text): the pieces of line feeds and of known
    pre-tokens, and how often each other pre-token is there.
    """
    sent = rows.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, whole = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(whole):
                # A part of a batch: about PART characters, but one text at least.
                end, size = start, 0
                sums, sizes, tokens, counts, offsets = [], [], [], [], [0]
                while end < len(whole) and (end == start or size + len(whole[end]) <= PART):
                    text = whole[end]
                    size += len(text)
                    end += 1
                    n = text.count("\n")
                    for token, k in Counter(pre_tokens(text)).items() if text else ():
                        if (p := known.get(token if len(token) <= KEY else key_of(token))) is not None:
                            n += p * k
                        else:
                            tokens.append(token)
                            counts.append(k)
                    sums.append(n)
                    sizes.append(len(text.encode()))
                    offsets.append(len(tokens))
                pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "k"])
                rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), rest], ["doc_id", "n_bytes", "n", "rest"])
                start = end

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n long, rest array<struct<token:string,k:long>>")


def sorted_counts(model: str):
    """What a task does with pairs (row, token, k) in order of their pre-tokens: each distinct one is counted once, and
    its pieces times k go to each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load_model(model)
        last, its = None, 0
        for batch in batches:
            tokens = batch.column(1).dictionary_encode()
            distinct = tokens.dictionary.to_pylist()
            if not distinct:
                continue
            new = distinct[1:] if distinct[0] == last else distinct
            counted = [its] * (len(distinct) - len(new)) + pieces(sp, new)
            last, its = distinct[-1], counted[-1]
            n = np.array(counted, dtype=np.int64)[tokens.indices.to_numpy()] * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["row", "n"])

    return run


def joined(pairs: DataFrame, model: str) -> DataFrame:
    """(row, n) of pairs (row, token, k): k times the pieces of the pre-token; pairs are dealt and sorted by it."""
    return pairs.select("row", "token", "k").repartition("token").sortWithinPartitions("token").mapInArrow(sorted_counts(model), "row long, n long")


def count_tokens(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: no bytes and no tokens. Whole texts of any length are counted; repeated rows and
    null ids are kept; further columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    # Rows have numbers of their own, as ids may be null or repeated; they are fixed by being stored.
    own = stored(frequencies(rows, frequent(rows, model, hot)).select(F.monotonically_increasing_id().alias("row"), "*"), compression="zstd")
    rest = joined(own.select("row", F.inline("rest")), model)
    nothing = F.lit(None)
    more = rest.select("row", nothing.cast(rows.schema["doc_id"].dataType).alias("doc_id"), nothing.cast("long").alias("n_bytes"), "n")
    whole = own.drop("rest").unionByName(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
