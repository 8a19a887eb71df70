"""Vectors: embedders, normalisation and exact cosine search for many queries at once."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import let, tokenize, tokens_of
from ..sources.shared import stored
from .lexical import DIGITS, ranked

FLOOR = 1e-12
#: Queries that are sent at once, and queries and rows of one product of matrices: what a task holds of scores stays the same, however
#: many queries come.
QUERY_BLOCK, PRODUCT, ROW_BLOCK = 4096, 256, 1024
#: Bytes of vectors from which tasks' results are merged in two steps, the first in so many parts a query.
MANY_BYTES, FAN = 8 << 30, 64


def normalised(v: Column) -> Column:
    """The vector over its length, as doubles; a zero vector stays zero."""
    length = lambda d: F.greatest(F.sqrt(dot(d, d)), F.lit(FLOOR))
    return let(F.transform(v, lambda x: x.cast("double")), lambda d: let(length(d), lambda n: F.transform(d, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class Embedder(Protocol):
    """A named model of a fixed dimension."""

    name: str
    dim: int

    def encode(self, texts: Column, is_query: bool = False) -> Column: ...


class HashingEmbedder:
    """Tokens hashed to signed buckets: blake2b of 64 bits, little-endian, the top bit for the sign."""

    name = "hash"

    def __init__(self, dim: int = 512):
        self.dim = dim

    def encode(self, texts: Column, is_query: bool = False) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, tuple[int, float]] = {}
            for texts in batches:
                rows = []
                for text in texts:
                    v = np.zeros(dim)
                    for w in tokens_of(text or ""):
                        if w not in known:
                            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                            if len(known) > 200_000:
                                known.clear()
                            known[w] = (h % dim, 1.0 if h >> 63 else -1.0)
                        at, sign = known[w]
                        v[at] += sign
                    rows.append(v / max(float(np.linalg.norm(v)), FLOOR))
                yield pd.Series(rows)

        return embed.asNondeterministic()(texts)  # or else Spark would put it inside lambdas


class Md5Embedder:
    """The same idea with md5, wholly in SQL: bucket from the first 7 hex digits, sign from the eighth."""

    name = "md5"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: Column, is_query: bool = False) -> Column:
        digests = F.transform(tokenize(texts), F.md5)
        bucket = lambda d: F.conv(F.substring(d, 1, 7), 16, 10).cast("long") % self.dim
        sign = lambda d: F.when(F.substring(d, 8, 1) >= "8", 1.0).otherwise(-1.0)
        hits = F.transform(digests, lambda d: F.struct(bucket(d).alias("b"), sign(d).alias("s")))
        every = F.sequence(F.lit(0), F.lit(self.dim - 1))
        total = lambda hs, i: F.aggregate(F.filter(hs, lambda h: h["b"] == i), F.lit(0.0), lambda a, h: a + h["s"])
        return normalised(let(hits, lambda hs: F.transform(every, lambda i: total(hs, i))))


class ModelEmbedder:
    """A model that `load` makes once per worker: texts to an array (n, dim), with a prefix for queries or passages.

    Models that answer a vector for each token (n, tokens, dim) are averaged.
    """

    def __init__(self, name: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]], query_prefix: str = "", passage_prefix: str = ""):
        self.name, self.dim, self.load, self.prefixes = name, dim, load, (passage_prefix, query_prefix)

    def encode(self, texts: Column, is_query: bool = False) -> Column:
        load, prefix = self.load, self.prefixes[is_query]

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                out = [np.asarray(v, dtype=float) for v in model([prefix + (t or "") for t in batch])]
                out = [v.mean(axis=0) if v.ndim == 2 else v for v in out]
                yield pd.Series([v / max(float(np.linalg.norm(v)), FLOOR) for v in out])

        return embed.asNondeterministic()(texts)


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": HashingEmbedder, "hashing": HashingEmbedder, "none": HashingEmbedder, "md5": Md5Embedder}


def register_embedder(name: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]], query_prefix: str = "", passage_prefix: str = "") -> None:
    """Make a model known by its name, with what its questions and passages must begin with."""
    EMBEDDERS[name.lower()] = lambda: ModelEmbedder(name, dim, load, query_prefix, passage_prefix)


def build_embedder(name: str) -> Embedder:
    if name.lower() not in EMBEDDERS:
        raise KeyError(f"no embedder {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name.lower()]()


def embed_corpus(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(ord, v): normalised vectors of the texts."""
    return chunks.select("ord", embedder.encode(F.col("text")).alias("v"))


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of lists of numbers, of length 1; a zero vector stays zero. ValueError if one has another dimension."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != dim).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} numbers; the queries' have {dim}")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), FLOOR)


class Best:
    """The top_k rows of each of n queries among those seen so far, by rounded score, then ord."""

    def __init__(self, n: int, top_k: int):
        self.top_k, self.least = top_k, np.full(n, -np.inf)
        self.query, self.ord, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, ords: np.ndarray, score: np.ndarray) -> None:
        """Rows that may be among the best: those whose score is not below the query's least one."""
        query, ords, score = (np.concatenate(x) for x in ((self.query, query), (self.ord, ords), (self.score, score)))
        order = np.lexsort((ords, -score, query))
        query, ords, score = query[order], ords[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.top_k
        self.query, self.ord, self.score = query[keep], ords[keep], score[keep]
        last = place[keep] == self.top_k - 1
        self.least[self.query[last]] = self.score[last]

    def offer(self, score: np.ndarray, ords: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Scores (queries, rows)."""
        own = self.least if queries is None else self.least[queries]
        q, r = np.nonzero(score >= own[:, None])
        if len(q):
            self.add(q if queries is None else queries[q], ords[r], score[q, r])


def rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, DIGITS) + 0.0


def query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """ids and vectors of queries (qid, v), QUERY_BLOCK or so at a time; queries without a vector are left out."""
    asked = queries.select("qid", F.transform("v", lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL")
    first = asked.limit(QUERY_BLOCK + 1).collect()
    if len(first) <= QUERY_BLOCK:
        blocks = [first] if first else []
    else:
        numbered = stored(asked)
        n = -(-numbered.count() // QUERY_BLOCK)
        blocks = (numbered.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == k).collect() for k in range(n))
    for block in blocks:
        if block:
            v = np.array([r.v for r in block])
            yield [r.qid for r in block], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), FLOOR)


def cosine_search(vectors: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, ord, score, rank) for vectors (ord, v) and queries (qid, v); all scores count, whatever their sign. Rows without a
    vector are left out.

    Exact: every vector meets every query, as the query set is stated. Queries are sent to the machines in blocks of QUERY_BLOCK;
    a task holds the best top_k rows of each through all its batches, and gives no more than these. Over many tasks they are
    merged in two steps.
    """
    qid, known = queries.schema["qid"].dataType, vectors.filter("v IS NOT NULL").select(F.col("ord").cast("bigint").alias("ord"), "v")
    schema = f"qid {qid.simpleString()}, ord bigint, score double, task int"
    found = None
    for qids, q in query_blocks(queries):
        best = known.mapInArrow(best_of(vectors.sparkSession.sparkContext.broadcast((pa.array(qids, to_arrow_type(qid)), q)), top_k), schema)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"qid {qid.simpleString()}, ord bigint, score double, rank int")
    if int(str(known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > MANY_BYTES:
        place = F.row_number().over(Window.partitionBy("qid", F.pmod("task", F.lit(FAN))).orderBy(F.desc("score"), "ord"))
        found = found.withColumn("place", place).filter(F.col("place") <= top_k)
    return ranked(found.select("qid", "ord", "score"), top_k)


def best_of(sent, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (qid, ord, score, task): the top_k of a task's rows (ord, v) for each query that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        parts = [slice(k, k + PRODUCT) for k in range(0, len(q), PRODUCT)]
        best = [Best(len(q[part]), top_k) for part in parts]
        for batch in (big.slice(k, ROW_BLOCK) for big in batches for k in range(0, big.num_rows, ROW_BLOCK)):
            rows, ords = matrix_of(batch.column("v"), q.shape[1]), batch.column("ord").to_numpy()
            for part, own in zip(parts, best, strict=True):
                own.offer(rounded(q[part] @ rows.T), ords)
        for part, own in zip(parts, best, strict=True):
            yield best_batch(own, qids[part])

    return run


def cosine_latency(vectors: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, seconds) that each query takes by itself, timed in the worker: of its tasks, which work side by side, the slowest."""
    qid = queries.schema["qid"].dataType
    known = vectors.filter("v IS NOT NULL").select(F.col("ord").cast("bigint").alias("ord"), "v")
    found = vectors.sparkSession.createDataFrame([], f"qid {qid.simpleString()}, seconds double")

    def timed(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            best, took = [Best(1, top_k) for _ in q], np.zeros(len(q))
            for batch in batches:
                rows, ords = matrix_of(batch.column("v"), q.shape[1]), batch.column("ord").to_numpy()
                for k in range(len(q)):
                    began = time.perf_counter()
                    best[k].offer(rounded(q[k : k + 1] @ rows.T), ords)
                    took[k] += time.perf_counter() - began
            yield pa.RecordBatch.from_arrays([qids, pa.array(took)], names=["qid", "seconds"])

        return run

    for qids, q in query_blocks(queries):
        sent = vectors.sparkSession.sparkContext.broadcast((pa.array(qids, to_arrow_type(qid)), q))
        found = found.unionByName(known.mapInArrow(timed(sent), f"qid {qid.simpleString()}, seconds double"))
    return found.groupBy("qid").agg(F.max("seconds").alias("seconds"))


def best_batch(best: Best, qids: pa.Array) -> pa.RecordBatch:
    context = TaskContext.get()
    task = np.full(len(best.ord), context.partitionId() if context else 0, np.int32)
    return pa.RecordBatch.from_arrays([qids.take(pa.array(best.query)), pa.array(best.ord), pa.array(best.score), pa.array(task)], names=["qid", "ord", "score", "task"])
