"""Exact cosine search that skips what is too far: vectors are dealt to the nearest of some pivots, and kept by their angle to it.

Angles obey the triangle inequality. If a query lies at angle a from a pivot, and a vector at angle b from the same one, they are at
least |a - b| apart. The pivots nearest to a query give a first threshold; then only parts and, within a part, only the
range of angles that can hold a vector above it are compared. Nothing that could be among the best is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import hadoop, ready, shared_dir, stored
from .dense import ROW_BLOCK, Best, best_batch, matrix_of, query_blocks, rounded
from .lexical import DIGITS, ranked

#: Pivots at most, vectors that they are chosen from, and steps of choosing.
PIVOTS, SAMPLE, STEPS = 256, 16_384, 6
#: What rounding of scores, and of angles near 0, may hide.
SLACK = 10.0**-DIGITS


def chosen_pivots(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n directions about which the sample lies, by steps of spherical k-means; fewer if the sample is smaller."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(seed)
    pivots = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(STEPS):
        near = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), pivots)
    return pivots


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


@dataclass
class PivotIndex:
    """parts: (pivot, n, low, high), the number and the range of angles of each part: no more rows than pivots. Zero vectors are
    part -1, at no angle from anything.
    """

    spark: SparkSession
    path: str
    pivots: np.ndarray
    parts: dict[int, tuple[int, float, float]]

    @classmethod
    def create(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS) -> PivotIndex:
        """The index of vectors (ord, v), kept in a folder. Pivots come from a sample of SAMPLE vectors at most, chosen by a hash of
        their ord; rows without a vector are left out.
        """
        spark = vectors.sparkSession
        ready(spark)
        known = vectors.filter("v IS NOT NULL").select(F.col("ord").cast("bigint").alias("ord"), F.transform("v", lambda x: x.cast("double")).alias("v"))
        sample = np.array([r.v for r in known.orderBy(F.xxhash64("ord"), "ord").limit(SAMPLE).collect()])
        sample = sample if len(sample) else np.zeros((0, 1))
        sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
        found = chosen_pivots(sample, pivots)
        sent = spark.sparkContext.broadcast(found)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = sent.value
            for batch in batches:
                rows = matrix_of(batch.column("v"), pivots.shape[1])
                near, at = np.full(len(rows), -1, np.int32), np.zeros(len(rows))
                if len(pivots):
                    cosine = rows @ pivots.T
                    some = (rows != 0).any(axis=1)
                    near[some] = cosine[some].argmax(axis=1)
                    at[some] = angle(cosine[some].max(axis=1))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("ord"), v, pa.array(near), pa.array(at)], names=["ord", "v", "pivot", "angle"])

        placed = known.mapInArrow(dealt, "ord bigint, v array<double>, pivot int, angle double")
        # A popular pivot's part is cut by angle, so none is one task's.
        placed.repartitionByRange("pivot", "angle").sortWithinPartitions("pivot", "angle").write.mode("overwrite").parquet(f"{path}/vectors")
        counts = spark.read.parquet(f"{path}/vectors").groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        counts.write.mode("overwrite").parquet(f"{path}/parts")
        spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(found)], "pivot int, v array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PivotIndex:
        pivots = [r.v for r in spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()]
        parts = {r.pivot: (r.n, r.low, r.high) for r in spark.read.parquet(f"{path}/parts").collect()}
        return cls(spark, path, np.array(pivots) if pivots else np.zeros((0, 1)), parts)

    @classmethod
    def temporary(cls, vectors: DataFrame, pivots: int = PIVOTS) -> PivotIndex:
        """An index in the shared folder that lasts as long as the session."""
        spark = vectors.sparkSession
        path = f"{shared_dir(spark)}/lodestone-pivots-{uuid.uuid4().hex}"
        where, files = hadoop(spark, path)
        files.deleteOnExit(where)
        return cls.create(vectors, path, pivots)

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, ord, score, rank): the same rows as dense.cosine_search gives."""
        return self._search(queries, top_k)[0]

    def compared(self, queries: DataFrame, top_k: int = 10) -> tuple[int, int]:
        """Pairs of query and vector that a search compares, and all pairs."""
        _, works = self._search(queries, top_k)
        total = sum(n for n, _, _ in self.parts.values()) * queries.filter("v IS NOT NULL").count()
        return sum(w.agg(F.sum("n")).first()[0] or 0 for w in works), total

    def _search(self, queries: DataFrame, top_k: int) -> tuple[DataFrame, list[DataFrame]]:
        qid = queries.schema["qid"].dataType
        found = self.spark.createDataFrame([], f"qid {qid.simpleString()}, ord bigint, score double")
        works = []
        for qids, q in query_blocks(queries):
            ids = pa.array(qids, to_arrow_type(qid))
            away = angle(q @ self.pivots.T) if len(self.pivots) else np.zeros((len(q), 0))
            first = self._nearest(away, top_k)
            near, work = self._compare(ids, q, away, [first[k] for k in range(len(q))], None, top_k, qid)
            near = stored(near)
            least = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= top_k)
            known = {r.qid: r.least for r in ranked(near, top_k).join(least.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.min("score").alias("least")).collect()}
            reach = np.array([angle(np.float64(known[x] - SLACK)) if x in known else np.pi for x in qids])
            rest = []
            for k in range(len(q)):
                parts = [p for p, (_, low, high) in self.parts.items() if p not in first[k]]
                rest.append({p for p in parts if p < 0 or (away[k, p] - self.parts[p][2] <= reach[k] + SLACK and self.parts[p][1] - away[k, p] <= reach[k] + SLACK)})
            # A zero vector's score is 0, whatever the query.
            rest = [{p for p in r if p >= 0 or qids[k] not in known or known[qids[k]] <= SLACK} for k, r in enumerate(rest)]
            far, more = self._compare(ids, q, away, rest, reach, top_k, qid)
            found = found.unionByName(near.select("qid", "ord", "score")).unionByName(far.select("qid", "ord", "score"))
            works += [work, more]
        return ranked(found, top_k), works

    def _nearest(self, away: np.ndarray, top_k: int) -> list[set[int]]:
        """For each query, its nearest parts with top_k vectors in all."""
        sizes = np.array([self.parts.get(p, (0, 0, 0))[0] for p in range(away.shape[1])])
        out = []
        for row in away:
            order = np.argsort(row, kind="stable")
            n = int(np.searchsorted(np.cumsum(sizes[order]), top_k)) + 1
            out.append({int(p) for p in order[:n] if sizes[p]})
        return out

    def _compare(self, ids: pa.Array, q: np.ndarray, away: np.ndarray, wanted: list[set[int]], reach: np.ndarray | None, top_k: int, qid) -> tuple[DataFrame, DataFrame]:
        """(qid, ord, score, task): the best of the wanted parts of each query, within its reach if that is given; and the counts n of
        compared pairs. Only the wanted parts are read.
        """
        by_part: dict[int, list[int]] = {}
        for k, parts in enumerate(wanted):
            for p in parts:
                by_part.setdefault(p, []).append(k)
        sent = self.spark.sparkContext.broadcast((ids, q, away, {p: np.array(ks) for p, ks in by_part.items()}, reach))
        rows = self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("pivot").isin(*by_part) if by_part else F.lit(False))

        def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
            """Queries and rows to be compared, and where these lie in the batch."""
            _, _, away, by_part, reach = sent.value
            pivot, at = batch.column("pivot").to_numpy(), batch.column("angle").to_numpy()
            cuts = np.flatnonzero(np.diff(pivot, prepend=pivot[:1] - 1))
            for s, e in zip(cuts, [*cuts[1:], len(pivot)], strict=True):
                queries = by_part.get(int(pivot[s]))
                if queries is None:
                    continue
                for a in range(s, e, ROW_BLOCK):
                    b = min(e, a + ROW_BLOCK)
                    some = queries
                    if reach is not None and pivot[s] >= 0:
                        own = away[queries, pivot[s]]
                        low, high = at[a:b].min(), at[a:b].max()
                        some = queries[(own - high <= reach[queries] + SLACK) & (low - own <= reach[queries] + SLACK)]
                    if len(some):
                        yield some, slice(a, b)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, *_ = sent.value
            best = Best(len(q), top_k)
            for batch in batches:
                ords, v = batch.column("ord").to_numpy(), matrix_of(batch.column("v"), q.shape[1])
                for queries, part in pairs(batch):
                    best.offer(rounded(q[queries] @ v[part].T), ords[part], queries)
            yield best_batch(best, ids)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = sum(len(queries) * (part.stop - part.start) for batch in batches for queries, part in pairs(batch))
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        schema = f"qid {qid.simpleString()}, ord bigint, score double, task int"
        return rows.mapInArrow(run, schema), rows.select("pivot", "angle").mapInArrow(count, "n bigint")
