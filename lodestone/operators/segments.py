"""A lexical index that is kept: immutable segments in a folder, and exact BM25 search that skips what can't be among the best.

A segment holds the postings of documents that were added together. Documents are dealt to shards by their ord; a term's postings
in a shard lie in blocks by ord, each with the pairs of frequency and length that no other posting of it beats in both, so that the
largest contribution of a block is known for any statistics of the corpus. Deleted documents are marked, with the document
frequencies that they take along. A manifest names the segments and marks that make up a version; a new version appears by one
rename, and readers of an older one keep what they have.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize
from ..sources.shared import hadoop, ready, shared_dir, stored
from .lexical import DIGITS, K1, TERM_ROWS, B, idf, ranked

#: Documents of a shard, characters of its texts, and postings of a block: what a task holds is a shard, whatever the corpus.
SHARD, SHARD_CHARS, BLOCK = 4096, 16 << 20, 128
#: Characters that a token stands for where texts are not read again.
TOKEN_CHARS = 8
#: Documents counted at once, and parts of a shard's terms that single postings are made into blocks by.
TOGETHER, PARTS = 2048, 4
#: No token: its postings are the documents themselves, with their lengths.
DOCS = ""
#: Terms that are pushed to the scan as a list.
PUSHED = 1_000
#: What is below the threshold by no more than this may reach it when scores are rounded.
SLACK = 10.0**-DIGITS

BLOCKS = "shard int, term string, block int, ords array<bigint>, tfs array<int>, lens array<int>, best_tf array<int>, best_len array<int>"


LISTS = "shard int, term string, ords array<bigint>, tfs array<int>, lens array<int>"


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if isinstance(column, pa.Array) else column.chunk(0)


def runs(key: np.ndarray) -> np.ndarray:
    """Where equal keys that follow one another begin, and the end."""
    return np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key)) if len(key) else np.zeros(1, np.int64)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LISTS of rows (shard, ord, tokens): a batch's postings of each term and shard together, and its documents under DOCS."""
    for batch in (big.slice(k, TOGETHER) for big in batches for k in range(0, big.num_rows, TOGETHER)):
        tokens, n = whole(batch.column("tokens")), batch.num_rows
        shard, ords = batch.column("shard").to_numpy(), batch.column("ord").to_numpy(zero_copy_only=False)
        size = np.diff(tokens.offsets.to_numpy())
        coded = tokens.flatten().dictionary_encode()
        names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([DOCS], pa.string())])
        row = np.repeat(np.arange(n), size)
        pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(n, 1) + row, return_counts=True)
        code = np.concatenate([pairs // max(n, 1), np.full(n, len(names) - 1)])
        row, tf = np.concatenate([pairs % max(n, 1), np.arange(n)]), np.concatenate([tf, np.zeros(n, np.int64)])
        key = shard[row].astype(np.int64) * len(names) + code
        order = np.argsort(key, kind="stable")
        key, row, tf = key[order], row[order], tf[order]
        ends = runs(key)
        first = key[ends[:-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(first // len(names), pa.int32()), names.take(pa.array(first % len(names))), lists(ords[row], ends, pa.int64()), lists(tf, ends, pa.int32()), lists(size[row], ends, pa.int32())],
            names=["shard", "term", "ords", "tfs", "lens"],
        )


def counted_blocks(size_of_block: int) -> Callable[[pa.Table], pa.Table]:
    """BLOCKS of one shard's rows (shard, ord, tokens)."""
    blocks = blocks_of(size_of_block)

    def run(rows: pa.Table) -> pa.Table:
        return blocks(pa.Table.from_batches(counted(iter(rows.combine_chunks().to_batches()))))

    return run


def blocks_of(size_of_block: int) -> Callable[[pa.Table], pa.Table]:
    """BLOCKS of one shard's LISTS."""

    def run(rows: pa.Table) -> pa.Table:
        flat = {c: whole(rows.column(c)).flatten().to_numpy(zero_copy_only=False) for c in ("ords", "tfs", "lens")}
        coded = whole(rows.column("term")).dictionary_encode()
        place = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), dtype=object), kind="stable"), kind="stable")
        names = coded.dictionary.take(pa.array(np.argsort(place)))
        term = np.repeat(place[coded.indices.to_numpy(zero_copy_only=False)], np.diff(whole(rows.column("ords")).offsets.to_numpy()))
        order = np.lexsort((flat["ords"], term))
        term = term[order]
        ords, tf, size = (flat[c][order] for c in ("ords", "tfs", "lens"))
        starts = runs(term)
        at = np.arange(len(term)) - np.repeat(starts[:-1], np.diff(starts))
        ends = np.append(np.flatnonzero(at % size_of_block == 0), len(term))
        block = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        # In order of length, only a higher frequency than all before in the block is not beaten.
        by = np.lexsort((-tf, size, block))
        rank = block * (1 << 32) + tf[by]
        best = np.flatnonzero(rank > np.append(-1, np.maximum.accumulate(rank)[:-1]))
        kept = np.append(np.searchsorted(block[best], np.arange(len(ends) - 1)), len(best))
        head = ends[:-1]
        return pa.table(
            [pa.array(np.full(len(head), rows.column("shard")[0].as_py()), pa.int32()), names.take(pa.array(term[head])), pa.array(at[head] // size_of_block, pa.int32()), lists(ords, ends, pa.int64()), lists(tf, ends, pa.int32()), lists(size, ends, pa.int32()), lists(tf[by][best], kept, pa.int32()), lists(size[by][best], kept, pa.int32())],
            names=["shard", "term", "block", "ords", "tfs", "lens", "best_tf", "best_len"],
        )

    return run


def posting_blocks(postings: DataFrame) -> DataFrame:
    """BLOCKS of postings (shard, term, ord, tf, doc_len): by ord, so many to a block."""
    blocks = blocks_of(BLOCK)

    def run(rows: pa.Table) -> pa.Table:
        ends = np.arange(rows.num_rows + 1)
        single = [lists(rows.column(c).to_numpy(), ends, kind) for c, kind in (("ord", pa.int64()), ("tf", pa.int32()), ("doc_len", pa.int32()))]
        return blocks(pa.table([rows.column("shard"), rows.column("term"), *single], names=["shard", "term", "ords", "tfs", "lens"]))

    rows = postings.select(F.col("shard").cast("int"), "term", F.col("ord").cast("bigint"), F.col("tf").cast("int"), F.col("doc_len").cast("int"))
    return rows.groupBy("shard", F.pmod(F.xxhash64("term"), F.lit(PARTS)).alias("part")).applyInArrow(run, BLOCKS)


def held(blocks: pa.Table, gone: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's postings, those of documents that are gone, and where each block begins, and the end."""
    ords = whole(blocks.column("ords"))
    return np.isin(ords.flatten().to_numpy(), gone.column("ord").to_numpy()), ords.offsets.to_numpy()


def lost_terms(blocks: pa.Table, gone: pa.Table) -> pa.Table:
    """(term, df) of the documents of one shard that are gone."""
    if not blocks.num_rows:
        return pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], names=["term", "df"])
    lost, starts = held(blocks, gone)
    df = np.diff(np.append(0, np.cumsum(lost))[starts])
    some = np.flatnonzero(df)
    return pa.table([blocks.column("term").take(pa.array(some)), pa.array(df[some], pa.int64())], names=["term", "df"])


def live_lists(blocks: pa.Table, gone: pa.Table) -> pa.Table:
    """(term, ords, tfs, lens) of the documents of one shard that are not gone."""
    kinds = {"ords": pa.int64(), "tfs": pa.int32(), "lens": pa.int32()}
    if not blocks.num_rows:
        return pa.table([pa.array([], pa.string()), *(pa.array([], pa.list_(t)) for t in kinds.values())], names=["term", *kinds])
    lost, starts = held(blocks, gone)
    ends = np.append(0, np.cumsum(~lost))[starts]
    return pa.table([blocks.column("term"), *(lists(whole(blocks.column(c)).flatten().to_numpy()[~lost], ends, t) for c, t in kinds.items())], names=["term", *kinds])


def shard_of(ord_col: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(ord_col), F.lit(shards)).cast("int")


def impact(tf: np.ndarray, length: np.ndarray, avg_len: float) -> np.ndarray:
    """What a posting adds to a score, without the term's weight."""
    tf = tf.astype(np.float64)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


class Shard:
    """The postings of the asked terms in one shard, and the best of its documents for a query."""

    def __init__(self, blocks: pa.Table, gone: np.ndarray, avg_len: float):
        blocks = blocks.sort_by([("term", "ascending"), ("block", "ascending")])
        arrays = {c: (lambda x: x if isinstance(x, pa.Array) else x.chunk(0))(blocks.column(c).combine_chunks()) for c in ("ords", "tfs", "lens", "best_tf", "best_len")}
        flat = {c: a.flatten().to_numpy(zero_copy_only=False) for c, a in arrays.items()}
        self.starts = arrays["ords"].offsets.to_numpy()
        bounds = arrays["best_tf"].offsets.to_numpy()[:-1]
        self.bound = np.maximum.reduceat(impact(flat["best_tf"], flat["best_len"], avg_len), bounds)
        self.ords = np.unique(flat["ords"])
        self.at = np.searchsorted(self.ords, flat["ords"]).astype(np.int32)  # half the memory of what unique() would give
        self.tf, self.length, self.avg_len = flat["tfs"], flat["lens"], avg_len
        terms = blocks.column("term").to_pylist()
        first = [k for k, t in enumerate(terms) if k == 0 or t != terms[k - 1]]
        self.terms = {terms[k]: (k, e) for k, e in zip(first, [*first[1:], len(terms)], strict=True)}
        self.gone = np.flatnonzero(np.isin(self.ords, gone))
        self.scored = 0

    def postings(self, term: str) -> int:
        a, e = self.terms[term]
        return int(self.starts[e] - self.starts[a])

    def add(self, acc: np.ndarray, weight: float, places: np.ndarray) -> None:
        self.scored += len(places)
        acc[self.at[places]] += weight * impact(self.tf[places], self.length[places], self.avg_len)
        acc[self.gone] = 0

    def best(self, query: list[tuple[str, float]], top_k: int) -> list[tuple[int, float]]:
        """(ord, score) of the top_k documents by rounded score, then ord, of a query of terms and weights.

        Terms come in order of the most that they can add. The k-th best sum so far is a threshold that the final scores of the
        best reach; a block is skipped if nothing in it can, and once all terms that are left can't lift a new document there,
        only documents that are still in the race are looked up in them.
        """
        found = [(w * float(self.bound[slice(*self.terms[t])].max()), w, self.terms[t]) for t, w in query if t in self.terms]
        found.sort(key=lambda x: (-x[0], x[2]))
        rest = np.append(np.cumsum([x[0] for x in found][::-1])[::-1], 0.0)
        n = len(self.ords)
        acc, least, live = np.zeros(n), 0.0, None
        for i, (_, weight, (a, e)) in enumerate(found):
            if live is None and rest[i] < least - SLACK:
                live = np.flatnonzero(acc + rest[i] >= least - SLACK)
                live = live[acc[live] > 0]
            if live is None:
                starts, ends = self.starts[a:e], self.starts[a + 1 : e + 1]
                keep = np.ones(e - a, bool)
                if least > 0:
                    span = np.stack([self.at[starts], self.at[ends - 1] + 1], axis=1).ravel()
                    top = np.maximum.reduceat(np.append(acc, 0.0), span)[::2]
                    keep = weight * self.bound[a:e] + rest[i + 1] + top >= least - SLACK
                sizes = (ends - starts)[keep]
                places = np.arange(sizes.sum()) + np.repeat(starts[keep] - (np.cumsum(sizes) - sizes), sizes)
                self.add(acc, weight, places)
                if n > top_k:
                    least = max(least, float(np.partition(acc, n - top_k)[n - top_k]))
            else:
                own = self.at[self.starts[a] : self.starts[e]]
                where = np.minimum(np.searchsorted(own, live), len(own) - 1)
                self.add(acc, weight, self.starts[a] + where[own[where] == live])
                if len(live) > top_k:
                    least = max(least, float(np.partition(acc[live], len(live) - top_k)[len(live) - top_k]))
                live = live[acc[live] + rest[i + 1] >= least - SLACK]
        score = np.round(acc, DIGITS)
        found = np.flatnonzero(score > 0) if live is None else live[score[live] > 0]
        if len(found) > top_k:
            found = found[score[found] >= np.partition(score[found], len(found) - top_k)[len(found) - top_k]]
        order = np.lexsort((self.ords[found], -score[found]))[:top_k]
        return [(int(self.ords[k]), float(score[k])) for k in found[order]]


def answered(run: Callable, sent, avg_len: float, names: list[str], kinds: list) -> Callable:
    """The function of a shard: what run gives for each query that was sent."""

    def each(blocks: pa.Table, gone: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if blocks.num_rows:
            shard = Shard(blocks, gone.column("ord").to_numpy(), avg_len)
            rows = [(q, *r) for q, query in sent.value.items() for r in run(shard, query)]
        made = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=names)

    return each


@dataclass
class SegmentIndex:
    """One version of an index: segments and marks are dicts of id, docs and tokens (marks: what they take away)."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: list[dict] = field(default_factory=list)
    marks: list[dict] = field(default_factory=list)

    # --- versions

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> SegmentIndex:
        """The latest version, or the one asked for. FileNotFoundError if there is no index."""
        path = path.rstrip("/")
        where, files = hadoop(spark, f"{path}/manifest")
        versions = [int(s.getPath().getName().removesuffix(".json")) for s in files.listStatus(where) if s.getPath().getName().endswith(".json")] if files.exists(where) else []
        if not versions or (version is not None and version not in versions):
            raise FileNotFoundError(f"no lexical index in {path}: build it")
        number = max(versions) if version is None else version
        text = "".join(r.value for r in spark.read.text(f"{path}/manifest/{number}.json").collect())
        known = json.loads(text)
        return cls(spark, path, number, known["segments"], known["marks"])

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        try:
            cls.open(spark, path)
        except FileNotFoundError:
            return False
        return True

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame | None = None, text: str = "text", ord_col: str = "ord") -> SegmentIndex:
        """A new version that holds only docs, whatever was there."""
        last = cls.open(spark, path).version if cls.exists(spark, path) else 0
        empty = cls(spark, path.rstrip("/"), last)
        return empty.commit([], []) if docs is None else empty.append(docs, text, ord_col)

    @classmethod
    def temporary(cls, docs: DataFrame, text: str = "text", ord_col: str = "ord") -> SegmentIndex:
        """An index in the shared folder that lasts as long as the session."""
        spark = docs.sparkSession
        path = f"{shared_dir(spark)}/lodestone-lexical-{uuid.uuid4().hex}"
        where, files = hadoop(spark, path)
        files.deleteOnExit(where)
        return cls.create(spark, path, docs, text, ord_col)

    def commit(self, segments: list[dict], marks: list[dict]) -> SegmentIndex:
        """The next version. If another writer was first, FileExistsError, and nothing has changed."""
        number = self.version + 1
        where, files = hadoop(self.spark, f"{self.path}/manifest/{number}.json")
        draft, _ = hadoop(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps({"segments": segments, "marks": marks}, indent=1).encode())
        out.close()
        if files.exists(where) or not files.rename(draft, where):
            files.delete(draft, False)
            raise FileExistsError(f"{self.path}: version {number} is there already; open the index again")
        return SegmentIndex(self.spark, self.path, number, segments, marks)

    def vacuum(self) -> list[str]:
        """Delete folders and manifests that this version doesn't name; what it deleted. Readers of older versions lose them."""
        where, files = hadoop(self.spark, self.path)
        named = {x["id"] for x in [*self.segments, *self.marks]} | {"manifest"}
        old = [s.getPath() for s in files.listStatus(where) if s.getPath().getName() not in named]
        old += [s.getPath() for s in files.listStatus(hadoop(self.spark, f"{self.path}/manifest")[0]) if s.getPath().getName() != f"{self.version}.json"]
        return [p.getName() for p in old if files.delete(p, True)]

    # --- tables

    def _all(self, parts: list[dict], name: str, schema: str) -> DataFrame:
        out = None
        for x in parts:
            one = self.spark.read.parquet(f"{self.path}/{x['id']}/{name}")
            if name == "blocks":
                one = one.withColumn("segment", F.lit(x["id"]))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schema) if out is None else out

    def blocks(self) -> DataFrame:
        return self._all(self.segments, "blocks", f"{BLOCKS}, segment string")

    def docs(self) -> DataFrame:
        """(segment, shard, ord, doc_len) of all documents, deleted ones too."""
        rows = self.blocks().filter(F.col("term") == DOCS).select("segment", "shard", F.explode(F.arrays_zip("ords", "lens")).alias("p"))
        return rows.select("segment", "shard", F.col("p.ords").alias("ord"), F.col("p.lens").alias("doc_len"))

    def deleted(self) -> DataFrame:
        """(segment, shard, ord, doc_len) of deleted documents that a segment still holds."""
        return self._all(self.marks, "docs", "segment string, shard int, ord bigint, doc_len int")

    def term_df(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) over documents that are not deleted; only of terms (term), if given: they are sought before the counts are
        added up.
        """
        some = lambda df: df if terms is None else df.join(F.broadcast(terms), "term", "left_semi")
        counts = some(self._all(self.segments, "terms", "term string, df bigint")).select("term", "df")
        less = some(self._all(self.marks, "terms", "term string, df bigint")).select("term", (-F.col("df")).alias("df"))
        return counts.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def n_docs(self) -> int:
        return sum(x["docs"] for x in self.segments) - sum(x["docs"] for x in self.marks)

    @property
    def avg_len(self) -> float | None:
        tokens = sum(x["tokens"] for x in self.segments) - sum(x["tokens"] for x in self.marks)
        return tokens / self.n_docs if self.n_docs else None

    # --- changes

    def _write(self, blocks: DataFrame) -> dict:
        """A segment of BLOCKS, a shard's by term."""
        name = f"s-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        blocks.sortWithinPartitions("term", "shard", "block").write.parquet(f"{at}/blocks")
        written = self.spark.read.parquet(f"{at}/blocks")
        written.filter(F.col("term") != DOCS).groupBy("term").agg(F.sum(F.size("ords")).alias("df")).sortWithinPartitions("term").write.parquet(f"{at}/terms")
        docs = written.filter(F.col("term") == DOCS).select(F.size("ords").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
        total = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
        return {"id": name, "docs": total.n, "tokens": total.t}

    def _shards(self, n: int, chars: int = 0) -> int:
        return max(1, -(-n // SHARD), -(-chars // SHARD_CHARS), min(self.spark.sparkContext.defaultParallelism, n // 1024))

    def _segment(self, docs: DataFrame, text: str, ord_col: str) -> dict:
        """Texts are shuffled once, by shard, tokenised there and made into the shard's blocks: what is moved are the texts, however
        many shards there are.
        """
        ready(self.spark)
        rows = docs.select(F.col(ord_col).cast("bigint").alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        dealt = rows.select(shard_of(F.col("ord"), self._shards(size.n, size.chars)).alias("shard"), "ord", "text").repartition("shard").sortWithinPartitions("shard")
        return self._write(dealt.select("shard", "ord", tokenize(F.col("text")).alias("tokens")).groupBy("shard").applyInArrow(counted_blocks(BLOCK), BLOCKS))

    def append(self, docs: DataFrame, text: str = "text", ord_col: str = "ord") -> SegmentIndex:
        """The version with docs added. Null texts count as empty: such documents have no postings, but count in the statistics.
        An ord that the index has already becomes a second document; replace() is for changed ones.
        """
        return self.commit([*self.segments, self._segment(docs, text, ord_col)], self.marks)

    def _with(self, gone: DataFrame, blocks: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """run of each shard's blocks and the documents of it that are gone: postings meet these where they are, as lists."""
        ready(self.spark)
        return blocks.groupBy("segment", "shard").cogroup(gone.select("segment", "shard", "ord").groupBy("segment", "shard")).applyInArrow(run, schema)

    def _mark(self, ords: DataFrame) -> dict:
        name = f"d-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        wanted = ords.select(F.col("ord").cast("bigint").alias("ord")).distinct()
        known = self.docs().join(wanted, "ord", "left_semi").join(self.deleted().select("segment", "ord"), ["segment", "ord"], "left_anti")
        known.select("segment", "shard", "ord", "doc_len").write.parquet(f"{at}/docs")
        gone = self.spark.read.parquet(f"{at}/docs")
        places = self.blocks().filter(F.col("term") != DOCS).join(gone.select("segment", "shard").distinct(), ["segment", "shard"], "left_semi")
        self._with(gone, places.select("segment", "shard", "term", "ords"), lost_terms, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{at}/terms")
        total = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")).first()
        return {"id": name, "docs": total.n, "tokens": total.t}

    def delete(self, ords: DataFrame) -> SegmentIndex:
        """The version without the documents of ords (ord). Unknown and deleted ones do no harm."""
        return self.commit(self.segments, [*self.marks, self._mark(ords)])

    def replace(self, docs: DataFrame, text: str = "text", ord_col: str = "ord") -> SegmentIndex:
        """The version with docs in place of the documents that have their ords, if any: both changes in one version."""
        mark = self._mark(docs.select(F.col(ord_col).alias("ord")))
        return self.commit([*self.segments, self._segment(docs, text, ord_col)], [*self.marks, mark])

    def merged(self) -> SegmentIndex:
        """The version with one segment and no marks: postings are dealt anew, no text is read again."""
        shards = self._shards(self.n_docs, round((self.avg_len or 0) * self.n_docs) * TOKEN_CHARS)
        lists = self._with(self.deleted(), self.blocks().select("segment", "shard", "term", "ords", "tfs", "lens"), live_lists, "term string, ords array<bigint>, tfs array<int>, lens array<int>")
        each = lists.select("term", F.explode(F.arrays_zip("ords", "tfs", "lens")).alias("p")).select("term", F.col("p.ords").alias("ord"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("doc_len"))
        return self.commit([self._write(posting_blocks(each.withColumn("shard", shard_of(F.col("ord"), shards))))], [])

    # --- search

    def weighted(self, queries: DataFrame) -> DataFrame:
        """(qid, term, idf) of the distinct terms of queries (qid, text) that the index has."""
        terms = stored(queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")))
        df = self.term_df(terms.select("term").distinct())
        return terms.join(df, "term").select("qid", "term", idf(F.lit(self.n_docs), F.col("df")).alias("idf"))

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, ord, score, rank) for queries (qid, text): the same rows as scoring everything. See lexical.bm25_search."""
        found = self._searched(queries, lambda shard, query: shard.best(query, top_k), ["ord bigint", "score double"])
        return ranked(found, top_k)

    def work(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, scored, postings): contributions that a search works out, and those that scoring everything would."""

        def count(shard: Shard, query: list[tuple[str, float]]) -> list[tuple[int, int]]:
            shard.scored = 0
            shard.best(query, top_k)
            return [(shard.scored, sum(shard.postings(t) for t, _ in query if t in shard.terms))]

        return self._searched(queries, count, ["scored bigint", "postings bigint"]).groupBy("qid").agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings"))

    def latency(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, seconds) that each query takes by itself, timed in the worker: of its shards, which work side by side, the slowest."""

        def timed(shard: Shard, query: list[tuple[str, float]]) -> list[tuple[float]]:
            began = time.perf_counter()
            shard.best(query, top_k)
            return [(time.perf_counter() - began,)]

        return self._searched(queries, timed, ["seconds double"]).groupBy("qid").agg(F.max("seconds").alias("seconds"))

    def _searched(self, queries: DataFrame, run: Callable, columns: list[str]) -> DataFrame:
        """What run gives for each query and shard. Weights go to the machines in blocks of TERM_ROWS or so; of the index only
        blocks of the queries' terms are read, and go to their shards.
        """
        spark, avg_len = self.spark, self.avg_len
        ready(spark)
        qid = queries.schema["qid"].dataType
        schema = ", ".join([f"qid {qid.simpleString()}", *columns])
        empty = spark.createDataFrame([], schema)
        if not avg_len:
            return empty
        weighted = stored(self.weighted(queries))
        blocks = max(1, -(-weighted.count() // TERM_ROWS))
        gone = self.deleted().select("segment", "shard", "ord")
        found = empty
        for k in range(blocks):
            part = weighted if blocks == 1 else weighted.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
            asked: dict = {}
            for r in sorted(part.collect(), key=lambda r: r.term):  # TERM_ROWS rows or so
                asked.setdefault(r.qid, []).append((r.term, r.idf))
            if not asked:
                continue
            each = answered(run, spark.sparkContext.broadcast(asked), avg_len, [f.name for f in empty.schema], [to_arrow_type(f.dataType) for f in empty.schema])
            terms = part.select("term").distinct()
            here = self.blocks()
            names = {t for query in asked.values() for t, _ in query}
            if len(names) <= PUSHED:
                here = here.filter(F.col("term").isin(*names))
            else:
                here = here.join(F.broadcast(terms), "term", "left_semi")
            own = here.groupBy("segment", "shard").cogroup(gone.groupBy("segment", "shard")).applyInArrow(each, schema)
            found = own if blocks == 1 else found.unionByName(own)
        return found
