"""A corpus that is kept up to date: only pages that changed are parsed, and only their chunks, vectors and postings replaced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import CHUNK, COLUMNS
from ..operators.dense import Embedder, embed_corpus
from ..operators.segments import SegmentIndex
from ..sources.shared import hadoop, scratch, stored
from .retrieval import Retriever, build_corpora

#: Parts that pages are dealt to; a part is written anew if one of its pages changed.
BUCKETS = 64
#: Chunks of a page at most: ord is the page's id times this, and the chunk's place in its page.
PLACES = 1 << 20
KINDS = ("spec_zh", "spec_en", "feature_zh", "feature_en")


def bucket_of(page_id: Column) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(BUCKETS)).cast("int")


def page_digests(pages: dict[str, DataFrame], products: DataFrame) -> DataFrame:
    """(page_id, digest) of all that a product's chunks come from: its name and its pages."""
    parts = products.select("page_id", F.lit("product").alias("kind"), F.md5(F.col("product").cast("binary")).alias("d"))
    for kind, df in pages.items():
        parts = parts.unionByName(df.select("page_id", F.lit(kind).alias("kind"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("d")))
    return parts.groupBy("page_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "d")))), 256).alias("digest"))


@dataclass
class KeptCorpus:
    """A folder of digests, of chunks and vectors by bucket, and of a lexical index. Pages have ids of type bigint."""

    spark: SparkSession
    path: str
    embedder: Embedder | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        where, files = hadoop(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if files.exists(where) else self.spark.createDataFrame([], schema)

    def digests(self) -> DataFrame:
        return self._table("digests", "page_id bigint, digest string")

    def chunks(self) -> DataFrame:
        """CHUNK, page_id and bucket; ord rises through a page's chunks, and pages."""
        return self._table("chunks", f"{CHUNK}, page_id bigint, bucket int")

    def vectors(self) -> DataFrame:
        return self._table("vectors", "ord bigint, v array<double>, page_id bigint, bucket int")

    def changes(self, pages: dict[str, DataFrame], products: DataFrame) -> DataFrame:
        """(page_id, digest) of the pages to be parsed, and those that are gone, whose digest is null."""
        new, old = page_digests(pages, products), self.digests().withColumnRenamed("digest", "was")
        return new.join(old, "page_id", "full").filter(~F.col("digest").eqNullSafe(F.col("was"))).select("page_id", "digest")

    def _overwrite(self, name: str, kept: DataFrame, fresh: DataFrame, buckets: DataFrame) -> None:
        """The buckets' rows: those of pages that stay and the fresh ones; a bucket without any is deleted."""
        rows = stored(kept.unionByName(fresh))  # what is read here is written over next
        rows.repartition("bucket").sortWithinPartitions("ord").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        for r in buckets.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect():  # BUCKETS at most
            where, files = hadoop(self.spark, f"{self.path}/{name}/bucket={r.bucket}")
            files.delete(where, True)

    def update(self, pages: dict[str, DataFrame], products: DataFrame, validate: bool = True, markers: tuple[str, ...] = ()) -> dict[str, int]:
        """Bring all up to date with pages (kind to page_id, html) and products (page_id, product); how many pages were built and
        taken out. Digests are written last: an update that fails on its way is done again by the next one.
        """
        with scratch():
            changes = stored(self.changes(pages, products))
            built, gone = changes.filter("digest IS NOT NULL").count(), changes.filter("digest IS NULL").count()
            if not built and not gone:
                return {"built": 0, "gone": 0}
            wanted = changes.filter("digest IS NOT NULL").select("page_id")
            mine = {kind: stored(df.select("page_id", "html").join(wanted, "page_id", "left_semi")) for kind, df in pages.items()}
            made = build_corpora(mine["spec_zh"], mine["spec_en"], products.join(wanted, "page_id", "left_semi"), mine.get("feature_zh"), mine.get("feature_en"), validate, markers)
            first = made.groupBy("page_id").agg(F.min("ord").alias("first"))
            fresh = made.join(first, "page_id").withColumn("ord", F.col("page_id") * PLACES + F.col("ord") - F.col("first"))
            fresh = stored(fresh.select(*COLUMNS, "page_id", bucket_of(F.col("page_id")).alias("bucket")))
            buckets = stored(changes.select(bucket_of(F.col("page_id")).alias("bucket")).distinct())
            stays = lambda df: df.join(F.broadcast(buckets), "bucket", "left_semi").join(changes.select("page_id"), "page_id", "left_anti")
            old = stored(self.chunks().join(F.broadcast(buckets), "bucket", "left_semi").join(changes.select("page_id"), "page_id", "left_semi").select("ord"))
            self._overwrite("chunks", stays(self.chunks()).select(*COLUMNS, "page_id", "bucket"), fresh, buckets)
            if self.embedder is not None:
                v = embed_corpus(fresh, self.embedder).join(fresh.select("ord", "page_id", "bucket"), "ord")
                self._overwrite("vectors", stays(self.vectors()).select("ord", "v", "page_id", "bucket"), v, buckets)
            at = f"{self.path}/lexical"
            index = SegmentIndex.open(self.spark, at) if SegmentIndex.exists(self.spark, at) else SegmentIndex.create(self.spark, at)
            index.delete(old).replace(fresh)
            # All digests are read before any is written over.
            now = stored(self.digests().join(changes.select("page_id"), "page_id", "left_anti").unionByName(changes.filter("digest IS NOT NULL")))
            now.write.mode("overwrite").parquet(f"{self.path}/digests")
        return {"built": built, "gone": gone}

    def retriever(self, mode: str = "hybrid") -> Retriever:
        vectors = self.vectors().select("ord", "v") if self.embedder is not None else None
        return Retriever(self.chunks(), SegmentIndex.open(self.spark, f"{self.path}/lexical"), vectors, self.embedder, mode if vectors is not None else "bm25")
