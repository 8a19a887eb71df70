"""Sources and sinks: pages and their manifest, corpora, questions, indexes and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import CHUNK, COLUMNS
from ..operators.dense import normalised
from ..operators.evaluate import must_include_groups

#: What the start of a page says that was refused, and how far it is looked for.
REFUSED, REFUSED_WITHIN = "Access Denied", 500
QUESTION = "id string, question string, lang string, type string, gold_docs array<string>, must_include string, must_refuse boolean"
MANIFEST = "map<string, struct<url:string, fetched_at:string, bytes:bigint, status:int>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Cached pages: Parquet (page_id, url, html), or a folder of HTML files with their paths as ids."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("page_id"), F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def accepted(pages: DataFrame) -> DataFrame:
    """Pages that are not a refusal."""
    return pages.filter(~F.contains(F.substring(F.coalesce("html", F.lit("")), 1, REFUSED_WITHIN), F.lit(REFUSED)))


def not_cached(pages: DataFrame, cached: DataFrame, key: str = "page_id", force: bool = False) -> DataFrame:
    return pages if force else pages.join(cached.select(key), key, "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, fetched_at, bytes, status) of a JSON object of pages."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))
    rows = whole.select(F.explode("m").alias("key", "v")).select("key", "v.*")
    return rows.withColumn("fetched_at", F.try_to_timestamp("fetched_at"))


def cache_status(sources: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Each source with whether, when and at what size it was fetched."""
    known = manifest.select(key, "fetched_at", "bytes", F.lit(True).alias("cached"))
    return sources.join(known, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped, unknown fields dropped, missing ones get their defaults."""
    rows = spark.read.schema(CHUNK).json(path)
    defaults = {"key_zh": F.lit(""), "key_en": F.lit(""), "lang": F.lit("bi"), "source": F.lit(""), "meta": F.create_map().cast("map<string,string>")}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}).select(*COLUMNS)


def write_corpus(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    """Chunks as JSON lines in UTF-8, or as Parquet."""
    chunks.select(*COLUMNS).write.mode("overwrite").format(fmt).save(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, lang, type, gold_docs, must_include array<array<string>>, must_refuse) of JSON lines."""
    raw = spark.read.schema("value string").text(path).filter(F.trim("value") != "")
    v = F.parse_json("value")
    include = F.coalesce(F.to_json(F.variant_get(v, "$.must_include", "variant")), F.lit("[]"))
    rows = raw.select(F.from_json("value", QUESTION).alias("q"), must_include_groups(include).alias("must_include"))
    empty = F.array().cast("array<string>")
    return rows.select(F.col("q.id").alias("qid"), F.col("q.question").alias("text"), "q.lang", "q.type", F.coalesce("q.gold_docs", empty).alias("gold_docs"), "must_include", F.coalesce("q.must_refuse", F.lit(False)).alias("must_refuse"))


def save_index(vectors: DataFrame, path: str, model: str, dim: int) -> None:
    """Vectors (ord, v), normalised, and one row on the model they are of."""
    vectors.select("ord", normalised(F.col("v")).alias("v")).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(model, dim)], "embed_model string, dim int").write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The vectors; raises if they are of another model than the one that questions will be embedded with."""
    of = spark.read.parquet(f"{path}/meta").first().embed_model
    if model is not None and of != model:
        raise ValueError(f"the index is of {of}, not of {model}: build it again")
    return spark.read.parquet(f"{path}/vectors")


def check_index(vectors: DataFrame, chunks: DataFrame) -> None:
    """Raises unless every chunk has a vector and every vector a chunk."""
    odd = vectors.select("ord").join(chunks.select(F.col("ord").alias("o")), F.col("ord") == F.col("o"), "full").filter("ord IS NULL OR o IS NULL")
    if not odd.isEmpty():
        raise ValueError("index and corpus don't match: build the index again")


def save_results(results: DataFrame, path: str) -> None:
    """JSON lines in a folder, a file for each task."""
    results.write.mode("overwrite").json(path)
