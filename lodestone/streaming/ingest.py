"""Streaming ingestion of pages or documents; an extension, as no event time is involved in building a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Each batch transformed and added to `out`; with a key, rows whose key is there already are left out.

    A batch that is run again after a failure writes its own folder anew, so that nothing is there twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = transform(batch)
        if key is not None:
            rows = rows.dropDuplicates([key])
            try:
                before = batch.sparkSession.read.parquet(out).filter(F.col("batch") != n)
                rows = rows.join(before.select(key), key, "left_anti")
            except Exception as e:  # the first batch finds no folder
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Pieces (ts, req_id, piece) counted per request and window, late ones up to `late`."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "req_id").agg(F.count(F.lit(1)).alias("n_tokens"))
