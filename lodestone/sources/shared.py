"""Intermediate tables in a folder that all machines share, and small inputs dealt to all cores."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes below which a table is taken to lie in a row group or two, which no more tasks than that can read.
SMALL = 64 << 20
#: Bytes of a part that such a table is dealt to, unless there are more cores.
PART = 128 << 10


def ready(spark: SparkSession) -> None:
    """Let Python workers import this library wherever the driver was started."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, one of our own, but only if the master is
    local: on a cluster executors would write to their own disks.
    """
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop knows them."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replaced_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and renamed there, over an older one: readers see the one or the other, whole."""
    jvm = spark.sparkContext._jvm
    draft, files = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    where, _ = hadoop(spark, path)
    out = files.create(draft, False)
    out.write(text.encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(draft), files.makeQualified(where), how)


#: Tables that stored() wrote since the innermost scratch() began.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A span whose stored tables are deleted when it ends, but for those given to the function that it yields.

    What is returned must read none of the others any more: only tables that were kept, and no lazy plan over the rest.
    """
    outer, made, kept = _SCRATCH.get(), [], set()
    token = _SCRATCH.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for df in made:
            if df.stored_at not in kept:
                dropped(df)
            elif outer is not None:
                outer.append(df)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it.

    The files go when the driver's JVM ends, by dropped(), or at the end of the scratch() that they are made in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    hadoop_path, files = hadoop(spark, path)
    files.deleteOnExit(hadoop_path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    if (made := _SCRATCH.get()) is not None:
        made.append(back)
    return back


def dropped(df: DataFrame) -> None:
    """Delete the files of a DataFrame that stored() returned and that nothing reads any more."""
    hadoop_path, files = hadoop(df.sparkSession, df.stored_at)
    files.delete(hadoop_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One of less than SMALL bytes, in which a task or two would read all, is dealt to all cores
    first, or to as many parts as shuffles have, if these are not too small; larger ones are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART))
    return df.repartition(parts) if (1 << 16) < size < SMALL else df
