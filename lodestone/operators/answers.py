"""Asking models for many answers: some requests at once in a task, made again where that may help, timed, and kept by what was asked."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop, ready

#: Answers of a server after which it is asked again.
AGAIN = {408, 425, 429, 500, 502, 503, 504}
ANSWERS = "digest string, answer string, error string"
PIECES = "seq int, t double, piece string, t0 double, t_end double"
#: What asks a model: messages to the pieces of its answer. A `load` makes it once for each task.
Ask = Callable[[list[dict[str, str]]], Iterable[str]]


@dataclass
class Patience:
    """Requests at once in a task, requests for an answer at most, and seconds before the second one, doubled for each after that."""

    at_once: int = 8
    attempts: int = 4
    pause: float = 0.5
    longest_pause: float = 30.0

    def timed(self, ask: Ask, messages: list[dict[str, str]]) -> tuple[float, list[tuple[float, str]], float]:
        """When it was asked first, the pieces with their times, and when it was done. What was said before a failure is dropped."""
        t0 = time.time()
        for attempt in range(self.attempts):
            try:
                said = [(time.time(), piece) for piece in ask(messages)]
                return t0, said, time.time()
            except (OSError, http.client.HTTPException) as e:
                if attempt + 1 == self.attempts or (isinstance(e, urllib.error.HTTPError) and e.code not in AGAIN):
                    raise
                time.sleep(min(self.longest_pause, self.pause * 2**attempt))
        raise ValueError("no attempts")

    def over(self, ask: Ask, asked: Iterable[list[dict[str, str]]]) -> Iterator[tuple[float, list[tuple[float, str]], float] | Exception]:
        """timed() of each, in order; what could not be had is the error."""

        def one(messages: list[dict[str, str]]):
            try:
                return self.timed(ask, messages)
            except (OSError, http.client.HTTPException) as e:
                return e

        with ThreadPoolExecutor(self.at_once) as pool:
            yield from pool.map(one, asked)


def plain_messages(messages) -> list[dict[str, str]]:
    return [{"role": m["role"], "content": m["content"]} for m in messages]


def timed_pieces(prompts: DataFrame, load: Callable[[], Ask], patience: Patience | None = None) -> DataFrame:
    """(req_id, PIECES) for prompts (qid, messages): what stream_stats reads; a request without any piece has one without a text.
    Times are those of the request itself, taken where it is made. An answer that can't be had is an error.
    """
    patience = patience or Patience(at_once=1)
    ready(prompts.sparkSession)
    rows = prompts.select("qid", "messages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for batch in batches:
            out = []
            for qid, got in zip(batch["qid"].tolist(), patience.over(ask, map(plain_messages, batch["messages"])), strict=True):
                if isinstance(got, Exception):
                    raise got
                t0, said, t_end = got
                out += [(qid, k, t, piece, t0, t_end) for k, (t, piece) in enumerate(said or [(t_end, "")])]
            yield pd.DataFrame(out, columns=["req_id", "seq", "t", "piece", "t0", "t_end"])

    return rows.mapInPandas(run, f"req_id {rows.schema['qid'].dataType.simpleString()}, {PIECES}")


def answers_of(pieces: DataFrame) -> DataFrame:
    """(req_id, answer): the pieces in order."""
    told = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return pieces.groupBy("req_id").agg(F.array_join(F.transform(told, lambda p: p["piece"]), "").alias("answer"))


class KeptAnswers:
    """A generator whose answers are kept in a folder by a digest of what was asked of whom.

    Prompts that have an answer there are not asked again, in this run or another. A task's answers are committed when the
    task ends, whatever becomes of the job: an executor that is lost takes no more than its unfinished tasks along, of per_task
    prompts each. Prompts that are equal are asked once.
    """

    def __init__(self, name: str, load: Callable[[], Ask], path: str, options: dict | None = None, patience: Patience | None = None, per_task: int = 64):
        self.name, self.load, self.path, self.options = name, load, path.rstrip("/"), options or {}
        self.patience, self.per_task = patience or Patience(), per_task

    def digest(self, messages: Column) -> Column:
        return F.sha2(F.concat_ws("\n", F.lit(self.name), F.lit(json.dumps(self.options, sort_keys=True)), F.to_json(messages)), 256)

    def kept(self, spark: SparkSession) -> DataFrame:
        """(digest, answer) of all that was answered."""
        where, files = hadoop(spark, f"{self.path}/answers")
        if not files.exists(where):
            return spark.createDataFrame([], "digest string, answer string")
        return spark.read.schema(ANSWERS).parquet(f"{self.path}/answers").filter("answer IS NOT NULL").groupBy("digest").agg(F.min("answer").alias("answer"))

    def ask(self, prompts: DataFrame) -> int:
        """Ask what has no answer yet; the number of prompts that have none after that."""
        spark = prompts.sparkSession
        ready(spark)
        wanted = prompts.select(self.digest(F.col("messages")).alias("digest"), "messages").dropDuplicates(["digest"])
        missing = lambda: wanted.join(self.kept(spark), "digest", "left_anti")
        n = missing().count()
        if not n:
            return 0
        load, patience = self.load, self.patience

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = load()
            for batch in batches:
                got = list(patience.over(ask, map(plain_messages, batch["messages"])))
                said = [None if isinstance(g, Exception) else "".join(piece for _, piece in g[1]) for g in got]
                errors = [f"{type(g).__name__}: {g}" if isinstance(g, Exception) else None for g in got]
                yield pd.DataFrame({"digest": batch["digest"], "answer": said, "error": errors})

        dealt = missing().repartition(-(-n // self.per_task), "digest")
        # By this way of committing, the files of a task that has ended stay, whatever becomes of the others.
        dealt.mapInPandas(run, ANSWERS).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/answers")
        return missing().count()

    def answer(self, prompts: DataFrame) -> DataFrame:
        """prompts with the column answer. RuntimeError if some have none: those that were had are kept, and a second run asks for
        the others only.
        """
        if left := self.ask(prompts):
            raise RuntimeError(f"{left} prompts have no answer yet; what was answered is kept in {self.path}: run again")
        keyed = prompts.withColumn("_digest", self.digest(F.col("messages")))
        return keyed.join(self.kept(prompts.sparkSession).withColumnRenamed("digest", "_digest"), "_digest").drop("_digest")
