"""Language identification by a byte convolutional network over fixed-length windows.

Filters of widths 2, 3 and 4 are max-pooled in each window and a softmax gives the window's languages; a document's
logits are the means of its windows'. It is trained in numpy on a bounded sample of documents with a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import CHUNK, Adam, Filters, chunks_of, softmax
from .common import crc_mod, ready, table, texts
from .labelled import sample

WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bounds of the training sample: documents, and characters in all.
SAMPLE, TOTAL = 2000, 24_000_000
STEPS, BATCH = 500, 64
UNKNOWN = "und"
LETTER = r"\p{L}"


@dataclass
class Model:
    languages: list[str]
    filters: Filters
    weights: np.ndarray
    bias: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return self.filters.pooled(rows) @ self.weights + self.bias

    def predict(self, whole: list[bytes]) -> np.ndarray:
        """Probabilities of the languages (n, languages)."""
        rows, counts = chunks_of(whole, self.filters.widest)
        starts = np.cumsum(counts) - counts
        return softmax(np.add.reduceat(self.logits(rows), starts, axis=0) / counts[:, None])


def fit(whole: list[str], langs: list[str], steps: int = STEPS, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs)) or [UNKNOWN]
    filters = Filters.random(WIDTHS, FILTERS, rng)
    model = Model(names, filters, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), dtype=np.float32))
    if len(names) < 2:
        return model
    rows, counts = chunks_of([t.encode() for t in whole], filters.widest)
    labels = np.repeat([names.index(x) for x in langs], counts)
    by_label = [np.flatnonzero(labels == k) for k in range(len(names))]
    adam = Adam([*filters.tables, model.weights, model.bias], rate=0.02, decay=1e-5)
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 1e-4
        picked = np.concatenate([rng.choice(at, BATCH // len(names) + 1) for at in by_label])
        part = rows[picked]
        places = filters.argmax(part)
        pooled = np.concatenate([np.maximum(v, 0) for _, v in places], axis=1)
        p = softmax(pooled @ model.weights + model.bias)
        p[np.arange(len(picked)), labels[picked]] -= 1
        p /= len(picked)
        adam.step([*filters.gradient(part, places, p @ model.weights.T), pooled.T @ p, p.sum(axis=0)])
    return model


def training_rows(docs: DataFrame, held_out: int = 1, of: int = 3) -> DataFrame:
    """Documents with text and language whose crc32 modulo `of` is not `held_out`: (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.filter(crc_mod(F.col("doc_id"), of) != held_out)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the probability of that language).

    A text that is null or has no letter is `und` with score 0. Whole texts are read; repeated rows and null ids are
    kept; further columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("lettered", F.col("text").rlike(LETTER))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang = np.full(len(batch), UNKNOWN, dtype=object)
            score = np.zeros(len(batch))
            whole = [t.encode() for t in batch["text"]]
            at = [i for i in np.flatnonzero(batch["lettered"].to_numpy())]
            for part in parts(at, whole):
                p = model.predict([whole[i] for i in part])
                lang[part], score[part] = np.array(model.languages, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": lang, "score": score})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def parts(at: list[int], whole: list[bytes], most: int = 1 << 20) -> Iterator[list[int]]:
    """Indices in runs of about a megabyte of text: bounded memory for batches of any size."""
    run, size = [], 0
    for i in at:
        if run and size + len(whole[i]) > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += max(CHUNK, len(whole[i]))
    if run:
        yield run


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*sample(training_rows(docs), "lang", SAMPLE, TOTAL))
    found = identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
