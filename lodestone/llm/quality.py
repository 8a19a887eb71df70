"""Text quality by a byte-level convolutional network over overlapping chunks of the whole document.

Filters are max-pooled in each chunk. A document is what its chunks' maxima have as mean, as largest and as smallest
value; a linear layer and a logistic function make one probability of it, all trained together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import Adam, Filters, chunks_of
from .common import crc_mod, ready, table, texts
from .labelled import labelled_sample
from .language_id import parts

WIDTHS = (1, 3, 5)
FILTERS = 8
#: Bytes of the next chunk that a chunk sees, too.
OVERLAP = 32
THRESHOLD = 0.3
#: Bounds of the training sample: documents, and characters in all.
SAMPLE, TOTAL = 3000, 24_000_000
#: Steps of training, documents of one, and chunks of a document that a step takes at first; the last LATE steps take all.
STEPS, BATCH, CHUNKS, LATE = 700, 32, 12, 60


@dataclass
class Model:
    filters: Filters
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, whole: list[bytes]) -> np.ndarray:
        rows, counts = chunks_of(whole, OVERLAP + 1)
        return 1 / (1 + np.exp(-np.clip(combined(self.filters.pooled(rows), counts) @ self.weights + self.bias[0], -30, 30)))


def combined(pooled: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(pooled, starts, axis=0) / counts[:, None]
    return np.concatenate([mean, np.maximum.reduceat(pooled, starts, axis=0), np.minimum.reduceat(pooled, starts, axis=0)], axis=1)


def spread(upper: np.ndarray, pooled: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The gradient of the chunks' maxima, from that of what they are combined to."""
    starts, n = np.cumsum(counts) - counts, pooled.shape[1]
    owner = np.repeat(np.arange(len(counts)), counts)
    grad = (upper[:, :n] / counts[:, None])[owner]
    for k, ufunc in ((1, np.maximum), (2, np.minimum)):
        at = pooled == ufunc.reduceat(pooled, starts, axis=0)[owner]
        ties = np.add.reduceat(at.astype(np.float32), starts, axis=0)
        grad += np.where(at, (upper[:, k * n : (k + 1) * n] / ties)[owner], 0)
    return grad


def fit(whole: list[str], labels: list[int], steps: int = STEPS, seed: int = 5) -> Model:
    """Both classes have the same weight in training, so scores are probabilities as if they were equally frequent."""
    rng = np.random.default_rng(seed)
    filters = Filters.random(WIDTHS, FILTERS, rng)
    model = Model(filters, rng.normal(0, 0.05, 3 * FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, dtype=np.float32))
    y = np.array(labels, dtype=np.float32)
    groups = [np.flatnonzero(y == k) for k in (0, 1)]
    if not all(map(len, groups)):
        model.weights[:] = 0
        model.bias[:] = 4 * (y.mean() - 0.5) if len(y) else 0
        return model
    rows, counts = chunks_of([t.encode() for t in whole], OVERLAP + 1)
    starts = np.cumsum(counts) - counts
    adam = Adam([*filters.tables, model.weights, model.bias], rate=0.02, decay=1e-4)
    for step in range(steps):
        adam.rate = 0.015 * (1 - step / steps) + 1e-4
        picked = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        # Long texts have other extremes than their parts: what is learnt last is learnt from whole texts.
        most = CHUNKS if step < steps - LATE else counts.max()
        own = [starts[d] + (np.arange(counts[d]) if counts[d] <= most else np.sort(rng.choice(counts[d], most, replace=False))) for d in picked]
        n = np.array([len(x) for x in own])
        part = rows[np.concatenate(own)]
        places = filters.argmax(part)
        pooled = np.concatenate([np.maximum(v, 0) for _, v in places], axis=1)
        seen = combined(pooled, n)
        g = ((1 / (1 + np.exp(-np.clip(seen @ model.weights + model.bias[0], -30, 30))) - y[picked]) / len(picked)).astype(np.float32)
        adam.step([*filters.gradient(part, places, spread(g[:, None] * model.weights, pooled, n)), seen.T @ g, g.sum(keepdims=True)])
    return model


def scores(model: Model, texts_of: pd.Series) -> np.ndarray:
    whole = [(t or "").encode() for t in texts_of]
    score = np.zeros(len(whole))
    for part in parts(list(range(len(whole))), whole):
        score[part] = model.predict([whole[i] for i in part])
    return score


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (probability of label 1), predicted (1 from the threshold on).

    A null text counts as empty, and empty texts are scored as one chunk of zero bytes. Whole texts are read;
    repeated rows and null ids are kept; further columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = scores(model, batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that classify() predicts 1 for. Only texts go to Python.

    A null text is scored as an empty one; repeated rows and rows with null ids are judged each by its text; columns of any
    name are kept; an empty table stays empty.
    """
    ready(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(model, batch))

    return docs.filter(score(F.col(text_col)) >= threshold)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled_sample(docs, labels, "quality", SAMPLE, TOTAL))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
