"""Toxicity by a counterfactually regularised classifier.

A document's logit is a bias and, for each distinct word, the positive part of the word's weight: harmless words add
nothing however many there are. A word's weight is the sum of those of its features, the word itself and its first
three to six letters. Training in numpy follows the labels, and for each text also counterfactuals: every identity term
in it is swapped for another one, or, where there is none, a neutral mention is put in; the squared change of the
logit is a penalty, so that naming a group moves no score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, ready, table, texts
from .labelled import labelled_sample

#: Identity terms whose exchange must not change a score.
IDENTITY_TERMS = """
woman women man men girl girls boy boys female females male males lady ladies mother mothers father fathers
gay gays lesbian lesbians bisexual bisexuals trans transgender transsexual queer straight heterosexual homosexual homosexuals nonbinary intersex asexual
black blacks white whites brown asian asians latino latinos latina hispanic hispanics arab arabs african africans european europeans american americans
mexican mexicans chinese japanese korean vietnamese indian indians pakistani russian russians german germans french spanish italian polish turkish irish
jewish jews jew muslim muslims islamic christian christians hindu hindus buddhist buddhists sikh atheist atheists catholic catholics protestant mormon
immigrant immigrants migrant migrants refugee refugees foreigner foreigners disabled deaf blind autistic elderly old young poor rich homeless teenagers veterans gypsy roma native indigenous
femme femmes homme hommes noir noirs noire juif juifs juive musulman musulmans musulmane arabe arabes étranger étrangers immigré immigrés réfugié réfugiés gays lesbiennes homosexuels
frau frauen mann männer schwarze schwarzen jude juden jüdisch muslimisch muslime ausländer flüchtling flüchtlinge einwanderer schwule lesben behinderte türken
mujer mujeres hombre hombres negro negros negra judío judíos musulmán musulmanes musulmana árabe árabes inmigrante inmigrantes extranjero extranjeros refugiados gitano gitanos
""".split()
WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 18
#: Bounds of the training sample: documents, and characters in all.
SAMPLE, TOTAL = 8000, 24_000_000
#: Words whose weights a worker keeps; beyond that it starts afresh.
KEPT = 400_000


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n)]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return max(0.0, float(self.weights[features(word)].sum()))

    def logit(self, words: set[str]) -> float:
        return self.bias + sum(map(self.word, words))


class Words(dict):
    """The positive parts of the weights of the words met so far; words without any count as None."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights = model.weights.tolist()

    def __missing__(self, word: str) -> float | None:
        if len(self) >= KEPT:
            self.clear()
        weights = self.weights
        total = sum([weights[i] for i in features(word)])
        self[word] = found = total if total > 0 else None
        return found

    def logit(self, bias: float, words: set[str]) -> float:
        return math.fsum([bias, *filter(None, map(self.__getitem__, words))])


def fit(sample: list[str], labels: list[int], epochs: int = 15, negatives: float = 3, rate: float = 0.1, shrink: float = 3e-4, penalty: float = 0.5, seed: int = 3) -> Model:
    """Stochastic gradient steps; each epoch takes all texts of label 1 and `negatives` times as many of the others.
    Weights shrink towards 0 with each use.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=float)
    positive = float(y.sum())
    if not 0 < positive < len(y):
        return Model(np.zeros(SLOTS, dtype=np.float32), 4 * float(positive > 0) - 2)
    known: dict[str, int] = {}
    owned: list[int] = []
    spans: list[tuple[int, int]] = []
    words = [sorted(words_of(t)) for t in sample]
    for word in (*IDENTITY_TERMS, *(w for ws in words for w in ws)):
        if word not in known:
            known[word] = len(known)
            f = features(word)
            spans.append((len(owned), len(f)))
            owned += f
    flat, starts = np.array(owned), np.array([s for s, _ in spans])
    lengths = np.array([n for _, n in spans])
    ids = [np.array([known[w] for w in ws], dtype=np.int64) for ws in words]
    terms = np.arange(len(IDENTITY_TERMS))
    theta, bias = np.zeros(SLOTS), -1.0
    theta[flat] = 0.002

    def lookup(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the words' features, their word, and the words' weights."""
        n = lengths[which]
        owner = np.repeat(np.arange(len(which)), n)
        at = flat[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return at, owner, np.bincount(owner, theta[at], minlength=len(which))

    toxic, other_texts = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    for epoch in range(epochs):
        step = rate / (1 + 0.5 * epoch)
        some = rng.permutation(other_texts)[: int(negatives * len(toxic)) + 1]
        for d in rng.permutation(np.concatenate([toxic, some])):
            if len(which := ids[d]):
                at, owner, u = lookup(which)
                z = bias + u[u > 0].sum()
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]
                live = u[owner] > 0
                used, n = np.unique(at[live], return_counts=True)
                theta[used] -= step * g * np.minimum(n, 3)
                theta[at] = np.sign(theta[at]) * np.maximum(np.abs(theta[at]) - step * shrink, 0)
            else:
                g = 1 / (1 + np.exp(-bias)) - y[d]
            bias -= step * g
            # Each identity term of the text is swapped for another; a text without any gets a neutral mention.
            present = which[which < len(terms)]
            for here in present.tolist() or [None]:
                other = int(rng.choice(terms))
                pair = np.array([other] if here is None else [here, other])
                at, owner, u = lookup(pair)
                change = max(u[0], 0) - (max(u[1], 0) if here is not None else 0)
                if change and here != other:
                    sign = np.where(owner == 0, 1.0, -1.0) * (u[owner] > 0)
                    np.subtract.at(theta, at, np.clip(step * penalty * 2 * change, -0.05, 0.05) * sign)
    return Model(theta.astype(np.float32), float(bias))


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score (probability of label 1), predicted (1 from the threshold on).

    A null text counts as empty; an empty text has the bias as its logit. Whole texts are read; repeated rows and
    null ids are kept; further columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    slots = np.flatnonzero(model.weights)
    values, bias = model.weights[slots], model.bias

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(SLOTS, dtype=np.float32)
        weights[slots] = values
        words = Words(Model(weights, bias))
        for batch in batches:
            z = np.array([words.logit(bias, words_of(t)) for t in batch["text"]], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE, TOTAL))
    return score_texts(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
