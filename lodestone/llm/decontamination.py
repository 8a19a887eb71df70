"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of 64 words, each overlapping the next by half. Their TF-IDF vectors over the
benchmark's words (words of no item can't make a passage like one), with those of the items themselves as further
passages of some weight and each word alone as some more, make a matrix A. One pass over the corpus gives the document
frequencies and A'(A Omega) for a random Omega, from which the driver has the leading singular values and right vectors of
A. Passages and items are compared in that space, each direction divided by its singular value, by cosine; what comes near
is checked by its longest common subsequence with the item and by the item's answer, so that paraphrases count and shared
phrases don't.

A leak has more than half of an item's words, so it has one of the item's rarer words at least: the search works out the
vectors of passages near such words only, which loses none.

Words stand for rows of the matrix by a hash, ROWS at most, so that the matrices that go to the machines or to the driver
have a bound whatever the number of items. One pass over the corpus serves all items; a second one searches for ITEMS items
at a time.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, stored, table, texts

#: Words of half a passage.
HALF = 32
#: Dimensions of the latent space, and rows of the matrix: 64 MB at most.
RANK, ROWS = 256, 1 << 16
#: Values of the hash of words that rows are given out for.
HASHES = 1 << 20
#: Weight of all items against all passages, the power of the eigenvalues of A'A that directions are divided by, and the
#: number of passages that each word makes by itself: a few real passages then bend the space little.
ITEM_WEIGHT, WHITEN, ALONE = 9.0, 0.5, 64.0
#: Cosine of a candidate for items of so many words or more; shorter ones are a smaller part of a passage, and so of its vector.
COSINE, FULL = 0.4, 32
#: A document holds an item from COPY on, or from REWORDED on if so much of the answer is there too.
COPY, REWORDED, ANSWERED = 0.75, 0.55, 0.8
#: Words of an item's answer where no column gives one: its rarest.
ANSWER_WORDS = 5
#: Words of an item that are looked for as one, items of one search of the corpus, and of one product of matrices.
LONGEST, ITEMS, TOGETHER = 60, 20_000, 2000
#: Characters of text that are worked on at once: their matrices then stay in the processor's cache.
RUN = 1 << 13
#: Terms of a slice when sums are moved.
SLICE = 64
#: Words of the benchmark that a worker holds as such; of a larger benchmark it holds 8 bytes of a second digest for each word,
#: and the rows of so many words that it has met.
KEPT = 400_000

SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str) -> list[bytes]:
    """Lower-case words between white space and ASCII punctuation."""
    return text.lower().encode().translate(SPACES).split()


@dataclass
class Item:
    """A part of a benchmark item: its words, those of the whole item's answer, and the whole item's number of words."""

    owner: object
    words: list[bytes]
    answer: list[bytes] | None
    whole: int


def parts_of(rows: list[tuple]) -> list[Item]:
    """The items (item_id, text, answer), long ones in parts of about equal length."""
    out = []
    for item_id, text, answer in rows:
        words = words_of(text or "")
        n = -(-len(words) // LONGEST)
        said = words_of(answer) if answer else None
        out += [Item(item_id, words[k * len(words) // n : (k + 1) * len(words) // n], said or None, len(words)) for k in range(n)]
    return out


def hashed(word: bytes) -> int:
    return zlib.crc32(word) % HASHES


def digest(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


class Rows(dict):
    """The rows of the words met so far; -1 for words that no item has, whatever their hash: digests tell them apart."""

    def __init__(self, place: np.ndarray, digests: np.ndarray):
        super().__init__()
        self.place, self.digests = place, digests

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        row = int(self.place[hashed(word)])
        if row >= 0:
            own = np.uint64(digest(word))
            at = int(np.searchsorted(self.digests, own))
            row = row if at < len(self.digests) and self.digests[at] == own else -1
        self[word] = row
        return row


@dataclass
class Vocabulary:
    """The row of each hash that a word of an item has (else -1), the number of rows, and the words if they are few enough, or
    else their digests in order.
    """

    place: np.ndarray
    size: int
    words: dict[bytes, int] | None
    digests: np.ndarray

    @classmethod
    def of(cls, items: list[Item]) -> Vocabulary:
        place, words = np.full(HASHES, -1, dtype=np.int32), {w for item in items for w in item.words}
        used = sorted({hashed(w) for w in words})
        place[used] = np.arange(len(used)) % ROWS
        few = len(words) <= KEPT
        digests = np.zeros(0, np.uint64) if few else np.sort(np.fromiter(map(digest, words), np.uint64, len(words)))
        return cls(place, min(len(used), ROWS), {w: int(place[hashed(w)]) for w in words} if few else None, digests)

    def rows(self, words: list[bytes]) -> np.ndarray:
        return self.place[[hashed(w) for w in words]]


class Corpus:
    """Texts as arrays of benchmark words."""

    def __init__(self, vocabulary: Vocabulary):
        self.known, self.rows = vocabulary.words, Rows(vocabulary.place, vocabulary.digests)

    def read(self, whole: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; number of halves of each; and, for words of items, half and row."""
        words = [words_of(t) for t in whole]
        lengths = [len(ws) for ws in words]
        flat = chain.from_iterable(words)
        found = map(self.rows.__getitem__, flat) if self.known is None else map(self.known.get, flat, repeat(-1))
        rows = np.fromiter(found, dtype=np.int32, count=sum(lengths))
        n = np.array(lengths, dtype=np.int64)
        halves = np.maximum(1, -(-n // HALF))
        known = np.flatnonzero(rows >= 0)
        starts, first = np.cumsum(n) - n, np.cumsum(halves) - halves
        text = np.searchsorted(starts, known, side="right") - 1
        return words, halves, (known - starts[text]) // HALF + first[text], rows[known]


def counted(at: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are met, and how often each is in each of n halves (n, rows met)."""
    used, place = np.unique(terms, return_inverse=True)
    return used, np.bincount(at * len(used) + place, minlength=n * len(used)).astype(np.float32).reshape(n, len(used))


def neighbourhoods(halves_sum: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """For each half, the sum of the passages that it is part of: its own and the one before."""
    first, last = np.cumsum(halves) - halves, np.cumsum(halves) - 1
    out = halves_sum * 2
    out[first] -= halves_sum[first]
    up, down = halves_sum[1:].copy(), halves_sum[:-1].copy()
    up[last[:-1]] = 0
    down[last[:-1]] = 0
    out[:-1] += up
    out[1:] += down
    return out


def runs_of(whole: list[str], most: int = RUN) -> Iterator[slice]:
    at = 0
    while at < len(whole):
        end, size = at, 0
        while end < len(whole) and (end == at or size + len(whole[end]) <= most):
            size += len(whole[end])
            end += 1
        yield slice(at, end)
        at = end


@dataclass
class Space:
    """The vocabulary, weights of the rows, and their latent vectors scaled by these: 70 MB at most beside the words."""

    vocabulary: Vocabulary
    idf: np.ndarray
    latent: np.ndarray

    def vectors(self, items: list[Item]) -> np.ndarray:
        """The items' own vectors, of length 1."""
        found = np.array([self.latent[self.vocabulary.rows(item.words)].sum(axis=0) for item in items])
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def weights(n: int, held: np.ndarray) -> np.ndarray:
    """Common words weigh little, and none weighs nothing."""
    return np.maximum(np.log((1 + n) / (1 + held)), 0.05).astype(np.float32)


def random_rows(size: int, rank: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, rank), dtype=np.float32)


def sketch(rows: DataFrame, vocabulary: Vocabulary, rank: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of half passages, of those that hold each row's words, and P'(P G) for the passages' counts P, without
    weights, and a random matrix G.
    """
    size = vocabulary.size
    slices = -(-size // SLICE)
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus, start, n = Corpus(sent.value), random_rows(size, rank), 0
        total, held = np.zeros((slices * SLICE, rank), dtype=np.float32), np.zeros(slices * SLICE, dtype=np.int64)
        for batch in batches:
            whole = batch["text"].tolist()
            for part in runs_of(whole):
                _, halves, at, terms = corpus.read(whole[part])
                n += int(halves.sum())
                if len(terms):
                    used, counts = counted(at, terms, int(halves.sum()))
                    total[used] += counts.T @ neighbourhoods(counts @ start[used], halves)
                    held[used] += np.count_nonzero(counts, axis=0)
        data, held = total.reshape(slices, SLICE * rank), held.reshape(slices, SLICE)
        yield pd.DataFrame({"slice": np.arange(-1, slices, dtype=np.int32), "held": [np.array([n]).tobytes()] + [x.tobytes() for x in held], "data": [b""] + [x.tobytes() for x in data]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, held, data in zip(batch["slice"], batch["held"], batch["data"], strict=True):
                n, x = sums.get(k, (0, 0))
                sums[k] = n + np.frombuffer(held, dtype=np.int64), x + np.frombuffer(data, dtype=np.float32).astype(np.float64)
        yield pd.DataFrame({"slice": np.array(list(sums), dtype=np.int32), "held": [n.tobytes() for n, _ in sums.values()], "data": [x.astype(np.float32).tobytes() for _, x in sums.values()]})

    kinds = "slice int, held binary, data binary"
    sums = rows.select("text").mapInPandas(run, kinds).repartition(min(slices + 1, 64), "slice").mapInPandas(add, kinds)
    n, held, y = 0, np.zeros((slices, SLICE), dtype=np.int64), np.zeros((slices, SLICE * rank))
    for r in sums.toLocalIterator():  # ROWS times `rank` numbers at most
        if r.slice < 0:
            n += int(np.frombuffer(r.held, dtype=np.int64)[0])
        else:
            held[r.slice] += np.frombuffer(r.held, dtype=np.int64)
            y[r.slice] += np.frombuffer(r.data, dtype=np.float32)
    return n, held.ravel()[:size], y.reshape(-1, rank)[:size]


def directions(vocabulary: Vocabulary, items: list[Item], idf: np.ndarray, n: int, pp: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of A, whitened: (rows, rank), from pp = P'(P G).

    With D for the weights, A = P D and Omega = G / D, so A'(A Omega) is D P'(P G): the weights need not be known before the
    pass. With Y = A'A Omega and Q a basis of its range, Q'A'A Q follows from Q'Y and Q'Omega, so one pass is enough.
    """
    rank = pp.shape[1]
    start = random_rows(len(idf), rank) / idf[:, None]
    y = pp * idf[:, None]
    scale = np.sqrt(ITEM_WEIGHT * n / len(items))
    for item in items:
        at = vocabulary.rows(item.words)
        weight = idf[at] * (scale / np.linalg.norm(idf[at]))
        np.add.at(y, at, weight[:, None] * (weight @ start[at]))
    y += ALONE * idf[:, None] ** 2 * start
    q = np.linalg.qr(y)[0]
    core = np.linalg.lstsq((q.T @ start).T, (q.T @ y).T, rcond=None)[0]
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return (q @ vectors * np.maximum(values, 1e-6 * values.max()) ** -WHITEN).astype(np.float32)


def fit(rows: DataFrame, items: list[Item], rank: int = RANK) -> Space | None:
    """The latent space of the corpus, one for all items; None if it or the benchmark has no words."""
    if not items:
        return None
    vocabulary = Vocabulary.of(items)
    n, held, pp = sketch(rows, vocabulary, min(rank, vocabulary.size))
    if not n or not held.any():
        return None
    idf = weights(n, held)
    return Space(vocabulary, idf, directions(vocabulary, items, idf, n, pp) * idf[:, None])


def common_subsequence(masks: dict, length: int, words: list) -> int:
    """Length of the longest common subsequence; masks has, for each word of the item, the bits of its places."""
    row, full = (1 << length) - 1, (1 << length) - 1
    for w in words:
        if mask := masks.get(w):
            u = row & mask
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


class Checker:
    """Looks for items in texts."""

    def __init__(self, items: list[Item], space: Space):
        self.items, self.space = items, space
        self.vectors = space.vectors(items)
        lengths = np.array([len(item.words) for item in items])
        self.least = (COSINE * np.sqrt(np.minimum(lengths / FULL, 1))).astype(np.float32)
        self.masks, self.answers = [], []
        #: Rows of words of which a leak has one at least: an item's rarest places, one more than a leak may lack.
        self.telling = np.zeros(space.vocabulary.size, dtype=bool)
        for item in items:
            masks: dict[bytes, int] = {}
            for k, w in enumerate(item.words):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
            weight = space.idf[space.vocabulary.rows(item.words)]
            order = sorted(range(len(item.words)), key=lambda k: (-weight[k], item.words[k]))
            lacking = len(item.words) - math.ceil(REWORDED * len(item.words) - 1e-9)
            self.telling[space.vocabulary.rows([item.words[k] for k in order[: lacking + 1]])] = True
            self.answers.append(set(item.answer or list(dict.fromkeys(item.words[k] for k in order))[:ANSWER_WORDS]))

    def check(self, words: list[bytes], half: int, k: int) -> tuple[float, float]:
        """Share of the item's words in the common subsequence with the passage and its surroundings, and of its answer's
        words there; the answer of an item in parts may be as far off as the item is long.
        """
        length, whole = len(self.items[k].words), self.items[k].whole
        near = words[max(0, half * HALF - length) : (half + 2) * HALF + length]
        wide = near if whole == length else words[max(0, half * HALF - whole) : (half + 2) * HALF + whole]
        return common_subsequence(self.masks[k], length, near) / length, len(self.answers[k].intersection(wide)) / len(self.answers[k])

    def leaks(self, whole: list[str], corpus: Corpus) -> list[tuple]:
        """(text, item_id, cosine, lcs, answer) of the leaks in these texts, the best of each text and item."""
        words, halves, at, terms = corpus.read(whole)
        first = np.cumsum(halves) - halves
        owner = np.repeat(np.arange(len(halves)), halves)
        # A passage and what is checked around it reach over two halves before it and two behind.
        telling = np.unique(at[self.telling[terms]])
        near = (telling[:, None] + np.arange(-3, 3)).ravel()
        same = (near >= 0) & (near < len(owner))
        near, of = near[same], np.repeat(telling, 6)[same]
        some = np.unique(near[owner[near] == owner[of]])
        if not len(some):
            return []
        last = np.append(owner[1:] != owner[:-1], True)
        held = np.zeros(len(owner), dtype=bool)
        held[some] = True
        held[some[~last[some]] + 1] = True
        own = held[at]
        place = np.cumsum(held) - 1
        used, counts = counted(place[at[own]], terms[own], int(held.sum()))
        sums = counts @ self.space.latent[used]
        vectors = sums[place[some]]
        more = ~last[some]
        vectors[more] += sums[place[some[more] + 1]]
        norm = np.linalg.norm(vectors, axis=1)
        some, vectors, norm = some[norm > 1e-9], vectors[norm > 1e-9], norm[norm > 1e-9]
        best: dict[tuple, tuple[float, float, float]] = {}
        for s in range(0, len(some), 4096):
            rows = some[s : s + 4096]
            directed = vectors[s : s + 4096] / norm[s : s + 4096, None]
            for k in range(0, len(self.items), TOGETHER):
                cosine = directed @ self.vectors[k : k + TOGETHER].T
                r, i = np.nonzero(cosine >= self.least[k : k + TOGETHER])
                for row, item, c in zip(rows[r].tolist(), (i + k).tolist(), cosine[r, i].tolist(), strict=True):
                    text = int(np.searchsorted(first, row, side="right")) - 1
                    lcs, answer = self.check(words[text], row - int(first[text]), item)
                    if lcs >= COPY or (lcs >= REWORDED and answer >= ANSWERED):
                        key = (text, self.items[item].owner)
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (lcs, answer, c))
        return [(text, item, c, lcs, answer) for (text, item), (lcs, answer, c) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, rank: int = RANK) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, lcs, answer.

    lcs is the share of the item's words, in their order, that a passage has; answer the share of its answer's words
    (those of answer_col, else its rarest). Null and empty texts on either side hold nothing; a null or empty answer is
    taken to be missing. Texts of any length are read whole, some thousand characters at a time. Repeated rows give repeated
    results; null ids are kept; items that share an id, or have none, count as one; of parts or items that tie the best cosine
    counts; further columns are ignored; empty tables give an empty result. Items of more than 60 words are looked for in
    parts, one of which is enough; each part keeps the item's answer. The benchmark is the query set: it comes to the
    driver, and goes to the machines in blocks of 20,000 items, each with its own search of the corpus in the space that
    all blocks share. With several blocks the rows are stored first, under a number of their own.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    asked = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    asked = asked.filter(F.col("text").isNotNull()).distinct()
    kinds = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {asked.schema['item_id'].dataType.simpleString()}, cosine double, lcs double, answer double"
    items = parts_of(sorted(((r.item_id, r.text, r.answer) for r in asked.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "")))
    found = docs.sparkSession.createDataFrame([], kinds)
    many = len(items) > ITEMS
    # A row is known by its number in all blocks' searches, so what it holds of several blocks meets, and no other row's does.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id())) if many else rows.withColumn("row", F.lit(0).cast("long"))
    if (space := fit(rows, items, rank)) is not None:
        sent = docs.sparkSession.sparkContext.broadcast(space)
        for k in range(0, len(items), ITEMS):
            search = searched(rows, items[k : k + ITEMS], sent, kinds)
            found = found.unionByName(search) if many else search
    if many:
        found = found.groupBy("row", "doc_id", "item_id").agg(*[F.max_by(c, F.struct("lcs", "answer", "cosine")).alias(c) for c in ("cosine", "lcs", "answer")])
    return found.drop("row")


def searched(rows: DataFrame, items: list[Item], sent, kinds: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = sent.value
        checker, corpus = Checker(items, space), Corpus(space.vocabulary)
        for batch in batches:
            whole, doc, row = batch["text"].tolist(), batch["doc_id"].tolist(), batch["row"].tolist()
            for part in runs_of(whole):
                if out := checker.leaks(whole[part], corpus):
                    yield pd.DataFrame([(row[part.start + t], doc[part.start + t], i, c, lcs, a) for t, i, c, lcs, a in out], columns=["row", "doc_id", "item_id", "cosine", "lcs", "answer"])

    return rows.mapInPandas(run, kinds)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
