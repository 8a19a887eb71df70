"""A byte-level convolutional network in numpy: filters of several widths, max-pooled over chunks, then a linear layer.

A filter of width w is a table of w x 256 weights: its answer at a place is the sum of one entry for each of w bytes.
A text is cut into chunks of a fixed length that overlap by the widest filter less one at least, so that every place of the
whole text is seen; bytes beyond the end count as 0. What chunks are combined to is the caller's choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CHUNK = 256
#: Chunks that go through the filters at once.
ROWS = 512


def chunks_of(texts: list[bytes], widest: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks (n, chunk + widest - 1), and the number of chunks of each text (at least 1). `widest` is that of
    the filters, or more, by which chunks overlap more; at most a chunk.
    """
    counts = np.array([max(1, -(-len(t) // chunk)) for t in texts], dtype=np.int64)
    flat = np.zeros(int(counts.sum()) * chunk + widest - 1, dtype=np.uint8)
    at = 0
    ends = []
    for text, n in zip(texts, counts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        at += int(n) * chunk
        ends.append(at)
    rows = np.lib.stride_tricks.sliding_window_view(flat, chunk + widest - 1)[::chunk]
    if len(ends) > 1:  # what a chunk sees beyond its text's end is another text's: it counts as 0
        rows = rows.copy()
        rows[np.cumsum(counts) - 1, chunk:] = 0
    return rows, counts


@dataclass
class Filters:
    """tables: for each width, an array (width, 256, filters)."""

    tables: list[np.ndarray] = field(default_factory=list)
    _pairs: list[list[np.ndarray]] | None = None

    @classmethod
    def random(cls, widths: tuple[int, ...], filters: int, rng: np.random.Generator) -> Filters:
        return cls([rng.normal(0, 0.3 / w**0.5, (w, 256, filters)).astype(np.float32) for w in widths])

    @property
    def widest(self) -> int:
        return max(len(t) for t in self.tables)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each chunk, (n, all filters), at least 0.

        Two neighbouring bytes are looked up at once, in tables of all 65,536 pairs.
        """
        if self._pairs is None:
            self._pairs = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]
        out = []
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            n = part.shape[1] - self.widest + 1
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            tops = []
            for table, lookups in zip(self.tables, self._pairs, strict=True):
                total = None
                for k, lookup in enumerate(lookups):
                    j = 2 * k
                    values = lookup.take((pair if j + 1 < len(table) else part)[:, j : j + n], axis=0)
                    total = values if total is None else np.add(total, values, out=total)
                tops.append(np.maximum(total.max(axis=1), 0))
            out.append(np.concatenate(tops, axis=1))
        return np.concatenate(out) if out else np.zeros((0, sum(t.shape[2] for t in self.tables)), dtype=np.float32)

    def argmax(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width, the place and size of the largest answer, both (n, filters)."""
        n = rows.shape[1] - self.widest + 1
        out = []
        for table in self.tables:
            total = table[0].take(rows[:, :n], axis=0)
            for j in range(1, len(table)):
                total += table[j].take(rows[:, j : j + n], axis=0)
            place = total.argmax(axis=1)
            out.append((place, np.take_along_axis(total, place[:, None, :], axis=1)[:, 0, :]))
        return out

    def gradient(self, rows: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]], upper: np.ndarray) -> list[np.ndarray]:
        """Of the tables, given that of the pooled values (n, all filters): it goes to the places of the maxima."""
        grads, at = [], 0
        every = np.arange(len(rows))[:, None]
        for table, (place, value) in zip(self.tables, places, strict=True):
            f = table.shape[2]
            g = np.where(value > 0, upper[:, at : at + f], 0).astype(np.float32)
            at += f
            grad = np.zeros_like(table)
            column = np.broadcast_to(np.arange(f), place.shape)
            for j in range(len(table)):
                np.add.at(grad[j], (rows[every, place + j], column), g)
            grads.append(grad)
        return grads


class Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float, decay: float = 0.0):
        self.arrays, self.rate, self.decay, self.t = arrays, rate, decay, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            g = g + self.decay * a
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
