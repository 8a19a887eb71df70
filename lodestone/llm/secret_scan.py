"""Secret scanning with a linear-chain conditional random field, beside fixed patterns.

Every run of letters, digits and key punctuation is a token of the chain. Each is tagged begin (B), inside (I) or outside
(O) of a secret by its shape, its neighbouring words and what is between them, and features of the whole file; Viterbi
decodes. A token whose B and I score so far below O that no step between tags can make up for it is outside in every best
path; so only runs of other tokens are decoded, which gives exactly the tags that decoding the whole chain would.

The field is fitted on pieces of a bounded sample of documents: values that the patterns find, ordinary prose, and made-up
secrets of many shapes and look-alikes (dates, addresses, names of files) put into prose. Neighbours are hidden in half of
the pieces at random, so that shape alone carries over to secrets that no pattern names.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import Adam
from .common import ready, table, texts
from .labelled import sample_texts

#: Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.\-]*[A-Za-z0-9])?")
#: Characters between two tokens beyond which they are no neighbours.
NEAR = 8
#: Bounds of the training sample: documents and characters in all; and pieces of text that are trained on, of so many tokens.
SAMPLE, TOTAL = 3000, 24_000_000
PIECES, TOKENS = 2600, 28
#: Tokens whose scores a worker keeps; beyond that it starts afresh.
KEPT = 200_000
B, I, O = 0, 1, 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, leftmost and without overlap in each kind.

    Runs of hex digits and access keys are matched at their least length at once: a match takes a whole run, so
    shorter runs hide nothing. Assignments are filtered after matching, since a short one hides what begins in it.
    """
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def values(text: str) -> list[tuple[int, int]]:
    """Spans of the secrets themselves that the patterns find: without the name that a value is assigned to."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    return found + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]


#: Letters as vowels (v) or consonants (c), large or small, digits as d, dots and slashes as they are, hyphens and underscores
#: as -, plus signs as p; and the same by kinds of characters only.
FORM = str.maketrans({c: ("v" if c.lower() in "aeiouy" else "c") if c.islower() else ("V" if c.lower() in "aeiouy" else "C") for c in string.ascii_letters} | dict.fromkeys(string.digits, "d") | {"_": "-", "+": "p"})
KIND = str.maketrans({"v": "l", "c": "l", "V": "u", "C": "u", ".": "p", "/": "p", "-": "p"})
ALIKE, CONSONANTS, ALL_HEX = re.compile("l+|u+|d+|p+"), re.compile("[cC]+"), re.compile("[0-9a-f]+")


def form(token: str) -> tuple[str, int, bool, str]:
    """All that shape() looks at: the form of the token, its number of different characters, whether all are hex digits,
    and what a long token begins with.
    """
    return token.translate(FORM), len(set(token)), ALL_HEX.fullmatch(token) is not None, token[:4] if len(token) >= 12 and token[:4].isalpha() else ""


def shape(of: str, different: int, hexa: bool, head: str) -> list[str]:
    """Features of a token by itself, all of it, from its form."""
    n, kinds = len(of), of.translate(KIND)
    held = {k: kinds.count(k) for k in "lupd"}
    turns = len(ALIKE.findall(kinds)) - 1
    letters, vowels = held["l"] + held["u"], of.count("v") + of.count("V")
    longest = max(map(len, CONSONANTS.findall(of)), default=0)
    size = f"{min(n, 8)}" if n < 12 else f"{min(n // 4, 10) * 4}+"
    which = "".join(k for k in "lupd" if held[k])
    usual = "w" if held["l"] - (kinds[0] == "l") == n - 1 else "U" if held["u"] == n else ""
    return [
        "any",
        f"size={size}",
        f"kinds={which}",
        f"size,kinds={size},{which}",
        f"digits={held['d'] * 4 // n}",
        f"turns={min(turns * 8 // n, 5)}",
        f"turns,size={min(turns, 6)},{min(n // 8, 4)}",
        f"hex={int(hexa)},{min(n // 8, 3)}",
        f"vowels={vowels * 6 // max(letters, 1) if letters else 'none'}",
        f"consonants={min(longest, 7)}",
        f"consonants,usual={min(longest, 7)},{usual},{min(n // 8, 3)}",
        f"dots={min(of.count('.'), 3)}",
        f"slashes={min(of.count('/'), 3)}",
        f"marks={min(of.count('-'), 5)},{which}",
        f"different={min(different, 24)}",
        f"different,size={different * 8 // n},{min(n // 8, 4)}",
        f"head={head}",
    ]


def between(gap: str) -> str:
    return next((c for c in "=:@" if c in gap), "'" if "'" in gap or '"' in gap else "")


def around(before: str, gap: str, after: str, next_gap: str) -> list[str]:
    """Features of the tokens on either side, and of what is between."""
    return [f"before={before.lower()}", f"after={after.lower()}", f"gap={between(gap)}", f"next={between(next_gap)}"]


def of_file(text: str) -> list[str]:
    return [f"file-size={min(len(text).bit_length(), 16)}", f"file-assigns={min(text.count('='), 4)}", f"file-colons={min(text.count(':'), 4)}"]


def neighbours(text: str, spans: list[tuple[int, int]], i: int) -> tuple[str, str, str, str]:
    """Token before, gap, token after, next gap of the i-th token; tokens too far off are empty."""
    start, end = spans[i]
    left, right = spans[i - 1] if i else (0, -NEAR - 1), spans[i + 1] if i + 1 < len(spans) else (len(text) + NEAR + 1, 0)
    before = text[slice(*left)] if i and start - left[1] <= NEAR else ""
    after = text[slice(*right)] if right[0] - end <= NEAR else ""
    return before, text[max(left[1], start - NEAR, 0) : start], after, text[end : min(right[0], end + NEAR)]


@dataclass
class Field:
    """Weights of the features by name (n, 3), and of steps between tags; the chain starts and ends outside."""

    names: dict[str, int]
    seen: np.ndarray
    steps: np.ndarray

    def of(self, features: list[str], rare: str | None = None) -> np.ndarray:
        """The sum of the weights; features that training didn't see weigh nothing, or as much as `rare`."""
        at = [self.names.get(f, self.names.get(rare, -1)) for f in features]
        return self.seen[[k for k in at if k >= 0]].sum(axis=0)

    def unary(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """The scores (n, 3) of all tokens of a text."""
        whole = self.of(of_file(text))
        out = np.zeros((len(spans), 3))
        for i, (start, end) in enumerate(spans):
            before, after, gap, following = around(*neighbours(text, spans, i))
            out[i] = whole + self.of(shape(*form(text[start:end]))) + self.of([before], "before=?") + self.of([after], "after=?") + self.of([gap, following])
        return out

    def viterbi(self, unary: np.ndarray) -> list[int]:
        best, back = self.steps[O] + unary[0], []
        for row in unary[1:]:
            paths = best[:, None] + self.steps
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        tags = [int((best + self.steps[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


class Decoder(dict):
    """Decodes whole texts with a field. Keeps, for tokens met so far, how far B and I are above O by their shape, and by
    being the token before and after another one.
    """

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        gains = lambda v: (float(v[B] - v[O]), float(v[I] - v[O]))
        self.gains = gains
        self.feature = {name: gains(field.seen[k]) for name, k in field.names.items()}
        self.forms: dict[tuple, tuple[float, float]] = {}
        steps = field.steps
        # What the steps to and from a tag can give more than those to and from O, at most.
        into, out = steps - steps[:, [O]], steps - steps[[O], :]
        self.slack = tuple(float(into[:, t].max() + out[t].max()) for t in (B, I))
        self.gaps = {side: {k: self.feature.get(f"{side}={k}", (0.0, 0.0)) for k in ("", "=", ":", "@", "'")} for side in ("gap", "next")}
        rare = [self.feature.get(f, (0.0, 0.0)) for f in ("before=?", "after=?")]
        self.none = tuple(self.feature.get(f, r) for f, r in zip(("before=", "after="), rare, strict=True))
        self.rare = rare[0] + rare[1]
        self.beside = {name.split("=", 1)[1]: () for name in field.names if name.startswith(("before=", "after="))}
        for word in self.beside:
            self.beside[word] = self.feature.get(f"before={word}", rare[0]) + self.feature.get(f"after={word}", rare[1])

    def __missing__(self, token: str) -> tuple[float, ...]:
        if len(self) >= KEPT:
            self.clear()
        own = form(token)
        if (gain := self.forms.get(own)) is None:
            if len(self.forms) >= KEPT:
                self.forms.clear()
            known = [self.feature[f] for f in shape(*own) if f in self.feature]
            gain = self.forms[own] = (math.fsum(g for g, _ in known), math.fsum(g for _, g in known))
        self[token] = found = gain + self.beside.get(token.lower(), self.rare)
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of the secrets in the best path of the whole chain."""
        distinct = set(TOKEN.findall(text))
        if not distinct:
            return []
        columns = list(zip(*map(self.__getitem__, distinct), strict=True))
        file = self.gains(self.field.of(of_file(text)))
        marks = [""] + [k for k, cs in (("=", "="), (":", ":"), ("@", "@"), ("'", "'\"")) if any(c in text for c in cs)]
        # What everything but its shape can give a token of this text, at most.
        most = [
            file[t] + max(max(columns[2 + t]), self.none[0][t]) + max(max(columns[4 + t]), self.none[1][t]) + sum(max(self.gaps[side][k][t] for k in marks) for side in ("gap", "next")) + self.slack[t]
            for t in (B, I)
        ]
        need_b, need_i = -most[B] - 1e-9, -most[I] - 1e-9
        if max(columns[0]) < need_b and max(columns[1]) < need_i:
            return []
        spans = [m.span() for m in TOKEN.finditer(text)]
        found: list[tuple[int, int]] = []
        run: list[tuple[float, float, float]] = []
        for i, (start, end) in enumerate([*spans, (-1, -1)]):
            gain = None
            if start >= 0:
                own = self[text[start:end]]
                if own[0] >= need_b or own[1] >= need_i:
                    before, gap, after, next_gap = neighbours(text, spans, i)
                    b = self[before][2:4] if before else self.none[0]
                    a = self[after][4:6] if after else self.none[1]
                    g, n = self.gaps["gap"][between(gap)], self.gaps["next"][between(next_gap)]
                    gain = [file[t] + own[t] + b[t] + a[t] + g[t] + n[t] for t in (B, I)]
                    if gain[B] + self.slack[B] < -1e-9 and gain[I] + self.slack[I] < -1e-9:
                        gain = None
            if gain is not None:
                run.append((gain[0], gain[1], 0.0))
            elif run:
                found += tagged(spans[i - len(run) : i], self.field.viterbi(np.array(run)))
                run = []
        return found


def tagged(spans: list[tuple[int, int]], tags: list[int]) -> list[tuple[int, int]]:
    """Spans of the secrets: B begins one, I goes on with it or, after O, begins one too."""
    found: list[tuple[int, int]] = []
    last = O
    for (start, end), tag in zip(spans, tags, strict=True):
        if tag == B or (tag == I and last == O):
            found.append((start, end))
        elif tag == I:
            found[-1] = (found[-1][0], end)
        last = tag
    return found


def some(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(least, most)))


HEXA, UPPER, LOWER, DIGITS = "0123456789abcdef", string.ascii_uppercase, string.ascii_lowercase, string.digits
WORDY = UPPER + LOWER + DIGITS
#: Shapes of made-up secrets.
SHAPES: dict[str, Callable[[random.Random], str]] = {
    "hex": lambda r: some(r, HEXA, 16, 64),
    "mixed": lambda r: some(r, WORDY, 18, 48),
    "base64": lambda r: some(r, WORDY + "+/", 22, 64),
    "letters": lambda r: some(r, UPPER + LOWER, 18, 40),
    "lower": lambda r: some(r, LOWER, 18, 32),
    "upper": lambda r: some(r, UPPER + DIGITS, 18, 36),
    "prefixed": lambda r: some(r, LOWER, 2, 4) + r.choice(["_", "-", "_live_", "_test_"]) + some(r, WORDY, 18, 40),
    "dotted": lambda r: "eyJ" + ".".join(some(r, WORDY + "_-", 20, 60) + "a" for _ in range(3)),
    "access": lambda r: "AKIA" + some(r, UPPER + DIGITS, 16, 16),
    "grouped": lambda r: "-".join(some(r, UPPER + DIGITS, 5, 5) for _ in range(r.randint(4, 5))),
    "password": lambda r: some(r, LOWER, 3, 6).title() + some(r, DIGITS, 2, 4) + r.choice("_-.") + some(r, WORDY, 6, 10),
}
PLACED = ("{k} = {v}", "{k}={v}", "{k}: {v}", '"{k}": "{v}"', "{k} is {v}", "use {v} as {k}", "{v}", "{v}", "({v})", "with {v} and", "Bearer {v}", "export {k}='{v}'", "https://user:{v}@host.example/x")
NAMES = ("password", "secret", "token", "api_key", "key", "auth", "credential", "pwd", "passphrase", "private_key", "access")
#: What looks like a secret and is none.
LOOKALIKES: tuple[Callable[[random.Random], str], ...] = (
    lambda r: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    lambda r: f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00Z",
    lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    lambda r: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
    lambda r: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}",
    lambda r: f"{some(r, LOWER, 3, 9)}.{some(r, LOWER, 3, 9)}{r.randint(1, 99)}@{some(r, LOWER, 4, 9)}.example.org",
    lambda r: f"https://www.{some(r, LOWER, 4, 9)}.org/{some(r, LOWER, 4, 9)}/{some(r, LOWER, 4, 9)}-{some(r, LOWER, 3, 9)}/{r.randint(1, 9999)}.html",
    lambda r: "/" + "/".join(some(r, LOWER, 2, 8) for _ in range(r.randint(2, 5))) + ".txt",
    lambda r: str(r.randint(10**6, 10**15)),
    lambda r: f"{r.randint(1, 999)},{r.randint(100, 999)}.{r.randint(0, 99):02d}",
    lambda r: " ".join(str(r.randint(1000, 9999)) for _ in range(4)),
    lambda r: f"{some(r, UPPER, 2, 2)}{r.randint(10, 99)} " + " ".join(str(r.randint(1000, 9999)) for _ in range(5)),
    lambda r: "_".join(r.choice(("user", "name", "get", "set", "value", "list", "count", "index", "total", "size", "max")) for _ in range(r.randint(2, 4))),
    lambda r: "".join(r.choice(("User", "Name", "Get", "Set", "Value", "List", "Count", "Index", "Total", "Size", "Max")) for _ in range(r.randint(2, 5))),
    lambda r: f"{some(r, UPPER, 2, 4)}-{r.randint(10, 99999)}",
)


def piece_around(text: str, spans: list[tuple[int, int]], i: int, rng: random.Random) -> tuple[int, int]:
    """Ends of a piece of TOKENS tokens that has the i-th one at a random place."""
    first = max(0, min(i - rng.randrange(TOKENS), len(spans) - TOKENS))
    return spans[first][0], spans[min(first + TOKENS, len(spans)) - 1][1]


def examples(sample: list[str], pieces: int, rng: random.Random) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(piece of text, spans of secrets in it, features of its file): a third with what the patterns find or with odd tokens
    of the documents, a third with made-up secrets, a third with look-alikes or nothing else than prose.
    """
    out: list[tuple[str, list[tuple[int, int]], list[str]]] = []
    whole = [t for t in sample if TOKEN.search(t)]
    if not whole:
        return out
    for n in range(pieces):
        text = whole[n % len(whole)]
        spans = [m.span() for m in TOKEN.finditer(text)]
        if n % 3 == 0:
            known = values(text)
            odd = [i for i, (s, e) in enumerate(spans) if any(s < y and x < e for x, y in known)] if known and n % 2 == 0 else [i for i, (s, e) in enumerate(spans) if e - s > 11 or any(c.isdigit() for c in text[s:e])]
            a, b = piece_around(text, spans, rng.choice(odd or range(len(spans))), rng)
            out.append((text[a:b], [(s - a, e - a) for s, e in known if a <= s and e <= b], of_file(text)))
            continue
        a, b = piece_around(text, spans, rng.randrange(len(spans)), rng)
        piece = text[a:b]
        own = values(piece)
        cuts = [m.start() for m in re.finditer(r"(?<=\S)\s", piece)]
        at = rng.choice([c for c in cuts if not any(s < c < e for s, e in own)] or [len(piece)])
        put, secret = "", None
        if n % 3 == 1:
            secret = SHAPES[rng.choice(list(SHAPES))](rng)
            put = " " + rng.choice(PLACED).format(k=rng.choice(NAMES), v=secret)
        elif n % 6 == 2:
            put = " " + rng.choice(("{v}", "{v}", "{k}: {v}", "{k} = {v}")).format(k=rng.choice(("date", "id", "no", "phone", "version", "see", "file")), v=rng.choice(LOOKALIKES)(rng))
        moved = [(s + len(put), e + len(put)) if s >= at else (s, e) for s, e in own]
        if secret is not None:
            start = at + put.index(secret)
            moved.append((start, start + len(secret)))
        made = piece[:at] + put + piece[at:]
        out.append((made, moved, of_file(text)))
    return out


def tags_of(spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    tags, last = [], None
    for start, end in spans:
        hit = next(((s, e) for s, e in secrets if s < end and start < e), None)
        tags.append(O if hit is None else I if hit == last else B)
        last = hit
    return tags


def log_likelihood(unary: np.ndarray, steps: np.ndarray, tags: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of chains (n, t) of these lengths by their scores (n, t, 3) and the steps (3, 3)."""
    n, t = tags.shape
    inside = np.arange(t)[None, :] < length[:, None]
    unary = np.where(inside[:, :, None], unary, np.array([-1e3, -1e3, 0.0]))  # behind the end all is outside
    add = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    fore, after = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    fore[:, 0] = steps[O] + unary[:, 0]
    for i in range(1, t):
        fore[:, i] = add(fore[:, i - 1, :, None] + steps, 1) + unary[:, i]
    after[:, -1] = steps[:, O]
    for i in range(t - 2, -1, -1):
        after[:, i] = add(steps + (unary[:, i + 1] + after[:, i + 1])[:, None, :], 2)
    total = add(fore[:, -1] + after[:, -1], 1)
    by_token = -np.exp(fore + after - total[:, None, None])
    np.put_along_axis(by_token, tags[:, :, None], np.take_along_axis(by_token, tags[:, :, None], 2) + 1, 2)
    by_token[~inside] = 0
    by_step = np.zeros((3, 3))
    by_step[O] -= np.exp(fore[:, 0] + after[:, 0] - total[:, None]).sum(axis=0)
    by_step[:, O] -= np.exp(fore[:, -1] + after[:, -1] - total[:, None]).sum(axis=0)
    for i in range(1, t):
        by_step -= np.exp(fore[:, i - 1, :, None] + steps + (unary[:, i] + after[:, i])[:, None, :] - total[:, None, None]).sum(axis=0)
    path = np.concatenate([np.full((n, 1), O), tags, np.full((n, 1), O)], axis=1)
    np.add.at(by_step, (path[:, :-1].ravel(), path[:, 1:].ravel()), 1)
    return by_token, by_step


def fit(sample: list[str], pieces: int = PIECES, epochs: int = 90, rate: float = 0.15, decay: float = 2e-4, hidden: float = 0.5, seed: int = 7) -> Field:
    """A field fitted to pieces of the sample by gradient steps on all of them; without any text it tags all as outside."""
    made = examples(sample, pieces, random.Random(seed))
    chains = [(text, spans, tags_of(spans, secrets), file) for text, secrets, file in made if (spans := [m.span() for m in TOKEN.finditer(text)])]
    if not chains:
        return Field({"any": 0}, np.array([[0.0, 0.0, 9.0]]), np.zeros((3, 3)))
    near = [[around(*neighbours(text, spans, i)) for i in range(len(spans))] for text, spans, _, _ in chains]
    often = Counter(f for chain in near for names in chain for f in names[:2])
    names: dict[str, int] = {}
    n, t = len(chains), max(len(spans) for _, spans, _, _ in chains)
    own_at, own, near_at, near_of = [], [], [], []
    tags, length = np.full((n, t), O), np.array([len(spans) for _, spans, _, _ in chains])
    for c, (text, spans, marks, file) in enumerate(chains):
        tags[c, : len(marks)] = marks
        for i, (start, end) in enumerate(spans):
            for f in shape(*form(text[start:end])) + file:
                own_at.append(c * t + i)
                own.append(names.setdefault(f, len(names)))
            for f in near[c][i]:
                # Words that are met only once or twice are as good as unknown.
                f = f if often[f] > 2 or f.startswith(("gap", "next")) else f.split("=", 1)[0] + "=?"
                near_at.append(c * t + i)
                near_of.append(names.setdefault(f, len(names)))
    own_at, own, near_at, near_of = map(np.array, (own_at, own, near_at, near_of))
    field = Field(names, np.zeros((len(names), 3)), np.zeros((3, 3)))
    rng, adam = np.random.default_rng(seed), Adam([field.seen, field.steps], rate)
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs) + 1e-3
        shown = rng.random(n)[near_at // t] >= hidden
        at, which = np.concatenate([own_at, near_at[shown]]), np.concatenate([own, near_of[shown]])
        unary = np.stack([np.bincount(at, field.seen[which, k], minlength=n * t) for k in range(3)], axis=1).reshape(n, t, 3)
        by_token, by_step = log_likelihood(unary, field.steps, tags, length)
        by_token = by_token.reshape(-1, 3)[at]
        grad = np.stack([np.bincount(which, by_token[:, k], minlength=len(names)) for k in range(3)], axis=1)
        adam.step([-grad / n + decay * field.seen, -by_step / n + decay * field.steps])
    return field


def scan(text: str, decoder: Decoder) -> list[tuple[str, int, int]]:
    """The patterns' spans and the field's."""
    return base_spans(text) + [("crf", start, end) for start, end in decoder.spans(text)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_secrets(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, findings array<struct<kind, start, end>> by start and kind, in code points.

    Spans of the field (kind crf) are of the secret itself and stand beside those of the patterns, also where both have
    found the same. A null text counts as empty and has no findings. Whole texts are scanned; repeated rows and null ids
    are kept; further columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(field)
        for batch in batches:
            found = [sorted(scan(t, decoder), key=lambda x: (x[1], KINDS.index(x[0]), x[2])) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "findings": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, findings array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The columns doc_id, n_assign, n_access, n_hex, base_sha256, spans of the findings."""
    base = F.filter("findings", lambda f: f["kind"] != "crf")
    text_of = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(findings, f -> f.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("findings")).alias("spans"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(scan_secrets(docs, fit(sample_texts(docs, SAMPLE, TOTAL))))
