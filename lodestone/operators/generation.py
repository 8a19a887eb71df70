"""Generation behind an interface, and figures of it from a table of timed pieces."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize, tokens_of
from ..sources.shared import ready
from ..streaming.figures import figures_of
from .answers import PIECES, Ask, KeptAnswers, Patience, plain_messages, timed_pieces

#: They must hold a phrase of a refusal.
REFUSAL = {"zh": "提供的規格資料中沒有這項資訊", "en": "That information is not in the provided specifications."}


class Generator(Protocol):
    name: str

    def answer(self, prompts: DataFrame) -> DataFrame:
        """prompts with the column answer."""
        ...


class ExtractiveGenerator:
    """A stand-in for a model: it quotes the line of the context that shares most tokens with the question, or refuses."""

    name = "extractive"

    def __init__(self, max_tokens: int | None = None):
        self.max_tokens = max_tokens

    def answer(self, prompts: DataFrame) -> DataFrame:
        asked = F.array_distinct(tokenize(F.col("question")))
        lines = F.filter(F.split("context", "\n"), lambda x: x != "")
        scored = F.transform(lines, lambda x: F.struct(F.size(F.array_intersect(asked, tokenize(x))).alias("n"), x.alias("line")))
        best = F.aggregate(scored, F.struct(F.lit(0).alias("n"), F.lit("").alias("line")), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
        quoted = F.regexp_replace(best["line"], r"(?s)^(\[\d+\]) (.*)$", "$2 $1")
        said = F.when(best["n"] > 0, quoted).otherwise(F.when(F.col("lang") == "zh", REFUSAL["zh"]).otherwise(REFUSAL["en"]))
        return prompts.withColumn("answer", said if self.max_tokens is None else F.regexp_extract(said, rf"(?U)^(\s*(?:\S+\s*){{0,{self.max_tokens}}})", 1))


    def pieces(self, prompts: DataFrame) -> DataFrame:
        """(req_id, seq, t, piece, t0, t_end) for prompts (qid, question, lang, context): the same answers, found question by question
        in the workers, and timed there.
        """
        ready(prompts.sparkSession)
        most = self.max_tokens
        rows = prompts.select("qid", "question", "lang", "context")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for qid, question, lang, text in batch.itertuples(index=False, name=None):
                    t0 = time.time()
                    said = quoted(question, lang, text or "")
                    said = said if most is None else re.match(rf"\s*(?:\S+\s*){{0,{most}}}", said).group()
                    t_end = time.time()
                    out.append((qid, 0, t_end, said, t0, max(t_end, t0 + 1e-6)))
                yield pd.DataFrame(out, columns=["req_id", "seq", "t", "piece", "t0", "t_end"])

        return rows.mapInPandas(run, f"req_id {rows.schema['qid'].dataType.simpleString()}, {PIECES}")


def quoted(question: str, lang: str, text: str) -> str:
    """The line of the text that shares most tokens with the question, its number behind it; a refusal if none shares any."""
    asked, best, most = set(tokens_of(question)), "", 0
    for line in filter(None, text.split("\n")):
        if (n := len(asked & set(tokens_of(line)))) > most:
            best, most = line, n
    if not most:
        return REFUSAL["zh" if lang == "zh" else "en"]
    return re.sub(r"(?s)\A(\[\d+\]) (.*)\Z", r"\2 \1", best)


class ModelGenerator:
    """A model that `load` makes once per worker: a list of messages to a text."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[dict[str, str]]], str]]):
        self.name, self.load = name, load

    def answer(self, prompts: DataFrame) -> DataFrame:
        load = self.load
        loaded: list = []

        @F.pandas_udf("string")
        def run(batch: pd.Series) -> pd.Series:
            if not loaded:
                loaded.append(load())
            return batch.map(lambda ms: loaded[0]([{"role": m["role"], "content": m["content"]} for m in ms]))

        return prompts.withColumn("answer", run("messages"))

    def asker(self) -> Callable[[], Ask]:
        load = self.load

        def make() -> Ask:
            model = load()
            return lambda messages: [model(messages)]

        return make

    def pieces(self, prompts: DataFrame) -> DataFrame:
        """(req_id, seq, t, piece, t0, t_end) for prompts (qid, messages): an answer is one piece."""
        return timed_pieces(prompts, self.asker())


def streamed(url: str, messages: list[dict[str, str]], options: dict, timeout: float) -> Iterator[str]:
    """The pieces of a chat server's answer: a JSON request, answered by server-sent events up to `[DONE]`."""
    body = json.dumps({"messages": messages, "stream": True, **options}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as lines:
        for line in lines:
            text = line.decode("utf-8", "replace").strip()
            if not text.startswith("data:"):
                continue
            if (data := text[5:].strip()) == "[DONE]":
                return
            try:
                piece = json.loads(data)["choices"][0]["delta"].get("content")
            except (ValueError, LookupError, TypeError, AttributeError):
                continue
            if piece:
                yield piece


class ServerGenerator:
    """A chat server that workers ask over HTTP, some requests at once in each task, and again where it fails for a while. Its pieces are
    timed, so that stream_stats has figures of them.
    """

    def __init__(self, name: str, url: str, max_tokens: int | None = None, timeout: float = 120.0, patience: Patience | None = None):
        self.name, self.url, self.timeout, self.patience = name, url, timeout, patience or Patience()
        self.options = {"model": name} | ({"max_tokens": max_tokens} if max_tokens else {})

    def asker(self) -> Callable[[], Ask]:
        url, options, timeout = self.url, self.options, self.timeout
        return lambda: lambda messages: streamed(url, messages, options, timeout)

    def answer(self, prompts: DataFrame) -> DataFrame:
        load, patience = self.asker(), self.patience
        ready(prompts.sparkSession)

        @F.pandas_udf("string")
        def run(batch: pd.Series) -> pd.Series:
            out = []
            for got in patience.over(load(), map(plain_messages, batch)):
                if isinstance(got, Exception):
                    raise got
                out.append("".join(piece for _, piece in got[1]))
            return pd.Series(out, dtype=object)

        return prompts.withColumn("answer", run.asNondeterministic()("messages"))

    def kept(self, path: str, per_task: int = 64) -> KeptAnswers:
        """The same server, with answers kept in a folder and asked for only once."""
        return KeptAnswers(self.name, self.asker(), path, self.options | {"url": self.url}, self.patience, per_task)

    def pieces(self, prompts: DataFrame) -> DataFrame:
        """(req_id, seq, t, piece, t0, t_end) for prompts (qid, messages): see timed_pieces()."""
        return timed_pieces(prompts, self.asker(), self.patience)


GENERATORS: dict[str, Callable[..., Generator]] = {"extractive": ExtractiveGenerator}


def register_generator(name: str, make: Callable[..., Generator]) -> None:
    """Make a generator known by its name; `make` gets the options that build_generator is called with."""
    GENERATORS[name] = make


def build_generator(name: str, **options) -> Generator:
    if name not in GENERATORS:
        raise KeyError(f"no generator {name!r}; known: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](**options)


def shown_to_reader(pieces: Iterable[str]) -> Iterator[str]:
    """The pieces of a stream without the reasoning block that it may begin with. What may be the start of one is held
    back until that is clear; of a block that never ends nothing is shown.
    """
    held, clear = "", False
    for piece in pieces:
        if clear:
            yield piece
            continue
        held += piece
        begins = held.lstrip()
        if "</think>" in held:
            clear = True
            if rest := held.split("</think>", 1)[1].lstrip():
                yield rest
        elif begins and not begins.startswith("<"):
            clear = True
            yield held
    if not clear and held and not held.lstrip().startswith("<think>"):
        yield held


def sse_pieces(lines: DataFrame) -> DataFrame:
    """(req_id, seq, t, piece) of logged lines (req_id, seq, t, line) of server-sent events.

    Only `data:` lines count, up to `[DONE]`; those that aren't JSON or have no content are skipped.
    """
    body = F.trim(F.substring("line", 6, 1 << 30))
    data = lines.filter(F.startswith("line", F.lit("data:"))).withColumn("body", body)
    done = F.min(F.when(F.col("body") == "[DONE]", F.col("seq"))).over(Window.partitionBy("req_id"))
    piece = F.try_variant_get(F.try_parse_json("body"), "$.choices[0].delta.content", "string")
    return data.withColumn("done", done).filter(F.col("done").isNull() | (F.col("seq") < F.col("done"))).select("req_id", "seq", "t", piece.alias("piece")).filter("piece IS NOT NULL")


def stream_stats(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per request of starts (req_id, t0, t_end; seconds): figures of its pieces (req_id, seq, t, piece).

    ttft_s: to the first piece; ttft_answer_s: to the first piece that a reader sees, else ttft_s; thinking_tokens:
    pieces inside an open reasoning block before that; decode_s: first to last piece. Empty pieces count for nothing. Rows of a
    request are read one after the other: none is gathered whole. streaming/figures.py has the same for a stream.
    """
    figures = figures_of(pieces)
    rows = starts.join(figures, "req_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ttft, decode, total, n = zero(F.col("t_first") - F.col("t0")), zero(F.col("t_last") - F.col("t_first")), F.col("t_end") - F.col("t0"), F.coalesce("n_tokens", F.lit(0))
    return rows.select(
        "req_id",
        n.alias("n_tokens"),
        F.coalesce("thinking_tokens", F.lit(0)).alias("thinking_tokens"),
        ttft.alias("ttft_s"),
        zero(F.coalesce(F.col("t_answer") - F.col("t0"), F.when(ttft > 0, ttft))).alias("ttft_answer_s"),
        decode.alias("decode_s"),
        total.alias("total_s"),
        F.when((decode > 0) & (n > 1), F.try_divide(n - 1, decode)).otherwise(0.0).alias("tps"),
        F.coalesce(F.try_divide(n, total), F.lit(0.0)).alias("e2e_tps"),
    )


def count_tokens(c: Column, load: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """Tokens of the lexical tokenizer, or of a model's: `load` makes, once per worker, what counts those of a text."""
    if load is None:
        return F.size(tokenize(c))
    loaded: list = []

    @F.pandas_udf("int")
    def count(batch: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(load())
        return batch.map(lambda t: loaded[0](t or ""))

    return count(c)
