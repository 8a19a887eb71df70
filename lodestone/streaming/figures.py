"""Figures of streamed answers: one state machine for each request, over sorted rows or over a stream of events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import ready

#: The tags of a reasoning block, and switches that a reader does not see.
OPEN, CLOSE = "<think>", "</think>"
BLOCK, SWITCH = re.compile(r"(?s)<think>.*?</think>\s*"), re.compile(r"\s*/no_(?:think|output)\b\s*")
STATE = "seen string, thought boolean, t_answer double, thinking long, n long, t_first double, t_last double, t0 double, done_ts long"
FIGURES = "n_tokens long, thinking_tokens long, t_first double, t_last double, t_answer double"


def shown(text: str) -> str:
    """What strip_thinking() leaves of a text."""
    text = BLOCK.sub("", text)
    if CLOSE in text:
        text = re.sub(r"(?s)^.*?</think>\s*", "", text, count=1)
    return SWITCH.sub(" ", text).strip()


@dataclass
class Progress:
    """How far a request's answer has come. seen: what decides whether a reader sees something yet; of an open reasoning block only
    its end is kept, and nothing once there is an answer.
    """

    seen: str = ""
    thought: bool = False
    t_answer: float | None = None
    thinking: int = 0
    n: int = 0
    t_first: float | None = None
    t_last: float | None = None

    def take(self, t: float, piece: str) -> None:
        """The next piece; empty ones count for nothing."""
        if not piece:
            return
        self.n += 1
        self.t_first = t if self.t_first is None else min(self.t_first, t)
        self.t_last = t if self.t_last is None else max(self.t_last, t)
        if self.t_answer is not None:
            return
        seen = self.seen + piece
        opened = seen.find(OPEN)
        inside = opened >= 0 and CLOSE not in seen
        self.thought |= inside
        self.thinking += inside
        if inside:
            start = opened + len(OPEN)
            seen = seen[:start] + seen[start:][-len(CLOSE) :]
        elif (self.thought or opened < 0) and shown(seen):
            self.t_answer, seen = t, ""
        self.seen = seen

    def figures(self) -> tuple:
        return self.n, self.thinking, self.t_first, self.t_last, self.t_answer


def figures_of(pieces: DataFrame) -> DataFrame:
    """(req_id, FIGURES) of requests with pieces (req_id, seq, t, piece). A request's rows come one after the other, in order of seq:
    a task holds the state of one, however long it is.
    """
    ready(pieces.sparkSession)
    kind = pieces.schema["req_id"].dataType.simpleString()
    rows = pieces.filter("piece <> ''").select("req_id", F.col("seq").alias("seq"), F.col("t").cast("double").alias("t"), "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for batch in batches:
            done = []
            for req, t, piece in zip(batch["req_id"].tolist(), batch["t"].tolist(), batch["piece"].tolist(), strict=True):
                if own is None or req != now:
                    if own is not None:
                        done.append((now, *own.figures()))
                    now, own = req, Progress()
                own.take(t, piece)
            yield frame(done)
        if own is not None:
            yield frame([(now, *own.figures())])

    return rows.repartition("req_id").sortWithinPartitions("req_id", "seq", "t", "piece").mapInPandas(run, f"req_id {kind}, {FIGURES}")


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["req_id", "n_tokens", "thinking_tokens", "t_first", "t_last", "t_answer"])
    return out.astype({"n_tokens": "int64", "thinking_tokens": "int64", "t_first": float, "t_last": float, "t_answer": float})


class RequestFigures(StatefulProcessor):
    """Events (seq, ts, kind, piece) of one request. They are held back until the watermark has passed them, and then taken in order of
    time and seq, so that events that come late by less than its delay make no difference. The figures are given when the
    request's end is taken, or when `silence` milliseconds have passed since its last event; the state then goes, and what may
    come after that is another request. Spark drops what is later than the watermark allows.
    """

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE)
        self.held = handle.getListState("held", "seq long, ts long, kind string, piece string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = [tuple(x) for batch in rows for x in batch[["seq", "millis", "kind", "piece"]].itertuples(index=False, name=None)]
        yield from self.advance(key, [(int(s), int(m), k, p or "") for s, m, k, p in events], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        own = Progress(*known[:7]) if known else Progress()
        t0, done = tuple(known[7:]) if known else (None, -1)
        held = sorted([tuple(x) for x in self.held.get()] if self.held.exists() else []) + new
        ended = []

        def end(at: int, silent: bool) -> None:
            nonlocal own, t0, done
            ended.append((key[0], *own.figures(), t0, at / 1000, silent))
            own, t0, done = Progress(), None, -1

        for seq, ts, kind, piece in sorted((e for e in held if e[1] <= watermark), key=lambda e: (e[1], e[0])):
            if 0 <= done < ts - self.silence:
                end(done, True)
            done = ts
            if kind == "end":
                end(ts, False)
            elif kind == "start":
                t0 = ts / 1000
            else:
                own.take(ts / 1000, piece)
        held = [e for e in held if e[1] > watermark]
        if done >= 0 and watermark > done + self.silence:
            end(done, True)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if done < 0 and not held:
            self.state.clear()
            self.held.clear()
        else:
            self.state.update((own.seen, own.thought, own.t_answer, own.thinking, own.n, own.t_first, own.t_last, t0, done))
            self.held.put(held) if held else self.held.clear()
            self.handle.registerTimer(min([e[1] for e in held] + ([done + self.silence + 1] if done >= 0 else [])))
        if ended:
            yield frame([e[:6] for e in ended]).assign(t0=[e[6] for e in ended], t_end=[e[7] for e in ended], silent=[e[8] for e in ended]).astype({"t0": float})


def stream_figures(events: DataFrame, late: str = "30 seconds", silence: int = 600_000) -> DataFrame:
    """(req_id, FIGURES, t0, t_end, silent) of a stream of events (req_id, seq, ts, kind, piece), a row for each request when it ends.

    kind is start, piece or end; ts is the time of the event. State: one Progress for each open request, and its events of the
    last `late` before the watermark. State is kept by RocksDB, which the session must name as its provider.
    """
    ready(events.sparkSession)
    rows = events.withWatermark("ts", late).select("req_id", F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("millis"), "kind", F.coalesce("piece", F.lit("")).alias("piece"))
    kind = events.schema["req_id"].dataType.simpleString()
    out = f"req_id {kind}, {FIGURES}, t0 double, t_end double, silent boolean"
    return rows.groupBy("req_id").transformWithStateInPandas(RequestFigures(silence), outputStructType=out, outputMode="Append", timeMode="EventTime")
