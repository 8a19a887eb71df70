import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.generation import stream_stats
from lodestone.streaming.figures import Progress, shown, stream_figures

EVENTS = "req_id string, seq long, ts timestamp, kind string, piece string"
FIGURES = ["n_tokens", "thinking_tokens", "ttft_s", "ttft_answer_s", "decode_s"]


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def requests(rng, n):
    """Events of requests: reasoning or none, tags in one piece or split, blanks, and answers that never come."""
    events = []
    for r in range(n):
        begin = rng.randrange(0, 200)
        think = rng.choice([[], ["<think>", "a", " b", "</think>", " "], ["<", "think>", "x", "</th", "ink>"], ["<think>all</think>"], ["<think>", "no", " end"]])
        pieces = [*think, *rng.choice([[], ["", "Hi", " there"], [" ", "\n", "ok"], ["/no_think", " yes"]])]
        events += [(f"r{r}", 0, at(begin), "start", None)] + [(f"r{r}", k + 1, at(begin + k + 1), "piece", p) for k, p in enumerate(pieces)]
        events.append((f"r{r}", len(pieces) + 1, at(begin + len(pieces) + 2), "end", ""))
    return events


def streamed(spark, tmp_path, batches, late="60 seconds", silence=600_000):
    """Each batch is a micro-batch; two more bring the watermark past all of them."""
    closing = [[("z", 0, at(10**5), "start", "")], [("z", 1, at(2 * 10**5), "end", "")]]
    for k, rows in enumerate([*batches, *closing]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = stream_figures(stream, late, silence).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(240)
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{tmp_path}/out").filter("req_id <> 'z'"), states


def as_figures(rows):
    out = {}
    for r in rows:
        ttft = r.t_first - r.t0 if r.t_first is not None else 0.0
        answer = r.t_answer - r.t0 if r.t_answer is not None else ttft
        out[r.req_id] = (r.n_tokens, r.thinking_tokens, round(ttft, 3), round(answer, 3), round(r.t_last - r.t_first, 3) if r.t_first is not None else 0.0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_equals_the_batch(spark, tmp_path, seed):
    """Any split into micro-batches, with events out of order by less than the watermark's delay."""
    rng = random.Random(seed)
    events = requests(rng, 40)
    frame = spark.createDataFrame(events, EVENTS)
    t = F.unix_millis("ts") / 1000
    spans = frame.groupBy("req_id").agg(F.min(F.when(F.col("kind") == "start", t)).alias("t0"), F.max(F.when(F.col("kind") == "end", t)).alias("t_end"))
    want = {r.req_id: tuple(round(float(r[c]), 3) for c in FIGURES) for r in stream_stats(frame.filter("kind = 'piece'").select("req_id", "seq", t.alias("t"), "piece"), spans).collect()}
    events.sort(key=lambda e: e[2] + datetime.timedelta(seconds=rng.randrange(50)))
    cuts = sorted(rng.sample(range(1, len(events)), 2 + seed))
    batches = [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True)]
    rows, states = streamed(spark, tmp_path, batches)
    rows = rows.collect()
    assert len(rows) == 40 and not any(r.silent for r in rows)
    assert as_figures(rows) == want
    assert states[-1] <= 4  # of the closing request alone


def test_silent_requests_end_by_themselves(spark, tmp_path):
    """A request without an end is given when its silence is over; what it says after that is a request of its own."""
    one = [("a", 0, at(0), "start", ""), ("a", 1, at(5), "piece", "x"), ("b", 0, at(3), "start", "")]
    two = [("b", 1, at(6), "piece", "y"), ("b", 2, at(7), "end", ""), ("a", 2, at(2000), "piece", "again")]
    rows, _ = streamed(spark, tmp_path, [one, two], silence=100_000)
    got = sorted((r.req_id, r.n_tokens, r.silent, r.t_end - at(0).replace(tzinfo=datetime.timezone.utc).timestamp()) for r in rows.collect())
    assert got == [("a", 1, True, 5.0), ("a", 1, True, 2000.0), ("b", 1, False, 7.0)]


def test_state_of_a_long_answer_is_short():
    """Of a reasoning block of a million pieces its last characters are kept; of an answer nothing."""
    own = Progress()
    own.take(0.0, "<think>")
    for k in range(100_000):
        own.take(k, "step ")
        assert len(own.seen) < 40
    own.take(5.0, "</th")
    own.take(6.0, "ink> done")
    assert own.t_answer == 6.0 and own.seen == "" and own.thinking == 100_002
    assert shown("<think>a</think> b /no_think c") == "b c" and shown("x</think> y") == "y"
