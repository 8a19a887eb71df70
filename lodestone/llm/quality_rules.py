"""Rules of quality for documents and for the hosts that they come from.

Every document is held against a few rules. Failures are added up for each host, a beta prior is fitted to all hosts'
rates by their moments, and each host's rate of each rule is shrunk towards it. A host that fails a rule mostly takes its
documents along. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import join_one, stored, table

#: White space between words, symbols, words of a window, and the limits of the base rules.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Limits of the rules that count for hosts alone: symbols a 100 words, lines of 100 that are copies, mean letters of a word.
MOST_SYMBOLS, MOST_COPIED, WORD_LETTERS = 10, 30, (3, 10)
#: A host whose shrunk rate of failures of a rule is above this is rejected.
HOST_LIMIT = 0.5
#: The least share of the variance of failures that is put down to hosts: the prior weighs 1 / this documents at most.
LEAST_SPREAD = 1e-6


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """How many words lie in windows of WINDOW words that are found twice or more in the array, the first included.

    Windows are told apart by two 64-bit hashes. Equal ones stand side by side once sorted, so it takes n log n steps.
    """
    last = F.size(ws) - WINDOW
    places = F.sequence(F.lit(0), last)
    window = lambda i: [F.get(ws, i + k) for k in range(WINDOW)]

    def found() -> Column:
        keys = F.transform(places, lambda i: F.struct(F.xxhash64(*window(i)).alias("h"), F.hash(*window(i)).alias("g"), i.alias("at")))
        return let(F.array_sort(keys), lambda ks: covered(F.filter(ks, lambda k, n: same(k, F.get(ks, n - 1)) | same(k, F.get(ks, n + 1)))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    def covered(ks: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
        step = lambda a, k: F.struct((a["n"] + F.least(F.lit(WINDOW), k - a["at"])).alias("n"), k.alias("at"))
        return F.aggregate(F.array_sort(F.transform(ks, lambda k: k["at"])), start, step, lambda a: a["n"])

    # Most texts repeat nothing, which the hashes alone tell.
    hashes = F.transform(places, lambda i: F.xxhash64(*window(i)))
    repeats = let(hashes, lambda hs: F.size(F.array_distinct(hs)) < F.size(hs))
    return F.when(last < 1, F.lit(0).cast("long")).when(repeats, found()).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), a row for each row.

    host is the column's value after an equals sign, or empty where that is null. A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), text.alias("text"))
    return rows.select(
        "doc_id",
        "host",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))).alias("l"),
    ).select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def rules() -> dict[str, Column]:
    """Whether a document of measures() fails each rule. The first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * n,
        "copied_lines": 100 * F.col("n_dup_lines") > MOST_COPIED * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_LETTERS[0] * n) | (F.col("word_chars") > WORD_LETTERS[1] * n),
    }


def base_failed() -> Column:
    failed = rules()
    return failed["short"] | failed["repeated"]


def failures(measured: DataFrame) -> DataFrame:
    """(host, n, rule, failed): documents of each host and how many of them fail each rule; a task adds up its own first."""
    sums = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(failed).alias(name) for name, failed in rules().items()))
    return sums.unpivot(["host", "n"], list(rules()), "rule", "failed")


def priors(by_host: DataFrame) -> DataFrame:
    """(rule, mean, weight): the beta prior of each rule, weight being the documents that it counts as.

    spread is the share of the variance of failures that hosts explain (1 / (weight + 1)), by the moments of the hosts'
    rates, each weighed by its documents.
    """
    total = by_host.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("hosts"))
    mean = F.col("failed") / F.col("n")
    chance = (F.col("hosts") - 1) / F.col("n")
    spread = F.try_divide(F.try_divide(F.col("squares") / F.col("n") - mean * mean, mean * (1 - mean)) - chance, 1 - F.col("nn") / F.col("n") / F.col("n") - chance)
    bounded = F.greatest(F.lit(LEAST_SPREAD), F.least(F.lit(1.0), F.coalesce(spread, F.lit(0.0))))
    return total.select("rule", mean.alias("mean"), (1 / bounded - 1).alias("weight"))


def hosts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, rates, rejected): shrunk rates of failures by rule, and whether one of them is above the limit."""
    by_host = failures(measured)
    prior = F.broadcast(priors(by_host))  # one row for each rule
    rate = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    shrunk = by_host.join(prior, "rule").withColumn("rate", rate)
    return shrunk.groupBy("host", "n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "rate")))).alias("rates"), (F.max("rate") > limit).alias("rejected"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, host_rejected and kept.

    A null text counts as empty, and so fails for want of words; rows without a host are a host of their own. Rows that
    repeat one another count each and get equal verdicts; null ids are kept; further columns are ignored. With a single
    host the prior is that host's own rate. An empty table gives an empty result.
    """
    measured = stored(measures(docs, id_col, text_col, host_col))
    judged = join_one(measured, stored(hosts(measured, limit)), ["host"], "n").withColumnRenamed("rejected", "host_rejected")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), "host_rejected", (~base_failed() & ~F.col("host_rejected")).alias("kept"),
    )


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT rn, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM base),
grams AS (SELECT rn, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rn, ws, unnest(range(1, len(ws) - 3)) AS i FROM words WHERE len(ws) >= 5)),
twice AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM grams),
steps AS (SELECT rn, i - lag(i, 1, -9) OVER (PARTITION BY rn ORDER BY i) AS step FROM twice WHERE n >= 2),
repeated AS (SELECT rn, sum(least(5, step)) AS n_repeat_words FROM steps GROUP BY rn),
measured AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN repeated USING (rn)),
by_rule AS (
    SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM (
        SELECT source, unnest(['a', 'b', 'c', 'd', 'e']) AS rule, unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words,
            100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed FROM measured)
    GROUP BY source, rule),
sums AS (SELECT rule, sum(n)::DOUBLE AS n, sum(f) / sum(n) AS mean, sum(f::DOUBLE * f / n) AS squares, sum(n::DOUBLE * n) AS nn, (count(*) - 1) / sum(n) AS chance FROM by_rule GROUP BY rule),
priors AS (SELECT rule, mean, 1 / greatest(1e-6, least(1.0, coalesce(
    ((squares / n - mean * mean) / nullif(mean * (1 - mean), 0) - chance) / nullif(1 - nn / n / n - chance, 0), 0.0))) - 1 AS weight FROM sums),
hosts AS (SELECT source, max((f + mean * weight) / (n + weight)) > 0.5 AS rejected FROM by_rule JOIN priors USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    rejected AS host_rejected, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT rejected AS kept
FROM measured m JOIN hosts h ON m.source IS NOT DISTINCT FROM h.source
"""
