"""Scores of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_refusal, keyword_hit, number_grounding, strip_thinking

#: Fixed values.
KS, DIGITS, NEGATIVE = (1, 3, 5), 4, "negative"


def first_gold(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, first): the least rank of a hit (qid, rank, doc_id) in the question's gold_docs, null if there is none.
    Questions without gold are left out.
    """
    scored = questions.filter(F.size("gold_docs") > 0)
    gold = scored.select("qid", F.explode(F.array_distinct("gold_docs")).alias("doc_id"))
    return scored.select("qid").join(first_found(hits, gold), "qid", "left")


def first_found(hits: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(qid, first), of each configuration if `by` names columns of it: the least rank of a hit (qid, rank, doc_id) that is among the
    pairs gold (qid, doc_id). Questions without such a hit are left out.
    """
    return hits.join(gold, ["qid", "doc_id"], "left_semi").groupBy(*(by or []), "qid").agg(F.min("rank").alias("first"))


def retrieval_scores(first: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """n_questions, recall_at_k for each k, and mrr; of each configuration, if `by` names columns of it. With a column retrieval_s
    also latency_ms_median.
    """
    rate = lambda c: F.coalesce(F.round(F.avg(c), DIGITS), F.lit(0.0))
    found = [rate(F.when(F.col("first") < k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    timed = [F.coalesce(F.round(F.percentile(F.col("retrieval_s") * 1000, 0.5), 3), F.lit(0.0)).alias("latency_ms_median")] if "retrieval_s" in first.columns else []
    return first.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_questions"), *found, *timed, rate(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))).alias("mrr"))


def sweep(hits: DataFrame, ks: DataFrame) -> DataFrame:
    """hits for each top_k of the configurations (config, top_k): the k is a column, not a loop."""
    return hits.crossJoin(F.broadcast(ks)).filter(F.col("rank") < F.col("top_k"))


def must_include_groups(json: Column) -> Column:
    """A JSON array of texts and arrays of texts as groups of alternatives."""
    entries = F.variant_get(F.parse_json(json), "$", "array<variant>")
    return F.transform(entries, lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(F.try_variant_get(v, "$", "string"))))


def score_answers(answers: DataFrame) -> DataFrame:
    """answers (qid, type, answer, context, must_include array<array<string>>) with what a reader sees and its scores."""
    seen = answers.withColumn("visible", strip_thinking(F.col("answer")))
    grounding = number_grounding(F.col("visible"), F.col("context"))
    return seen.withColumns({"keyword_ok": keyword_hit(F.col("visible"), F.col("must_include")), "refused": is_refusal(F.col("visible")), "grounding": grounding})


def median_of_nonzero(c: str) -> Column:
    return F.coalesce(F.round(F.percentile(F.when(F.col(c) != 0, F.col(c)), 0.5), DIGITS), F.lit(0.0))


def per_question_medians(runs: DataFrame, columns: list[str]) -> DataFrame:
    return runs.groupBy("qid").agg(*[F.percentile(c, 0.5).alias(c) for c in columns])


def generation_scores(scored: DataFrame, medians: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Rates over answerable questions (keywords, false refusals, grounded numbers) and refusals of negative ones.

    Rates without any question are 0; grounding without any number is 1.
    """
    negative = F.col("type") == NEGATIVE
    rate = lambda c, where: F.coalesce(F.round(F.avg(F.when(where, c.cast("double"))), DIGITS), F.lit(0.0))
    total = lambda c: F.sum(F.when(~negative, F.col(f"grounding.{c}")))
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_questions"),
        rate(F.col("keyword_ok"), ~negative).alias("keyword_accuracy"),
        rate(F.col("refused"), negative).alias("refusal_rate_on_negatives"),
        rate(F.col("refused"), ~negative).alias("false_refusal_rate"),
        F.coalesce(F.round(F.try_divide(total("grounded"), total("total")), DIGITS), F.lit(1.0)).alias("number_grounding"),
        *[median_of_nonzero(c).alias(f"{c}_median") for c in medians or []],
    )
