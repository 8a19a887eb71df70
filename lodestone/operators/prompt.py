"""Prompts: as much of the ranked context as fits, and the messages around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_language

#: Characters of a context, and what stands above the context and the question.
MAX_CONTEXT_CHARS = 2400
REFERENCE_HEADER = {"zh": "參考資料：", "en": "Reference:"}
QUESTION_HEADER = {"zh": "問題：", "en": "Question:"}


def default_system(product: str) -> dict[str, str]:
    """What an assistant for this product is told. Other wordings can be given wherever these are used."""
    return {
        "zh": f"你是 {product} 的規格查詢助理。只根據參考資料作答，可組合多筆資料；數字逐字照抄，不換算、不四捨五入；先寫完整答案，句尾加上來源編號。參考資料沒有相關資訊時，只回答「提供的規格資料中沒有這項資訊」。請用繁體中文。",
        "en": f"You answer questions on the specifications of {product}. Use the Reference only, and combine entries where needed. Quote values verbatim, without conversion or rounding. Write the full answer, then the source number. If the Reference has nothing on it, answer only: That information is not in the provided specifications. Answer in English.",
    }


def default_plain(product: str) -> dict[str, str]:
    """The same without reference, as a control."""
    return {"zh": f"你是規格助理。請直接回答使用者關於 {product} 的問題。", "en": f"You are a specification assistant. Answer the user's question on the {product} directly."}


def by_language(texts: dict[str, str], lang: Column) -> Column:
    return F.when(lang == "zh", texts["zh"]).otherwise(texts["en"])


def packed(hits: DataFrame, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """The hits (qid, rank, text, ...) that fit, with their line: `[n] text`. What comes later by rank is left out first.

    Lines before and with a hit and the line ends between them must not be longer than max_chars; as lengths only
    add up, this is the same as taking hits off the end until the rest fits.
    """
    by_rank = Window.partitionBy("qid").orderBy("rank")
    numbered = hits.withColumn("line", F.concat(F.lit("["), F.row_number().over(by_rank).cast("string"), F.lit("] "), F.col("text")))
    length = F.sum(F.length("line") + 1).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return numbered.withColumn("upto", length).filter(F.col("upto") <= max_chars)


def context(packed_hits: DataFrame) -> DataFrame:
    """(qid, context, n_used)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return packed_hits.groupBy("qid").agg(F.array_join(lines, "\n").alias("context"), F.count(F.lit(1)).alias("n_used"))


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def build_prompts(queries: DataFrame, hits: DataFrame, system: dict[str, str], max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """(qid, question, lang, system, user, context, n_used, context_chars, messages) for queries (qid, text[, lang])."""
    lang = F.coalesce("lang", detect_language(F.col("text"))) if "lang" in queries.columns else detect_language(F.col("text"))
    asked = queries.select("qid", F.col("text").alias("question"), lang.alias("lang"))
    rows = asked.join(context(packed(hits, max_chars)), "qid", "left").withColumns({"context": F.coalesce("context", F.lit("")), "n_used": F.coalesce("n_used", F.lit(0))})
    rows = rows.withColumn("system", by_language(system, F.col("lang")))
    user = F.concat(by_language(REFERENCE_HEADER, F.col("lang")), F.lit("\n"), F.col("context"), F.lit("\n\n"), by_language(QUESTION_HEADER, F.col("lang")), F.col("question"))
    return rows.withColumn("user", user).withColumns({"context_chars": F.length("context"), "messages": messages(F.col("system"), F.col("user"))})


def build_plain_prompts(queries: DataFrame, system: dict[str, str]) -> DataFrame:
    """The control without context: (qid, question, lang, messages)."""
    asked = queries.select("qid", F.col("text").alias("question"), detect_language(F.col("text")).alias("lang"))
    return asked.withColumn("messages", messages(by_language(system, F.col("lang")), F.col("question")))


def with_thinking_switch(messages_col: Column, switch: str) -> Column:
    """The switch after the first system message; as a message of its own where there is none."""
    first = F.array_position(F.transform(messages_col, lambda m: m["role"]), "system")
    add = lambda m, i: F.struct(m["role"].alias("role"), F.when(i + 1 == first, F.concat(m["content"], F.lit(" " + switch))).otherwise(m["content"]).alias("content"))
    own = F.array(F.struct(F.lit("system").alias("role"), F.lit(switch).alias("content")))
    return F.when(first > 0, F.transform(messages_col, add)).otherwise(F.concat(own, messages_col))
