"""Text functions as expressions on Columns; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that are tokenised as CJK, those that a question's language is told by, and what
#: ends a sentence. The two ranges differ.
CJK_TOKEN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
CJK_LANGUAGE = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{8c48}-\x{faff}"
LATIN_TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
SENTENCE_END = "。！？；!?;"
#: Characters of a window of prose, and of its overlap with the one before.
WINDOW_CHARS, OVERLAP_CHARS = 240, 40


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: lambda bodies work out what they hold for every element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Runs of blanks, tabs and ideographic spaces as one blank; line ends inside stay."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\x{00a0}", " "), r"[ \t\x{3000}]+", " "))


def collapse(c: Column) -> Column:
    """All runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokenize(c: Column) -> Column:
    """Latin words and numbers (with inner dots and hyphens), then single characters and pairs of each CJK run."""
    low = F.lower(c)
    latin = F.regexp_extract_all(low, F.lit(f"({LATIN_TOKEN})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK_TOKEN}]+)"), F.lit(1))

    def grams(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(n > 1, F.concat(singles, pairs)).otherwise(singles)

    return F.concat(latin, F.flatten(F.transform(runs, grams)))


LATIN_RUN, CJK_RUN = re.compile(LATIN_TOKEN), re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")


def tokens_of(text: str) -> list[str]:
    """What tokenize() gives, in Python: Spark doesn't hand expressions with lambdas to Python functions."""
    low = text.lower()
    grams = [run[i : i + n] for run in CJK_RUN.findall(low) for n in (1, 2) for i in range(len(run) - n + 1)]
    return LATIN_RUN.findall(low) + grams


def detect_language(c: Column) -> Column:
    """zh if there are CJK characters and at least half as many as ASCII letters, else en."""
    cjk = F.regexp_count(c, F.lit(f"[{CJK_LANGUAGE}]"))
    letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (cjk * 2 >= letters), "zh").otherwise("en")


def normalise_key(c: Column) -> Column:
    """Lower case, without white space, slashes and parentheses."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s/()（）]+", ""))


def anchored(key_zh: Column, key_en: Column, body: Column) -> Column:
    """`zh / en: body`; one key if they are equal or one is empty."""
    both = (key_zh != "") & (key_en != "") & (key_zh != key_en)
    return F.when(both, F.concat(key_zh, F.lit(" / "), key_en, F.lit(": "), body)).otherwise(F.concat(F.when(key_zh != "", key_zh).otherwise(key_en), F.lit(": "), body))


def sentences(c: Column) -> Column:
    """Parts of collapsed text, each up to and with a character that ends sentences."""
    parts = F.split(collapse(c), rf"(?<=[{SENTENCE_END}])\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")  # trim by itself would get the index, too


def windows(c: Column, limit: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Whole sentences packed into windows of about `limit` characters. A window that is full hands its last `overlap`
    characters on to the next; a longer sentence is a window by itself.
    """
    whole = collapse(c)
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))

    def pack(state: Column, sentence: Column) -> Column:
        packed = F.trim(F.concat(state["open"], F.lit(" "), sentence))
        next_open = F.trim(F.concat(F.right(state["open"], F.lit(overlap)), F.lit(" "), sentence))
        over = (state["open"] != "") & (F.length(state["open"]) + F.length(sentence) + 1 > limit)
        return F.struct(
            F.when(over, F.concat(state["full"], F.array(state["open"]))).otherwise(state["full"]).alias("full"),
            F.when(over, next_open).otherwise(packed).alias("open"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["open"] != "", F.concat(state["full"], F.array(state["open"]))).otherwise(state["full"])

    return F.when(F.length(whole) <= limit, F.array(whole)).otherwise(F.aggregate(sentences(c), start, pack, finish))


#: Phrases of a refusal.
REFUSAL_MARKERS = [
    "沒有這項資訊",
    "沒有提到",
    "未提供",
    "沒有提供",
    "查無",
    "無法確認",
    "資料中沒有",
    "not in the provided",
    "not provided",
    "does not specify",
    "no information",
    "not mentioned",
    "not listed",
    "cannot determine",
]


def is_refusal(answer: Column) -> Column:
    markers = F.array(*[F.lit(m) for m in REFUSAL_MARKERS])
    return let(F.lower(answer), lambda low: F.exists(markers, lambda m: F.contains(low, m)))


def keyword_hit(answer: Column, groups: Column) -> Column:
    """Every group (array of alternatives) has a member in the answer, whatever the case; no groups: true."""
    hit = let(F.lower(answer), lambda low: F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(low, F.lower(t)))))
    return F.coalesce(hit, F.lit(True))


def answer_numbers(answer: Column) -> Column:
    """Numbers of an answer, without citation marks."""
    return F.regexp_extract_all(F.regexp_replace(answer, r"(?U)\[\d+\]", " "), F.lit(r"(?U)(\d+(?:[.,]\d+)*)"), F.lit(1))


def number_grounding(answer: Column, context: Column) -> Column:
    """struct(grounded, total): numbers of the answer that are in the context, thousands separators aside."""
    numbers = answer_numbers(answer)
    without = lambda c: F.replace(c, F.lit(","), F.lit(""))
    found = let(without(context), lambda bare: F.filter(numbers, lambda n: F.contains(bare, without(n))))
    return F.struct(F.size(found).alias("grounded"), F.size(numbers).alias("total"))


def strip_thinking(c: Column) -> Column:
    """Without reasoning blocks, what stands before an orphaned end of one, and echoed switches."""
    out = F.regexp_replace(c, r"(?Us)<think>.*?</think>\s*", "")
    # Only the first orphaned end counts: the pattern is tied to the start of the text.
    out = F.when(F.contains(out, F.lit("</think>")), F.regexp_replace(out, r"(?Us)\A.*?</think>\s*", "")).otherwise(out)
    return strip(F.regexp_replace(out, r"(?U)\s*/no_(?:think|output)\b\s*", " "))
