"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, ready, scratch, shared_dir, stored, table

__all__ = ["crc_mod", "dropped", "hot_keys", "join_one", "ready", "scratch", "shared_dir", "stored", "table", "texts"]

#: A key with more than one row in so many is hot: there are fewer of them than that, whatever the size of the input.
HOT_SHARE = 4096


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def hot_keys(counts: DataFrame, n: str, total: int | None = None) -> DataFrame:
    """The rows of counts (a key, its number of rows n) whose key holds more than one row in HOT_SHARE: fewer than
    HOT_SHARE rows, stored.
    """
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    return stored(counts.filter(F.col(n) > total / HOT_SHARE))


def join_one(rows: DataFrame, other: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with other, which has one row for each key and in n the number of rows of the key.

    The rows of other for hot keys are broadcast (see hot_keys), and so rows of a hot key stay where they are; only the
    others are shuffled. Both are read twice: they should be stored, or cheap.
    """
    hot = hot_keys(other, n)
    often = rows.join(F.broadcast(hot), keys)
    seldom = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(other.join(F.broadcast(hot.select(*keys)), keys, "left_anti"), keys)
    return often.unionByName(seldom)
