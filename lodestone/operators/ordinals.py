"""Numbers of rows in an order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of one range, unless there are more tasks than that calls for.
RANGE_ROWS = 65_536


def ranges(df: DataFrame, order: list[Column], rows: int | None = None) -> DataFrame:
    """df in ranges of the order, stored, with seq: it rises in the order, and its upper bits (see range_of) are the range.

    Rows that tie are spread over ranges as well as others.
    """
    n = df.count() if rows is None else rows
    parts = max(1, -(-n // RANGE_ROWS), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    tied = [*order, F.monotonically_increasing_id()]
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(tied)})
    keys = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(tied))]
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stored(dealt.drop(*(f"_o{i}" for i in range(len(tied)))).withColumn("seq", F.monotonically_increasing_id()))


def range_of(seq: Column) -> Column:
    return F.shiftright(seq, 33)


def range_starts(dealt: DataFrame, group: list[str] = ()) -> DataFrame:
    """(range, *group, first, total) of a table from ranges(): how many rows of the group lie in ranges before this one, and
    in all. Only counts are summed up, a row for each range and group.
    """
    counts = dealt.groupBy(range_of(F.col("seq")).alias("range"), *group).agg(F.count(F.lit(1)).alias("n"))
    if not group:
        # Block sums first, so that no task gets a row for every range.
        block = F.shiftright("range", 10)
        blocks = counts.groupBy(block.alias("_b")).agg(F.sum("n").alias("_n"))
        before = blocks.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
        inside = counts.withColumn("_b", block).withColumn("_in", F.sum("n").over(Window.partitionBy("_b").orderBy("range")) - F.col("n"))
        return inside.join(before, "_b").select("range", (F.col("_before") + F.col("_in")).alias("first"), "total")
    place = Window.partitionBy(*group).orderBy("range")
    return counts.select("range", *group, (F.sum("n").over(place) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy(*group)).alias("total"))


def with_ordinals(df: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """df with its rows' places in the order, from 0 on, under `name`. Rows that tie get different places, in no set order.

    The order is dealt out by ranges; a range's rows are counted, and numbered from the sum of the counts before it.
    """
    dealt = ranges(df, order)
    starts = range_starts(dealt)
    local = F.row_number().over(Window.partitionBy("_range").orderBy("seq")) - 1
    numbered = dealt.withColumn("_range", range_of(F.col("seq"))).withColumn("_k", local)
    return numbered.join(starts.select(F.col("range").alias("_range"), "first"), "_range").withColumn(name, F.col("first") + F.col("_k")).drop("_range", "_k", "seq", "first")
