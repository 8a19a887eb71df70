"""Exact de-duplication over an extendible-hash index kept in shared files.

Texts are hashed to 64-bit keys. A directory over the leading bits of the key doubles until no bucket holds more
than `capacity` keys. Rows are routed by it to owner tasks, which each take a range of buckets, group what they get by
its bytes, chain the texts whose keys collide, and write their part of the index; documents are then looked up by bucket
and key in these chains. Equal keys alone never make two texts equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_one, stored, table, texts

#: The directory never grows beyond 2 ** MAX_DEPTH entries; from some 8.6 thousand million keys on its buckets hold more than
#: their capacity, and none is lost.
MAX_DEPTH = 20


#: Copies of keys with more rows than HOT, or than one row in MOST, meet in the task that reads them, before they are routed;
#: so there are at most MOST such keys, of 8 bytes each.
HOT, MOST = 64, 1 << 20


def distinct_texts(docs: DataFrame, task: Column | None = None) -> DataFrame:
    """(h, sha, text, keep_id, group_size), one row per distinct text, or per distinct text of each task.

    Copies meet before the shuffle, in the map side of the aggregation, so a text with a third of all rows is one
    row per task when it is shuffled.
    """
    return (
        texts(docs)
        .withColumn("task", F.lit(0) if task is None else task)
        .groupBy("task", F.xxhash64("text").alias("h"), "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "text", "keep_id", "group_size")
    )


def parts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (h, sha, text, keep_id, group_size) to be routed for rows (doc_id, text): one per document, but one per task
    for the texts of hot keys. keys: (h, n).
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(stored(keys.filter(F.col("n") > max(HOT, total / MOST)).select("h")))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    few = keyed.join(hot, "h", "left_anti").select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return few.unionByName(distinct_texts(keyed.join(hot, "h", "left_semi"), F.spark_partition_id()))


def directory(keys: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The directory (entry, depth, bucket; only entries with keys) of the extendible hash over h, and its own depth.

    It starts with one entry and doubles while a bucket is overfull; each doubling reads again only the counts per
    slot (at most 2 ** max_depth). An entry's bucket is that of its shortest prefix with no more than `capacity` keys.
    """
    slots = stored(keys.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    depth = 0
    while True:
        entries = slots.groupBy(F.shiftright("slot", max_depth - depth).alias("entry")).agg(F.sum("n").alias("n"))
        if depth == max_depth or entries.filter(F.col("n") > capacity).isEmpty():
            break
        depth += 1
    entries = stored(entries)
    above = entries.selectExpr("entry", "n", f"explode(sequence(0, {depth})) AS d").selectExpr("entry", "n", "d", f"shiftright(entry, {depth} - d) AS prefix")
    fits = above.groupBy("d", "prefix").agg(F.sum("n").alias("held")).filter((F.col("held") <= capacity) | (F.col("d") == depth))
    own = above.join(fits, ["d", "prefix"]).groupBy("entry").agg(F.min("d").alias("depth"))
    return own.selectExpr("entry", "depth", f"shiftleft(shiftright(entry, {depth} - depth), {depth} - depth) AS bucket"), depth


def routed(rows: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket of their key h. The directory is broadcast: it has at most 2 ** MAX_DEPTH entries of 3 numbers,
    and an entry with a popular text is no hot key.
    """
    entry = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    return rows.withColumn("entry", entry).join(F.broadcast(entries), "entry").drop("entry")


def owned(rows: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """The index files: (bucket, depth, h, chain, sha, keep_id, group_size), written by owners of bucket ranges.

    Rows that are equal but for keep_id and group_size are of one text; an owner has all of its buckets' rows, so it
    groups them without another shuffle. chain is the place of a text among those with the same key.
    """
    same = [c for c in rows.columns if c not in ("h", "keep_id", "group_size")]
    dealt = routed(rows, entries, depth).repartitionByRange("bucket", "h")
    groups = dealt.groupBy("bucket", "depth", "h", *same).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chains = Window.partitionBy("bucket", "h").orderBy("sha")
    return stored(groups.select("bucket", "depth", "h", "sha", "keep_id", "group_size").withColumn("chain", F.row_number().over(chains)))


def build_index(rows: DataFrame, capacity: int = 8192, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index of rows (h, sha, keep_id, group_size), or with the text too."""
    return owned(rows, *directory(rows.select("h").distinct(), capacity, max_depth))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 8192) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; a null text counts as empty and so equals other nulls and empty texts. Of equal
    texts the largest doc_id stays; null ids rank lowest. Rows that repeat both text and doc_id tie, and have the
    same answer. Texts of any length are compared whole. Further columns are ignored. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    keys = stored(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n")))
    entries, depth = directory(keys, capacity)
    entries = stored(entries)
    index = owned(parts(rows, keys), entries, depth)
    dropped(keys)
    asked = routed(rows.select("doc_id", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha")), entries, depth)
    # Documents of popular texts meet their row of the index where they are.
    found = join_one(asked, index.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"], "group_size")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
