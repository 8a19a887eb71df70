"""Rankings into hits: reciprocal-rank fusion, key boost, tie order, per-document cap and rescue of top hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_key

#: Fixed values.
RRF_K, POOL, KEY_BOOST, MAX_PER_DOC, FLOOR_SHARE = 60, 25, 0.35, 2, 0.99
KIND_PRIORITY = {"fact": 0, "spec_line": 1, "spec_row": 2, "feature": 3, "footnote": 4}
OTHER_KIND = 9
DIGITS = 9


def arms_of(*rankings: DataFrame) -> DataFrame:
    """(qid, ord, score, rank, arm): rankings one below the other."""
    out = None
    for n, r in enumerate(rankings):
        r = r.select("qid", "ord", "score", "rank", F.lit(n).alias("arm"))
        out = r if out is None else out.unionByName(r)
    return out


def rrf_fuse(arms: DataFrame, k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(qid, ord, score, first_seen): the sum of weight / (k + rank + 1) over the arms; first_seen orders ties by arm
    and rank.
    """
    weight: Column = F.lit(1.0)
    if weights:
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("arm") + 1)
    return arms.groupBy("qid", "ord").agg(F.round(F.sum(weight / (k + F.col("rank") + 1)), DIGITS).alias("score"), F.min(F.struct("arm", "rank")).alias("first_seen"))


def fuse(arms: DataFrame, mode: str = "hybrid", **options) -> DataFrame:
    """One arm keeps its own scores; hybrid fuses both, and keeps BM25's scores for queries without dense results."""
    own = arms.select("qid", "ord", "score", F.struct("arm", "rank").alias("first_seen"))
    if mode == "dense":
        return own.filter("first_seen.arm = 0")
    if mode == "bm25":
        return own.filter("first_seen.arm = 1")
    if mode != "hybrid":
        raise ValueError(f"mode must be dense, bm25 or hybrid, not {mode!r}")
    has_dense = arms.filter("arm = 0").select("qid").distinct()
    return rrf_fuse(arms.join(has_dense, "qid", "left_semi"), **options).unionByName(own.join(has_dense, "qid", "left_anti"))


CONFIGS = "config string, mode string, rrf_k int, pool int, dense_weight double, bm25_weight double"


def configured(arms: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arms and fuse() for each of many configurations (CONFIGS) in one plan: the qid of what comes back is a struct of config and qid.
    The arms are read as they are; a pool takes the first rows of each. Configurations are broadcast: a sweep has a few.
    """
    both = arms.crossJoin(F.broadcast(configs)).filter(F.col("rank") < F.col("pool"))
    both = both.filter((F.col("mode") == "hybrid") | (F.col("arm") == F.when(F.col("mode") == "dense", 0).otherwise(1)))
    both = both.withColumn("qid", F.struct("config", "qid"))
    has_dense = both.filter("arm = 0 AND mode = 'hybrid'").select("qid").distinct()
    weight = F.when(F.col("arm") == 0, F.col("dense_weight")).otherwise(F.col("bm25_weight"))
    fused = both.join(has_dense, "qid", "left_semi").groupBy("qid", "ord").agg(F.round(F.sum(weight / (F.col("rrf_k") + F.col("rank") + 1)), DIGITS).alias("score"), F.min(F.struct("arm", "rank")).alias("first_seen"))
    own = both.join(has_dense, "qid", "left_anti").select("qid", "ord", "score", F.struct("arm", "rank").alias("first_seen"))
    return both.select("qid", "ord", "score", "rank", "arm"), fused.unionByName(own)


def key_boost(fused: DataFrame, queries: DataFrame, chunks: DataFrame, boost: float = KEY_BOOST) -> DataFrame:
    """Scores times 1 + boost where a key of the chunk (2 characters in zh, 3 in en at least) is in the question."""
    if boost <= 0:
        return fused
    asked = queries.select("qid", normalise_key(F.col("text")).alias("asked"))
    keys = chunks.select("ord", normalise_key(F.col("key_zh")).alias("zh"), normalise_key(F.col("key_en")).alias("en"))
    hit = ((F.length("zh") >= 2) & F.contains("asked", "zh")) | ((F.length("en") >= 3) & F.contains("asked", "en"))
    score = F.when(hit, F.round(F.col("score") * (1 + boost), DIGITS)).otherwise(F.col("score"))
    return fused.join(asked, "qid").join(keys, "ord").select("qid", "ord", score.alias("score"), "first_seen")


def kind_priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(OTHER_KIND))


def diversify(scored: DataFrame, chunks: DataFrame, top_k: int, max_per_doc: int = MAX_PER_DOC) -> DataFrame:
    """(qid, ord, score, rank): in order of score, kind and first_seen, at most max_per_doc of a document and top_k in
    all (1 at least).
    """
    rows = scored.join(chunks.select("ord", "doc_id", kind_priority(F.col("kind")).alias("priority")), "ord")
    order = [F.desc("score"), F.asc("priority"), F.asc("first_seen"), F.asc("ord")]
    capped = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(*order))).filter(F.col("n") <= max_per_doc)
    placed = capped.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)) - 1)
    return placed.filter(F.col("rank") < max(1, top_k)).select("qid", "ord", "score", "rank")


def rescue(selected: DataFrame, arms: DataFrame, top_k: int) -> DataFrame:
    """(qid, ord, score, rank, rescued): each arm's first hit that is not selected is put at the end, a hundredth
    below the lowest score; one place is freed for each arm concerned, even if both miss the same hit.
    """
    tops = arms.filter("rank = 0").select("qid", "ord", "arm")
    missing = tops.join(selected.select("qid", "ord"), ["qid", "ord"], "left_anti")
    freed = missing.groupBy("qid").agg(F.count(F.lit(1)).alias("n_missing"))
    floor = selected.groupBy("qid").agg(F.min_by("score", F.struct(-F.col("rank"))).alias("floor"), F.count(F.lit(1)).alias("n_selected"))
    kept = selected.join(freed, "qid", "left").filter(F.col("n_missing").isNull() | (F.col("rank") < F.greatest(F.lit(0), top_k - F.col("n_missing"))))
    once = missing.groupBy("qid", "ord").agg(F.min("arm").alias("arm"))
    room = freed.join(floor, "qid", "left").select("qid", F.least(F.coalesce("n_selected", F.lit(0)), F.greatest(F.lit(0), top_k - F.col("n_missing"))).alias("n_kept"), F.coalesce("floor", F.lit(0.0)).alias("floor"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("arm"))
    added = once.withColumn("place", place).join(room, "qid").filter(F.col("place") <= top_k - F.col("n_kept"))
    added = added.select("qid", "ord", F.round(F.col("floor") * FLOOR_SHARE, DIGITS).alias("score"), (F.col("n_kept") + F.col("place") - 1).cast("int").alias("rank"), F.lit(True).alias("rescued"))
    return kept.select("qid", "ord", "score", "rank", F.lit(False).alias("rescued")).unionByName(added)


def hits(selected: DataFrame, arms: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hits with each arm's rank (null where it has none) and the chunk's columns."""
    by_arm = arms.groupBy("qid", "ord").agg(F.max(F.when(F.col("arm") == 0, F.col("rank"))).alias("dense_rank"), F.max(F.when(F.col("arm") == 1, F.col("rank"))).alias("bm25_rank"))
    return selected.join(by_arm, ["qid", "ord"], "left").join(chunks, "ord")
