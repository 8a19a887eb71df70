"""URL rules by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions `suffix of host` + `prefix of path`; the first bytes of their digests
are joined with those of the rules, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_one, stored, table

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: What a URL gets that no rule fits.
DEFAULT_VERDICT = "allow"
#: Hex digits of the digest that are joined on.
SHORT = 8
#: Up to so many rules (of at most some 200 bytes each) go to every executor; more are joined by a shuffle.
BROADCAST_RULES = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)")


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every suffix of the host with one of these numbers of labels, with every prefix of the path of these lengths."""
    parts = F.split(host, r"\.", -1)
    wanted = F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(parts))
    suffixes = F.transform(wanted, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path begins with the rule's. The
    longest rule wins; of equally long ones `block` wins, then the later in alphabetical order. Without a rule,
    rule is null and the verdict is `default`. Null or malformed URLs have empty host and path. Repeated rows and
    null ids are kept as they are; further columns are ignored; empty tables give empty results.

    Only label counts and path lengths that some rule has are expanded, which loses no match. Their number is bounded
    by the length of a URL, not by the number of rules.
    """
    rule = F.concat(F.coalesce(F.col("host"), F.lit("")), F.coalesce(F.col("path"), F.lit("")))
    known = rules.select(
        rule.alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.sha2(rule, 256).alias("digest"),
        F.size(F.split(F.coalesce(F.col("host"), F.lit("")), r"\.", -1)).alias("labels"),
        F.length(F.coalesce(F.col("path"), F.lit(""))).alias("length"),
    )
    shapes = known.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    host, path = split_url(F.col("u"))
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    if not shapes.n:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hashed = known.select("rule", "rule_verdict", F.col("digest").alias("rule_digest"), F.left("digest", F.lit(SHORT)).alias("short"))
    hashed = F.broadcast(hashed) if shapes.n <= BROADCAST_RULES else hashed
    # Each distinct URL is judged once.
    distinct = stored(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    expanded = (
        distinct.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes.labels, shapes.lengths)).alias("e"))
        .select("host", "path", F.sha2("e", 256).alias("digest"))
        .withColumn("short", F.left("digest", F.lit(SHORT)))
    )
    rank = F.struct(F.length("rule"), F.col("rule_verdict") == "block", F.col("rule"))
    best = (
        expanded.join(hashed, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(rank.alias("rank"), "rule", "rule_verdict")).alias("best"))
    )
    verdict = F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict")
    judged = stored(distinct.join(best, ["host", "path"], "left").select("host", "path", "n", F.col("best.rule").alias("rule"), verdict))
    return join_one(parsed, judged, ["host", "path"], "n").select("page_id", "host", "path", "rule", "verdict")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), default_rules(spark))


ORACLE_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, row_number() OVER () AS rid,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ranked AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict AS v,
                  row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC) AS k
           FROM parsed p LEFT JOIN rules r
             ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT_VERDICT}') AS verdict FROM ranked WHERE k = 1
"""
