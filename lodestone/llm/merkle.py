"""A Merkle manifest of a dataset: a root for each group of rows, one root over all groups, and a proof for each row.

Leaves are dealt out in ranges of the order, and counted by range and group: sums of the counts before a range give the
places of its leaves. A task then builds all subtrees that lie whole in its range; only nodes whose run crosses the edge of a
range, some 14 for each level and range, are shuffled by their coordinates (group, level, place), a job for each level of
the tree. Paths from there to the root go back to the ranges, where the leaves' proofs are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import range_of, range_starts, ranges, with_ordinals
from .common import crc_mod, dropped, scratch, stored, table

#: Nodes that make up one node of the next level.
ARITY = 8
#: Fixed value: the fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_OF = 3
ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def digest_of(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def group_key(c: Column) -> Column:
    """Strings that sort as the values do, null first, and that join without regard to null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def size_at(n: int, level: int, arity: int) -> int:
    for _ in range(level):
        n = -(-n // arity)
    return n


def pyramid(first: int, digests: list[str], total: int, arity: int = ARITY) -> Iterator[tuple[int, list[str], int, int]]:
    """(start, digests, from, to) for each level: the nodes that leaves first.. of a range make by themselves, of a group of
    total leaves. Those at [from, to) of the level make the nodes of the next one; the others need nodes of other ranges.
    """
    start, size = first, total
    while digests:
        end = start + len(digests)
        low, high = -(-start // arity), (-(-size // arity) if end == size else end // arity)
        if size == 1 or low >= high:
            yield start, digests, start, start
            return
        until = min(high * arity, size)
        yield start, digests, low * arity, until
        digests = [digest_of("".join(digests[at - start : min(at + arity, until) - start])) for at in range(low * arity, until, arity)]
        start, size = low, -(-size // arity)


NODE = "range long, grp string, total long, level int, place long, digest string"


def local_nodes(leaves: DataFrame, starts: DataFrame, arity: int = ARITY) -> DataFrame:
    """NODE: the largest subtrees of every range (leaves: range, seq, grp, leaf; starts: range, grp, first, total)."""

    def run(leaves: pa.Table, starts: pa.Table) -> pa.Table:
        out = []
        first = {g: (f, t) for g, f, t in zip(*(starts.column(c).to_pylist() for c in ("grp", "first", "total")), strict=True)}
        for grp, rows in by_group(leaves.select(["seq", "grp", "leaf"])):
            for level, (start, digests, low, high) in enumerate(pyramid(first[grp][0], [d for _, d in rows], first[grp][1], arity)):
                out += [(leaves["range"][0].as_py(), grp, first[grp][1], level, at, d) for at, d in enumerate(digests, start) if not low <= at < high]
        return arrow(out, ("range", "grp", "total", "level", "place", "digest"), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))

    return leaves.groupBy("range").cogroup(starts.groupBy("range")).applyInArrow(run, NODE)


def by_group(rows: pa.Table) -> list[tuple[str, list[tuple]]]:
    """Rows (seq, grp, ...) in order of seq, as (grp, [(seq, ...)])."""
    found: dict[str, list[tuple]] = {}
    for seq, grp, *rest in sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)):
        found.setdefault(grp, []).append((seq, *rest))
    return list(found.items())


def arrow(rows: list[tuple], names: tuple[str, ...], types: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def levels_of(total: int, arity: int) -> int:
    n = 0
    while total > 1:
        total, n = -(-total // arity), n + 1
    return n


def sizes(total: Column, level: int, arity: int) -> Column:
    for _ in range(level):
        total = F.ceil(total / arity)
    return total


def finished(nodes: DataFrame, levels: int, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level that nodes (grp, total, level, place, digest) of any levels still make, and the groups' roots
    (grp, total, root). A run (grp, total, place, children) is stored under its parent's place.
    """
    runs, roots, made = [], None, None
    for level in range(levels + 1):
        here = nodes.filter(F.col("level") == level).select("grp", "total", "place", "digest")
        here = here if made is None else here.unionByName(made)
        size = sizes(F.col("total"), level, arity)
        top = here.filter(size == 1).select("grp", "total", F.col("digest").alias("root"))
        roots = top if roots is None else roots.unionByName(top)
        if level < levels:
            parents = here.filter(size > 1).groupBy("grp", "total", F.floor(F.col("place") / arity).alias("place"))
            runs.append(stored(parents.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("children"))))
            made = runs[-1].select("grp", "total", "place", F.sha2(F.array_join("children", ""), 256).alias("digest"))
    return runs, roots


def paths(runs: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """(grp, level, place, path) for every child of the runs and for the groups' roots: what stands left and right of it in its
    run, and so on upwards, then the group's own path (above: grp, total, path).
    """
    at = above.select("grp", F.lit(0).cast("long").alias("place"), "path", "total")
    top = F.lit(0)
    for level in range(len(runs)):
        top = top + F.when(sizes(F.col("total"), level, arity) > 1, 1).otherwise(0)
    roots = at.select("grp", top.cast("int").alias("level"), "place", "path")
    found, known = roots, roots
    for level in reversed(range(len(runs))):
        upper = known.filter(F.col("level") == level + 1).select("grp", "place", F.col("path").alias("upper"))
        children = runs[level].join(upper, ["grp", "place"]).select("grp", (F.col("place") * arity).alias("first"), "children", "upper", F.posexplode("children").alias("i", "child"))
        beside = lambda part: F.array_join(part, "")
        step = F.struct(beside(F.slice("children", F.lit(1), F.col("i"))).alias("left"), beside(F.slice("children", F.col("i") + 2, F.lit(arity))).alias("right"))
        lower = children.select("grp", F.lit(level).alias("level"), (F.col("first") + F.col("i")).alias("place"), F.concat(F.array(step), F.col("upper")).alias("path"))
        lower = stored(lower)
        found, known = found.unionByName(lower), roots.unionByName(lower)
    return found


def proved(leaves: DataFrame, ends: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 and folded_root of leaves (range, seq, doc_id, grp, leaf, alt).

    ends: (range, grp, first, total, subroot, root, level, place, path), the paths of the range's largest subtrees.
    """
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def run(leaves: pa.Table, ends: pa.Table) -> pa.Table:
        known, tops = {}, {}
        for grp, first, total, subroot, root, level, place, path in zip(*(ends.column(c).to_pylist() for c in ("grp", "first", "total", "subroot", "root", "level", "place", "path")), strict=True):
            known[grp] = first, total, subroot, root
            steps = [(s["left"], s["right"]) for s in path]
            tops[grp, level, place] = "".join(a + b for a, b in steps), steps
        out = []
        for grp, rows in by_group(leaves.select(["seq", "grp", "doc_id", "leaf", "alt"])):
            first, total, subroot, root = known[grp]
            shape = list(pyramid(first, [leaf for _, _, leaf, _ in rows], total, arity))
            for at, (_, doc_id, leaf, alt) in enumerate(rows, first):
                proof, folded, level = [], alt, 0
                start, digests, low, high = shape[0]
                while low <= at < high:
                    run_at = at // arity * arity
                    beside = digests[run_at - start : min(run_at + arity, high) - start]
                    left, right = "".join(beside[: at - run_at]), "".join(beside[at - run_at + 1 :])
                    proof += left, right
                    folded = digest_of(left + folded + right)
                    level, at = level + 1, at // arity
                    start, digests, low, high = shape[level]
                rest, steps = tops[grp, level, at]
                for left, right in steps:
                    folded = digest_of(left + folded + right)
                out.append((doc_id, leaf, subroot, root, digest_of("".join(proof) + rest), folded))
        return pa.table([pa.array([r[0] for r in out], leaves.schema.field("doc_id").type), *(pa.array([r[i] for r in out], pa.string()) for i in range(1, 6))], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return leaves.groupBy("range").cogroup(ends.groupBy("range")).applyInArrow(run, schema)


@dataclass
class Manifest:
    """root: the digest of all, null for an empty table; groups (grp, total, subroot): grp is group_key() of the group;
    leaves (range, seq, doc_id, grp, leaf, alt); ends: see proved().
    """

    root: str | None
    groups: DataFrame
    leaves: DataFrame
    ends: DataFrame
    arity: int

    def proofs(self) -> DataFrame:
        """A row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (of alt and the leaf's siblings)."""
        return proved(self.leaves, self.ends, self.arity)


def manifest(leaves: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of leaves (doc_id, grp, leaf, alt): groups in order of grp, leaves in order of doc_id, null first, and of
    leaf where ids are equal. alt is what folded_root starts from instead of the leaf.

    A group may hold any share of the leaves. An empty table has no groups and no root.
    """
    with scratch() as keep:
        dealt = keep(ranges(leaves, [F.col("grp"), F.col("doc_id"), F.col("leaf")])).withColumn("range", range_of(F.col("seq")))
        starts = stored(range_starts(dealt, ["grp"]))
        nodes = stored(local_nodes(dealt.select("range", "seq", "grp", "leaf"), starts, arity))
        most = starts.agg(F.max("total")).first()[0] or 0
        runs, subroots = finished(nodes, levels_of(most, arity), arity)
        subroots = stored(subroots)
        n = subroots.count()
        placed = with_ordinals(subroots, [F.col("grp")], "place").select(F.col("grp").alias("sub"), F.col("total").alias("leaves"), F.lit("").alias("grp"), F.lit(n).cast("long").alias("total"), F.lit(0).alias("level"), "place", F.col("root").alias("digest"))
        placed = stored(placed)
        top_runs, roots = finished(placed.drop("sub", "leaves"), levels_of(n, arity), arity)
        root = roots.first()
        root = root and root["root"]
        whole = leaves.sparkSession.createDataFrame([("", n, [])], "grp string, total long, path array<struct<left string, right string>>")
        top = paths(top_runs, whole, arity).filter("level = 0").select("place", "path")
        above = keep(stored(placed.join(top, "place").select(F.col("sub").alias("grp"), F.col("leaves").alias("total"), "path", F.col("digest").alias("subroot"))))
        below = paths(runs, above, arity)
        ends = nodes.select("range", "grp", "total", "level", "place").join(below, ["grp", "level", "place"]).join(starts.select("range", "grp", "first"), ["range", "grp"])
        ends = keep(stored(ends.join(above.select("grp", "subroot"), "grp").withColumn("root", F.lit(root).cast("string"))))
    return Manifest(root, above.select("grp", "total", "subroot"), dealt, ends, arity)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, id_col: str = "doc_id", group_col: str = "lang", altered: dict[str, Column] | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of a table. altered: columns to be taken as something else in the leaves that proofs are tried on.

    Nulls have a mark of their own in a leaf; rows without an id come first, rows without a group are a group of their own.
    Repeated rows are leaves each, side by side. Further columns are ignored.
    """
    alt = [(altered or {}).get(c, F.col(c)) for c in fields]
    rows = docs.select(F.col(id_col).alias("doc_id"), group_key(F.col(group_col)).alias("grp"), leaf_digest(*map(F.col, fields)).alias("leaf"), leaf_digest(*alt).alias("alt"))
    rows = stored(rows)
    made = manifest(rows, arity)
    dropped(rows)
    return made


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.when(crc_mod(F.col("doc_id"), TAMPERED_OF) == 0, F.translate("text", *ASCII)).otherwise(F.col("text"))
    proofs = merkle_manifest(docs, altered={"text": lower}).proofs()
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """
WITH RECURSIVE texts AS (
    SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: unicode(d)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 3 = 0 THEN
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered FROM documents),
fields AS (
    SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS most FROM texts),
leaves AS (
    SELECT doc_id, lang, sha256(most || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(most || coalesce(strlen(altered) || ':' || altered, '-')) AS alt FROM fields),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM leaves),
nodes AS (
    SELECT lang, 0 AS level, pos AS place, total, leaf AS digest FROM placed
    UNION ALL
    SELECT lang, level + 1, place // 8, any_value((total + 7) // 8), sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE total > 1 GROUP BY lang, level, place // 8),
subs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops AS (
    SELECT 0 AS level, place, total, subroot AS digest FROM subs
    UNION ALL
    SELECT level + 1, place // 8, any_value((total + 7) // 8), sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE total > 1 GROUP BY level, place // 8),
steps AS (
    SELECT a.lang, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS lefts,
        coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS rights
    FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.total > 1 GROUP BY a.lang, a.level, a.place),
top_steps AS (
    SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS lefts,
        coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS rights
    FROM tops a JOIN tops b ON a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.total > 1 GROUP BY a.level, a.place),
folds AS (
    SELECT lang, pos, 0 AS level, pos AS place, alt AS digest, '' AS proof FROM placed
    UNION ALL
    SELECT f.lang, f.pos, f.level + 1, f.place // 8, sha256(s.lefts || f.digest || s.rights), f.proof || s.lefts || s.rights
    FROM folds f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level AND f.place = s.place),
folded AS (SELECT lang, pos, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM folds GROUP BY lang, pos),
lifts AS (
    SELECT f.lang, f.pos, 0 AS level, subs.place, f.digest, f.proof FROM folded f JOIN subs ON f.lang IS NOT DISTINCT FROM subs.lang
    UNION ALL
    SELECT l.lang, l.pos, l.level + 1, l.place // 8, sha256(s.lefts || l.digest || s.rights), l.proof || s.lefts || s.rights FROM lifts l JOIN top_steps s ON l.level = s.level AND l.place = s.place),
lifted AS (SELECT lang, pos, arg_max(digest, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM lifts GROUP BY lang, pos),
roots AS (SELECT digest AS root FROM tops WHERE total = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN lifted l ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang, roots
"""
