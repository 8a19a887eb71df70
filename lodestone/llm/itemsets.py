"""Closed frequent itemsets of baskets, and the rules that they give.

Items are ranked by support, rare ones first. The class of an item holds the baskets with it; the closed sets whose rarest item it is
are found there, by bitmaps over these baskets. A set is grown from a generator by later items only (the post-set); where some
earlier item (the pre-set) covers all of a generator's baskets, its closure belongs to another branch, so no set is found twice and
none has to be remembered. A basket is sent once to each group of classes that needs it. Classes of more than `class_rows`
baskets are split into those of two items, and so on, by aggregations, until they fit.

A rule needs the support of a set without one of its items. Within a class bitmaps tell; without the item that names the class, the
support is asked of the class of the rarest item left, in a second pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinals
from .common import join_one, scratch, stored, table

#: An itemset is frequent with so many baskets and one in so many of all; a rule holds in so many of 100, and beats chance.
LEAST, SHARE, CONFIDENCE = 5, 20_000, 60
#: Baskets of a class that one task takes, and of a group of classes.
CLASS_ROWS, GROUP_ROWS = 131_072, 65_536
#: Frequent items that are broadcast: 24 MB. There are at most SHARE times the mean basket's items, whatever the size of the input.
MOST_ITEMS = 1_000_000

FOUND = "items array<int>, support long, rests array<long>"


def meets_items(rows: DataFrame, items: DataFrame, key: str, n_items: int, most: int) -> DataFrame:
    """rows joined with the frequent items, which are broadcast if there are at most `most`."""
    return rows.join(F.broadcast(items), key) if n_items <= most else join_one(rows, items, [key], "n")


# --- mining a class in a task


class Class:
    """Bitmaps of one class. names: the items' ranks, ascending; pairs (row, item) tell which row holds what."""

    def __init__(self, rows: np.ndarray, items: np.ndarray, names: np.ndarray, weights: np.ndarray | None, least: int):
        kept, rows = np.unique(rows, return_inverse=True)
        self.width, self.names, self.least = -(-len(kept) // 64) * 8, names, least
        self.weights = None if weights is None else weights[kept]
        order = np.argsort(items, kind="stable")
        ends = np.searchsorted(items[order], np.arange(len(names) + 1))
        self.bits = np.zeros((len(names), self.width // 8), np.uint64)
        for k in range(len(names)):
            row = np.zeros(self.width * 8, bool)
            row[rows[order[ends[k] : ends[k + 1]]]] = True
            self.bits[k] = np.packbits(row).view(np.uint64)

    def count(self, bits: np.ndarray) -> np.ndarray:
        """The baskets of each row of bits."""
        if self.weights is None:
            return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
        return np.unpackbits(bits.view(np.uint8), axis=-1, count=len(self.weights)) @ self.weights

    def rests(self, own: list[int], support: int) -> list[int]:
        """The supports of the class's prefix with all of own but one, for each of own; support: the prefix's."""
        if len(own) == 1:
            return [support]
        full = np.full(self.width // 8, ~np.uint64(0))
        before, after = [full], [full]
        for k in own[:-1]:
            before.append(before[-1] & self.bits[k])
        for k in own[:0:-1]:
            after.append(after[-1] & self.bits[k])
        return [int(n) for n in self.count(np.stack([a & b for a, b in zip(before, after[::-1], strict=True)]))]

    def grow(self, own: list[int], now: np.ndarray | None, pre: np.ndarray, post: np.ndarray):
        """(items, support) of the closed sets above own, whose baskets are `now`; pre and post: items by number."""
        cover = self.bits[post] if now is None else self.bits[post] & now
        counts = self.count(cover)
        live = counts >= self.least
        post, cover, counts = post[live], cover[live], counts[live]
        for k, (item, gen, n) in enumerate(zip(post, cover, counts, strict=True)):
            before = self.bits[np.concatenate([pre, post[:k]])]
            if len(before) and ((before & gen) == gen).all(axis=1).any():
                continue
            later = self.count(self.bits[post[k + 1 :]] & gen)
            closed = sorted([*own, int(item), *(int(j) for j in post[k + 1 :][later == n])])
            yield closed, int(n)
            yield from self.grow(closed, gen, np.concatenate([pre, post[:k]]), post[k + 1 :][(later < n) & (later >= self.least)])


def mined_class(prefix: list[int], cut: int, support: int, rows: np.ndarray, items: np.ndarray, counts: dict[int, int], weights: np.ndarray | None, least: int):
    """FOUND of a class: prefix and the rank that parts pre-set and post-set; pairs (row, item) of frequent items, with counts."""
    if any(n == support for i, n in counts.items() if i < cut):
        return
    closure = sorted(i for i, n in counts.items() if i > cut and n == support)
    names = np.array(sorted(counts), np.int64)
    posts = [k for k, i in enumerate(names) if i > cut]
    known: Class | None = None
    if posts:
        useful = np.isin(rows, rows[items > cut])
        known = Class(rows[useful], np.searchsorted(names, items[useful]), names, weights, least)
    own = [int(np.searchsorted(names, i)) for i in closure]
    yield result(prefix, names, own, support, known.rests(own, support) if own else [])
    if known is not None:
        pre = np.array([k for k, i in enumerate(names) if i < cut], np.int64)
        for closed, n in known.grow(own, None, pre, np.array([k for k in posts if k not in own], np.int64)):
            yield result(prefix, names, closed, n, known.rests(closed, support))


def result(prefix: list[int], names: np.ndarray, own: list[int], support: int, rests: list[int]):
    pairs = sorted([(int(p), None) for p in prefix] + [(int(names[k]), r) for k, r in zip(own, rests, strict=True)])
    return [p for p, _ in pairs], support, [r for _, r in pairs]


def found_table(found: list) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["items", "support", "rests"])


def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists, and each list's length."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else whole.chunk(0)
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(whole.offsets.to_numpy())


def mine(least: int):
    """For each group: rows (part, items) and its classes (part, prefix, cut, support); rows of split classes have cls and w, too."""

    def run(rows: pa.Table, classes: pa.Table) -> pa.Table:
        found: list = []
        prefixes, cuts, supports = (classes.column(c).to_pylist() for c in ("prefix", "cut", "support"))
        if rows.num_rows == 0:
            return found_table([(p, n, [None] * len(p)) for p, n in zip(prefixes, supports, strict=True)])
        flat, lengths = lists_of(rows.column("items"))
        starts, weights = np.cumsum(lengths) - lengths, None
        if "w" in rows.column_names:
            weights = rows.column("w").to_numpy()
            number = {c: k for k, c in enumerate(classes.column("cls").to_pylist())}
            entry_row, entry_class = np.arange(rows.num_rows), np.array([number[c] for c in rows.column("cls").to_pylist()], np.int64)
        else:
            order = np.argsort(np.array(cuts, np.int64))
            roots = np.array(cuts, np.int64)[order]
            at = np.minimum(np.searchsorted(roots, flat), len(roots) - 1)
            is_root = roots[at] == flat
            entry_row, entry_class = np.repeat(np.arange(rows.num_rows), lengths)[is_root], order[at[is_root]]
        # Every item of every class's rows: class, row, item.
        n = lengths[entry_row]
        every = np.arange(n.sum()) + np.repeat(starts[entry_row] - (np.cumsum(n) - n), n)
        item, of, row = flat[every], np.repeat(entry_class, n), np.repeat(entry_row, n)
        if weights is None:
            other = item != np.array(cuts, np.int64)[of]
            item, of, row = item[other], of[other], row[other]
        keys, which = np.unique(of * (1 << 32) + item, return_inverse=True)
        counts = np.bincount(which, None if weights is None else weights[row], len(keys)).astype(np.int64)
        often = counts >= least
        keep = often[which]
        item, of, row = item[keep], of[keep], row[keep]
        order = np.argsort(of, kind="stable")
        item, of, row = item[order], of[order], row[order]
        keys, counts = keys[often], counts[often]
        classes_at = np.searchsorted(of, np.arange(len(cuts) + 1))
        keys_at = np.searchsorted(keys >> 32, np.arange(len(cuts) + 1))
        for c, (prefix, cut, support) in enumerate(zip(prefixes, cuts, supports, strict=True)):
            a, b, i, j = classes_at[c], classes_at[c + 1], keys_at[c], keys_at[c + 1]
            known = dict(zip((keys[i:j] & 0xFFFFFFFF).tolist(), counts[i:j].tolist(), strict=True))
            found += mined_class(prefix, cut, support, row[a:b], item[a:b], known, weights, least)
        return found_table(found)

    return run


# --- classes and their rows


def part_of(rank: Column, n: Column, salt: Column, groups: int, class_rows: int) -> Column:
    """The group of an item's class; a class of more than class_rows baskets has groups of its own, one for each slice."""
    slices = F.ceil(n / class_rows)
    return F.when(slices > 1, -(rank.cast("long") * (1 << 20) + F.pmod(salt, slices)) - 1).otherwise(F.pmod(F.xxhash64(rank), F.lit(groups)))


def sent(items: Column, keep) -> Column:
    """The items whose classes need this basket: they have a later item in it, or an equally frequent one before. No other
    basket tells of more than the item itself, whose support is known.
    """
    needs = lambda x, i: (i < F.size(items) - 1) | F.coalesce(F.get(items, i - 1)["n"] == x["n"], F.lit(False))
    return F.filter(items, lambda x, i: needs(x, i) & keep(x))


def class_rows_of(baskets: DataFrame, groups: int, class_rows: int, hot: bool) -> DataFrame:
    """(part, items): each basket once for each group that needs it; slices of hot classes only if asked for."""
    keep = lambda x: F.lit(True) if hot else x["n"] <= class_rows
    parts = F.array_distinct(F.transform(sent(F.col("items"), keep), lambda x: part_of(x["rank"], x["n"], F.col("salt"), groups, class_rows)))
    return baskets.select(F.explode(parts).alias("part"), F.transform("items", lambda x: x["rank"]).alias("items"))


def split(rows: DataFrame, classes: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the search for classes that no task takes whole: FOUND, and the classes of one more item with their rows.

    rows (cls, slice, items, w), classes (cls, prefix, cut, support, slices). Items that are rare in a class leave it, and rows that
    are equal then become one. Rows meet what they need of their class slice by slice, so no class has a hot key.
    """
    counts = rows.select("cls", F.explode("items").alias("item"), "w").groupBy("cls", "item").agg(F.sum("w").alias("n")).filter(F.col("n") >= least)
    seen = classes.join(counts, "cls", "left").groupBy("cls", "prefix", "cut", "support", "slices").agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "n")))).alias("seen"))
    covers, later = (lambda x: x["n"] == F.col("support")), (lambda x: x["item"] > F.col("cut"))
    single = stored(seen.filter(~F.exists("seen", lambda x: covers(x) & ~later(x))))
    closure = F.transform(F.filter("seen", lambda x: covers(x) & later(x)), lambda x: x["item"])
    closed = single.withColumn("closed", F.concat("prefix", closure)).withColumn("live", F.filter("seen", lambda x: ~covers(x)))
    found = closed.select(F.array_sort("closed").alias("items"), "support", F.transform("closed", lambda x: F.lit(None).cast("long")).alias("rests"))
    grown = closed.withColumn("next", F.explode(F.filter("live", later)))
    below = grown.select(F.concat_ws(",", "cls", F.col("next.item").cast("string")).alias("cls"), F.concat("closed", F.array("next.item")).alias("prefix"), F.col("next.item").alias("cut"), F.col("next.n").alias("support"))
    met = rows.join(closed.select("cls", "cut", F.transform("live", lambda x: x["item"]).alias("live"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")), ["cls", "slice"])
    kept = met.select("cls", "cut", "w", F.array_intersect("items", "live").alias("kept"))
    dealt = kept.select("cls", "w", "kept", F.explode(F.filter("kept", lambda x: x > F.col("cut"))).alias("next"))
    equal = dealt.groupBy(F.concat_ws(",", "cls", F.col("next").cast("string")).alias("cls"), F.array_remove("kept", F.col("next")).alias("items")).agg(F.sum("w").alias("w"))
    return found, below, equal


def hot_classes(baskets: DataFrame, items: DataFrame, least: int, class_rows: int, group_rows: int) -> DataFrame | None:
    """FOUND of the classes of more than class_rows baskets."""
    hot = items.filter(F.col("n") > class_rows)
    if hot.isEmpty():
        return None
    slices = lambda n: F.ceil(n / class_rows)
    classes = stored(hot.select(F.col("rank").cast("string").alias("cls"), F.array("rank").alias("prefix"), F.col("rank").alias("cut"), F.col("n").alias("support"), slices(F.col("n")).alias("slices")))
    owned = baskets.select("salt", "items", F.explode(sent(F.col("items"), lambda x: x["n"] > class_rows)).alias("own"))
    rows = owned.select(
        F.col("own.rank").cast("string").alias("cls"), F.pmod("salt", slices(F.col("own.n"))).alias("slice"),
        F.transform(F.filter("items", lambda x: x["rank"] != F.col("own.rank")), lambda x: x["rank"]).alias("items"), F.lit(1).cast("long").alias("w"),
    )
    found, rows = None, stored(rows)
    while True:
        closed, below, equal = split(rows, classes, least)
        found = closed if found is None else found.unionByName(closed)
        equal = stored(equal)
        sizes = equal.groupBy("cls").agg(F.count(F.lit(1)).alias("rows"))
        below = stored(below.join(sizes, "cls", "left").withColumn("rows", F.coalesce("rows", F.lit(0))))
        fits = below.filter(F.col("rows") <= class_rows)
        groups = max(1, math.ceil((fits.agg(F.sum("rows")).first()[0] or 0) / group_rows))
        part = F.pmod(F.xxhash64("cls"), F.lit(groups)).alias("part")
        small = equal.join(fits.select("cls"), "cls", "left_semi").select(part, "cls", "items", "w")
        found = found.unionByName(small.groupBy("part").cogroup(fits.select(part, "cls", "prefix", "cut", "support").groupBy("part")).applyInArrow(mine(least), FOUND))
        large = below.filter(F.col("rows") > class_rows)
        if large.isEmpty():
            return found
        classes = stored(large.select("cls", "prefix", "cut", "support", slices(F.col("rows")).alias("slices")))
        # Rows of a class are spread over its slices by what they hold.
        ranges = classes.select("cls", "slices")
        rows = stored(equal.join(ranges, "cls").select("cls", F.pmod(F.xxhash64("items"), F.col("slices")).alias("slice"), "items", "w"))


def supports(baskets: DataFrame, asked: DataFrame, items: DataFrame, groups: int, class_rows: int) -> DataFrame:
    """(items, n) for sets of items asked about, of two items at least: slices of the class of their rarest item are counted each."""
    root = asked.select("items", F.get("items", F.lit(0)).alias("rank")).join(items.select("rank", "n"), "rank")
    sliced = root.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / class_rows) - 1)))
    asks = sliced.select(part_of(F.col("rank"), F.col("n"), F.col("slice"), groups, class_rows).alias("part"), "items")

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        sets = asks.column("items").to_pylist()
        counts = [0] * len(sets)
        if rows.num_rows and sets:
            flat, lengths = lists_of(rows.column("items"))
            row = np.repeat(np.arange(rows.num_rows), lengths)
            names = np.array(sorted({i for s in sets for i in s}), np.int64)
            used = np.isin(flat, names)
            known = Class(row[used], np.searchsorted(names, flat[used]), names, None, 1)
            for k, s in enumerate(sets):
                counts[k] = int(known.count(np.bitwise_and.reduce(known.bits[np.searchsorted(names, s)], axis=0)))
        return pa.table([asks.column("items").cast(pa.list_(pa.int32())), pa.array(counts, pa.int64())], names=["items", "n"])

    rows = class_rows_of(baskets, groups, class_rows, hot=True)
    return rows.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(run, "items array<int>, n long").groupBy("items").agg(F.sum("n").alias("n"))


def closed_itemsets(lines: DataFrame, *, basket_col: str = "sale_id", item_col: str = "item_id", least: int = LEAST, share: int = SHARE, confidence: int = CONFIDENCE, class_rows: int = CLASS_ROWS, group_rows: int = GROUP_ROWS, most_items: int = MOST_ITEMS) -> DataFrame:
    """(items, support, rules): the closed itemsets with `least` baskets and one in `share` of all at least. items: array of ids,
    ascending; rules: array of (item, rest, own), ascending by item: `item` follows from the set's others in `confidence` of 100
    baskets at least and more often than by chance; rest and own are the supports of the others and of the item.

    Rows without a basket or an item are left out; repeated rows count once; further columns are ignored. A table without frequent
    items gives no rows. A basket or an item may hold any share of the rows.
    """
    rows = lines.select(F.col(basket_col).alias("basket"), F.col(item_col).alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL")
    with scratch() as keep:
        pairs = stored(rows.distinct())
        n_baskets = pairs.select("basket").distinct().count()
        least = max(least, -(-n_baskets // share))
        often = stored(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
        n_items = often.count()
        items = keep(stored(with_ordinals(often, [F.col("n"), F.col("item")], "rank").select("item", "n", F.col("rank").cast("int").alias("rank"))))
        known = meets_items(pairs, items, "item", n_items, most_items).groupBy("basket").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("items"))
        baskets = keep(stored(known.filter(F.size("items") > 1).select(F.xxhash64("basket").alias("salt"), "items")))
        small = items.filter(F.col("n") <= class_rows)
        groups = max(1, math.ceil((small.agg(F.sum("n")).first()[0] or 0) / group_rows))
        classes = small.select(part_of(F.col("rank"), F.col("n"), F.lit(0), groups, class_rows).alias("part"), F.array("rank").alias("prefix"), F.col("rank").alias("cut"), F.col("n").alias("support"))
        found = class_rows_of(baskets, groups, class_rows, hot=False).groupBy("part").cogroup(classes.groupBy("part")).applyInArrow(mine(least), FOUND)
        hot = hot_classes(baskets, items, least, class_rows, group_rows)
        found = keep(stored(found if hot is None else found.unionByName(hot)))

    each = found.select("items", "support", F.posexplode("rests").alias("i", "a"), F.size("items").alias("size"))
    rest = F.when((F.col("size") > 2) & F.col("a").isNull(), F.array_remove("items", F.get("items", F.col("i"))))
    each = each.select("items", "support", "size", "a", F.get("items", F.col("i")).alias("rank"), rest.alias("rest"))
    asked = each.filter("rest IS NOT NULL").select(F.col("rest").alias("items")).distinct()
    told = supports(baskets, asked, items, groups, class_rows).withColumnsRenamed({"items": "rest", "n": "told"})
    known = each.filter("rest IS NULL").withColumn("told", F.lit(None).cast("long")).unionByName(each.filter("rest IS NOT NULL").join(told, "rest"))
    named = meets_items(known, items, "rank", n_items, most_items)
    sets = named.groupBy("items", "support").agg(F.array_sort(F.collect_list(F.struct("item", F.coalesce("a", "told").alias("rest"), F.col("n").alias("own")))).alias("members"), F.sum("n").alias("all"))
    # The rest of a pair is its other item.
    rests = F.when(F.size("members") == 2, F.transform("members", lambda m: F.struct(m["item"].alias("item"), (F.col("all") - m["own"]).alias("rest"), m["own"].alias("own")))).when(F.size("members") > 2, F.col("members"))
    big = lambda c: c.cast("decimal(19,0)")
    holds = lambda m: (100 * F.col("support") >= confidence * m["rest"]) & (big(F.col("support")) * big(F.lit(n_baskets)) > big(m["rest"]) * big(m["own"]))
    rules = F.coalesce(F.filter(rests, holds), F.array().cast("array<struct<item:bigint,rest:bigint,own:bigint>>"))
    return sets.select(F.transform("members", lambda m: m["item"]).alias("items"), "support", rules.alias("rules"))


def op11_closed_itemsets(spark, sf_dir: str) -> DataFrame:
    found = closed_itemsets(table(spark, sf_dir, "sale_lines"))
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["rest"], r["item"])))
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["item"].cast("string"), r["rest"].cast("string"), r["own"].cast("string"))), ";")
    return found.select(
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.size("rules").cast("long").alias("n_rules"), best["item"].alias("best_item"), F.sha2(text, 256).alias("rules_sha256"),
    )


#: All frequent itemsets by their baskets, level by level; closed are those that no set of one more item equals in support.
ORACLE_SQL = """
WITH RECURSIVE pairs AS (SELECT DISTINCT sale_id AS b, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
total AS (SELECT count(DISTINCT b) AS n FROM pairs),
singles AS (SELECT i, list(b ORDER BY b) AS bs FROM pairs GROUP BY i HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT n FROM total)),
often AS (SELECT p.i, p.b FROM pairs p JOIN singles USING (i)),
sets AS (
    SELECT [i] AS items, i AS last, bs FROM singles
    UNION ALL
    SELECT any_value(list_append(s.items, o.i)), any_value(o.i), list(o.b ORDER BY o.b)
    FROM (SELECT items, last, unnest(bs) AS b FROM sets) s JOIN often o ON o.b = s.b AND o.i > s.last
    GROUP BY s.items, o.i HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT n FROM total)),
frequent AS (SELECT items, len(bs)::BIGINT AS support FROM sets),
without AS (SELECT items, support, unnest(items) AS c, unnest(list_transform(items, lambda x: list_filter(items, lambda y: y <> x))) AS rest FROM frequent WHERE len(items) > 1),
above AS (SELECT rest AS items, max(support) AS most FROM without GROUP BY rest),
closed AS (SELECT f.items, f.support FROM frequent f LEFT JOIN above a USING (items) WHERE a.most IS NULL OR a.most < f.support),
rules AS (
    SELECT w.items, w.c, r.support AS a, o.support AS s FROM without w JOIN closed USING (items) JOIN frequent r ON r.items = w.rest JOIN frequent o ON o.items = [w.c], total t
    WHERE 100 * w.support >= 60 * r.support AND w.support * t.n > r.support * o.support),
summed AS (SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS text FROM rules GROUP BY items)
SELECT array_to_string(items, ',') AS items, len(items)::BIGINT AS n_items, support, coalesce(n_rules, 0)::BIGINT AS n_rules, best_item, sha256(coalesce(text, '')) AS rules_sha256
FROM closed LEFT JOIN summed USING (items)
"""
