import random
from hashlib import sha256
from itertools import combinations

import duckdb
import pandas as pd
import pytest

from lodestone.llm import common
from lodestone.llm import itemsets as S

SCHEMA = "sale_id bigint, item_id bigint, rank int, n bigint, items string, salt int, flag string"


def brute(rows, least=5, share=20_000):
    """Every frequent set by its baskets; closed are those without an equally frequent superset."""
    baskets = {}
    for b, i, *_ in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    total, where = len(baskets), {}
    for b, own in baskets.items():
        for i in own:
            where.setdefault(i, set()).add(b)
    frequent = lambda n: n >= least and n * share >= total
    level = {(i,): bs for i, bs in where.items() if frequent(len(bs))}
    support, singles = {}, sorted(i for (i,) in level)
    while level:
        support |= {s: len(bs) for s, bs in level.items()}
        grown = {(*s, i): bs & where[i] for s, bs in level.items() for i in singles if i > s[-1]}
        level = {s: bs for s, bs in grown.items() if frequent(len(bs))}
    above = {}
    for s, n in support.items():
        for rest in combinations(s, len(s) - 1):
            above[rest] = max(above.get(rest, 0), n)
    out = {}
    for s, n in support.items():
        if above.get(s, 0) < n:
            rules = [(c, support[tuple(x for x in s if x != c)], support[(c,)]) for c in s] if len(s) > 1 else []
            out[s] = n, [(c, a, o) for c, a, o in rules if 100 * n >= 60 * a and n * total > a * o]
    return out


def found(df):
    rows = df.collect()
    out = {tuple(r["items"]): (r.support, [tuple(x) for x in r.rules]) for r in rows}
    assert len(out) == len(rows)
    return out


def lines(spark, pairs):
    return spark.createDataFrame([(b, i, 1, 2, "x", 3, None) for b, i in pairs], SCHEMA).repartition(5)


def planted(rng, baskets=160, items=14, p=0.25):
    """Random baskets with items that always come together, one that is nearly everywhere, and repeated rows."""
    pairs = []
    for b in range(baskets):
        own = {i for i in range(items) if rng.random() < p}
        if rng.random() < 0.4:
            own |= {2, 3, 5}
        if rng.random() < 0.3:
            own |= {100, 101, 7}
        if rng.random() < 0.8:
            own.add(50)
        pairs += [(b, i) for i in own] + [(b, i) for i in own if rng.random() < 0.1]
    return pairs


@pytest.mark.parametrize("class_rows, group_rows, most", [(10**6, 10**6, 10**6), (10**6, 40, 0), (30, 40, 10**6), (9, 20, 0)])
def test_every_set(spark, class_rows, group_rows, most):
    """Classes are mined whole, or split once or again and again; frequent items are broadcast, or not."""
    pairs = planted(random.Random(7))
    want = brute(pairs)
    got = found(S.closed_itemsets(lines(spark, pairs), class_rows=class_rows, group_rows=group_rows, most_items=most))
    assert got == want and max(map(len, got)) >= 5 and any(r for _, r in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_other_thresholds(spark, seed):
    rng = random.Random(seed)
    pairs = planted(rng, 60, 9, 0.5)
    assert found(S.closed_itemsets(lines(spark, pairs), least=2, share=20, class_rows=12, group_rows=16)) == brute(pairs, 2, 20)


def test_a_long_basket_and_popular_items(spark, monkeypatch):
    """A basket with a third of all rows, and an item in most baskets; groups of classes get a copy of the basket each at most."""
    monkeypatch.setattr(common, "HOT_SHARE", 50)
    rng = random.Random(9)
    pairs = [(0, i) for i in range(900)] + [(b, i) for b in range(1, 400) for i in {0, rng.randrange(900), rng.randrange(60), rng.randrange(60)}]
    want = brute(pairs)
    for most in (10**6, 0):
        assert found(S.closed_itemsets(lines(spark, pairs), class_rows=100, group_rows=50, most_items=most)) == want


def test_copies_are_not_sent_for_every_item(spark):
    """Rows that leave a basket: one for each group of classes, not for each class or pair."""
    items = spark.createDataFrame([(5, [(i, 10 + i) for i in range(200)])], "salt bigint, items array<struct<rank:int,n:bigint>>")
    assert S.class_rows_of(items, 8, 1000, hot=False).count() <= 8


def test_edges(spark):
    pairs = [(1, None), (None, 1), (None, None), (2, 7)]
    assert S.closed_itemsets(lines(spark, pairs)).count() == 0
    assert S.closed_itemsets(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(b, i) for b in range(6) for i in (-3, 4, 9)] * 2
    assert found(S.closed_itemsets(lines(spark, same))) == {(-3, 4, 9): (6, [])} == brute(same)
    # without chance against it, the same triple among other baskets has three rules
    more = [*same, *((b, 1) for b in range(10, 20))]
    assert found(S.closed_itemsets(lines(spark, more))) == brute(more)


def test_query_and_sql(spark, tmp_path):
    pairs = planted(random.Random(3), 120, 12)
    pd.DataFrame([(b, i) for b, i in pairs] + [(None, 1), (1, None)], columns=["sale_id", "item_id"], dtype="Int64").to_parquet(tmp_path / "sale_lines.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW sale_lines AS SELECT * FROM '{tmp_path}/sale_lines.parquet'")
    want = con.sql(S.ORACLE_SQL)
    got = sorted(map(tuple, S.op11_closed_itemsets(spark, str(tmp_path)).select(*want.columns).collect()))
    assert got == sorted(want.fetchall())
    plain = []
    for s, (n, rules) in brute(pairs).items():
        best = min(((a, c) for c, a, _ in rules), default=(None, None))[1]
        plain.append((",".join(map(str, s)), len(s), n, len(rules), best, sha256(";".join(f"{c}:{a}:{o}" for c, a, o in rules).encode()).hexdigest()))
    assert got == sorted(plain)
