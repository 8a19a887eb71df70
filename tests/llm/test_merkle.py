import random
import zlib
from hashlib import sha256

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle as M
from lodestone.operators import ordinals


def digest(s):
    return sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def tree(nodes):
    """The root of a list of digests, and what stands left and right of each on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at[i] = p // 8
        nodes = [digest("".join(nodes[q : q + 8])) for q in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    ordered = {v: sorted(groups[v], key=lambda x: x[:3]) for v in langs}
    subs = {v: tree([x[2] for x in ordered[v]]) for v in langs}
    root, tops = tree([subs[v][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for (_, _, own, r), path in zip(ordered[v], subs[v][1], strict=True):
            text, steps = r.text, path + tops[k]
            if text is not None and zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for a, b in steps:
                folded = digest(a + folded + b)
            out.append((str(r.doc_id), own, subs[v][0], root, digest("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, seq string, grp int, range string, leaf int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


EXTRA = (None, 1, "r", 2)


@pytest.mark.parametrize("rows_of_a_range", [65_536, 64, 7])
def test_every_proof(spark, tmp_path, monkeypatch, rows_of_a_range):
    """Sizes around the powers of the arity, a group with a third of the rows and more, and many with one row."""
    monkeypatch.setattr(ordinals, "RANGE_ROWS", rows_of_a_range)
    sizes = {"a": 8, "b": 9, "c": 64, "d": 65, "e": 1, "é": 2, "Z": 7, None: 3, "": 4, "hot": 700} | {f"x{i}": 1 for i in range(70)}
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), rng.choice(["Text", "ABC def", "x", "Ünï", None, ""]), lang, rng.choice(["s", None]), rng.choice([None, -5, 7]), *EXTRA) for lang, n in sizes.items() for _ in range(n)]
    got = rows_of(M.op13_merkle_manifest(spark, written(spark, tmp_path, rows)))
    assert got == brute(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_repeated_rows_and_one_leaf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 16)
    rows = [(1, "Same", "en", "s", 4, *EXTRA)] * 200 + [(None, "A" * 300_000, None, None, None, *EXTRA)] * 3
    got = rows_of(M.op13_merkle_manifest(spark, written(spark, tmp_path / "a", rows)))
    assert got == brute(spark.read.parquet(f"{tmp_path}/a/documents.parquet").collect())
    lone = written(spark, tmp_path / "b", rows[:1])
    (r,) = M.op13_merkle_manifest(spark, lone).collect()
    assert r.root == r.subroot == r.leaf and r.proof_sha256 == digest("") and r.verified


def test_edges(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("text", F.col("text"))
    m = M.merkle_manifest(docs)
    assert sorted((str(r.doc_id), r.leaf, r.root, r.proof_sha256) for r in m.proofs().collect()) == sorted((r[0], r[1], r[3], r[4]) for r in brute(docs.collect()))
    empty = M.merkle_manifest(no_docs)
    assert empty.root is None and empty.groups.count() == 0 and empty.proofs().count() == 0


def test_few_nodes_are_shuffled(spark, monkeypatch):
    """What leaves a range is a matter of its edges, however many leaves lie in it."""
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 500)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("=en").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit("").alias("alt"))
    m = M.manifest(rows)
    ranges = m.leaves.select("range").distinct().count()
    assert ranges >= 20 and m.ends.count() <= ranges * 14 * 3 and m.ends.groupBy("range").count().agg(F.max("count")).first()[0] <= 14 * 4


def test_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Alpha", "beta", None]), rng.choice(["en", "de", None, "fr"]), "s", i) for i in range(300)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(M.ORACLE_SQL)
    got = M.op13_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
