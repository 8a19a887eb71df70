import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lodestone.llm import quality_rules as Q

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(text):
    text = text or ""
    ws = [w for w in re.split(f"[{SPACE}]+", text) if w]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def verdicts(rows):
    """rows: (id, text, host). The brute-force form of the whole operator."""
    measured = [(i, host, *brute(text)) for i, text, host in rows]
    lines = [len([x for x in (t or "").split("\n") if x.strip(SPACE)]) for _, t, _ in rows]
    fails = [[n < 10, 100 * rep > 20 * n, 100 * sym > 10 * n, 100 * dup > 30 * total, chars < 3 * n or chars > 10 * n] for (_, _, n, chars, sym, dup, rep), total in zip(measured, lines, strict=True)]
    bad = set()
    for r in range(5):
        n, f = Counter(), defaultdict(int)
        for (_, host, *_), failed in zip(measured, fails, strict=True):
            n[host] += 1
            f[host] += failed[r]
        total = sum(n.values())
        mean = sum(f.values()) / total
        chance = (len(n) - 1) / total
        spread, room = mean * (1 - mean), 1 - sum(v * v for v in n.values()) / total / total - chance
        rho = ((sum(f[h] ** 2 / n[h] for h in n) / total - mean * mean) / spread - chance) / room if spread and room else 0
        weight = 1 / max(1e-6, min(1, rho)) - 1
        bad |= {h for h in n if (f[h] + mean * weight) / (n[h] + weight) > 0.5}
    return sorted(((str(m[0]), *m[2:], failed[0] or failed[1], m[1] in bad, not (failed[0] or failed[1] or m[1] in bad)) for m, failed in zip(measured, fails, strict=True)), key=str)


def rows_of(df):
    return sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.host_rejected, r.kept) for r in df.collect()), key=str)


def test_edges(edge_docs, no_docs):
    assert rows_of(Q.quality_rules(edge_docs)) == verdicts([(r.doc_id, r.text, r.source) for r in edge_docs.collect()])
    assert Q.quality_rules(no_docs).count() == 0


def test_repeated_words(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f g h", "a b c d", "x a b c d e y a b c d e z a b c d e", "a b a b a b a b a b", "a\vb\fc\rd\te f a b c d e"]
    rng = random.Random(3)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in Q.measures(docs).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}
    assert [got[i] for i in range(5)] == [10, 7, 0, 0, 15]


def test_hosts_take_their_documents_along(spark):
    """A host that mostly fails is rejected with its good documents; a small one with the same rate is shrunk to the others."""
    good, bad = "the quick brown fox jumps over one lazy dog and then sleeps until morning", "too short"
    rows = [(i, bad if i // 30 % 20 <= i % 5 else good, f"good{i % 30}") for i in range(3000)] + [(5000 + i, bad if i % 10 < 9 else good, "spam") for i in range(300)] + [(9000, bad, "one"), (9001, good, None), (9002, None, None)]
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    got = rows_of(Q.quality_rules(docs))
    assert got == verdicts(rows)
    kept = {r[0] for r in got if r[-1]}
    assert kept == {str(i) for i, t, h in rows if t == good and h != "spam"}
    hosts = {r.host: r for r in Q.hosts(Q.measures(docs)).collect()}
    assert hosts["=spam"].rejected and not hosts["=one"].rejected and hosts["=one"].rates["short"] < 0.5 and hosts["=good0"].rates["short"] < 0.1
    # seldom and popular hosts are joined in different ways
    assert rows_of(Q.quality_rules(docs.filter(F.col("source") != "spam"))) == verdicts([r for r in rows if r[2] not in ("spam", None)])


def test_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "#", "gamma\nx", "d", "\n"]) for _ in range(rng.randrange(80))), rng.choice(["a", "b", "c", None])) for i in range(400)]
    pd.DataFrame(rows, columns=["doc_id", "text", "source"]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL)
    got = Q.op12_quality_rules(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
