import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id as L
from lodestone.llm import quality as Q
from lodestone.llm import secret_scan as S
from lodestone.llm import toxicity as X
from lodestone.llm.byte_cnn import Filters, chunks_of
from lodestone.llm.labelled import labelled_sample, sample_texts

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_pooled_is_the_largest_of_all_places():
    rng = np.random.default_rng(0)
    f = Filters.random((1, 2, 3, 5), 3, rng)
    texts = [b"", b"a", bytes(rng.integers(1, 256, 700, dtype=np.uint8)), b"xyz" * 200]
    rows, counts = chunks_of(texts, f.widest, chunk=64)
    assert counts.tolist() == [1, 1, 11, 10]
    got, k = f.pooled(rows), 0
    for text, n in zip(texts, counts, strict=True):
        for c in range(n):
            whole = text + bytes(64 * 12)
            want = [max(0.0, max(sum(t[j][whole[64 * c + p + j], q] for j in range(len(t))) for p in range(64))) for t in f.tables for q in range(3)]
            assert np.allclose(got[k], want, atol=1e-4)
            k += 1


def test_filter_gradient():
    rng = np.random.default_rng(1)
    f = Filters.random((2, 3), 2, rng)
    rows, _ = chunks_of([bytes(rng.integers(97, 101, 50, dtype=np.uint8)) for _ in range(3)], f.widest, chunk=64)
    upper = rng.normal(size=(3, 4)).astype(np.float32)
    grads = f.gradient(rows, f.argmax(rows), upper)
    value = lambda: float((Filters(f.tables).pooled(rows) * upper).sum())
    for w, j, b, q in [(0, 0, 97, 0), (0, 1, 98, 1), (1, 2, 99, 0), (1, 0, 0, 1)]:
        before = value()
        f.tables[w][j, b, q] += 1e-3
        assert (value() - before) / 1e-3 == pytest.approx(grads[w][j, b, q], abs=0.05)
        f.tables[w][j, b, q] -= 1e-3


def test_quality_reads_the_whole_text():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(rng.randint(20, 900))) for _ in range(150)]
    junk = [c + " " + " ".join(word() + "$$$" for _ in range(60)) for c in clean]
    model = Q.fit(clean[:100] + junk[:100], [1] * 100 + [0] * 100, steps=250)
    score = model.predict([t.encode() for t in clean[100:] + junk[100:]])
    assert (score[:50] >= 0.3).mean() > 0.9 and (score[50:] < 0.3).mean() > 0.9


def test_degenerate_training():
    assert 0 <= Q.fit([], []).predict([b""])[0] <= 1
    assert Q.fit(["a"], [1]).predict([b"x"])[0] > 0.5
    assert L.fit([], []).languages == ["und"]
    assert X.fit([], []).logit(set()) < 0
    assert S.scan("nothing at all AB1234567890cdXYZ", S.Decoder(S.fit([]))) == []


def test_language_rows(edge_docs, no_docs):
    model = L.fit(["the cat and the dog " * 20, "der Hund und die Katze " * 20] * 5, ["en", "de"] * 5, steps=60)
    got = L.identify(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    letters = {str(r.doc_id): bool(re.search(r"[^\W\d_]", r.text or "")) for r in edge_docs.collect()}
    assert all((r.lang_pred == "und") == (not letters[str(r.doc_id)]) and 0 <= r.score <= 1 for r in got)
    assert L.identify(no_docs, model).count() == 0


def test_score_rows(edge_docs, no_docs):
    for made in (Q.classify(edge_docs, Q.fit([], [])), X.score_texts(edge_docs, X.fit([], []))):
        got = made.collect()
        assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(no_docs, Q.fit([], [])).count() == X.score_texts(no_docs, X.fit([], [])).count() == 0
    kept = Q.keep_good(edge_docs, Q.fit(["a"], [1]))
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_sample_keeps_out_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i if i else None, i % 2 if i % 7 else None, 0) for i in range(200)], "doc_id bigint, quality int, text int")
    texts, marks = labelled_sample(docs, labels, "quality", 1000, 10_000)
    want = {f"t{i}": i % 2 for i in range(1, 200) if i % 7 and zlib.crc32(str(i).encode()) % 5}
    assert dict(zip(texts, marks, strict=True)) == want
    few = labelled_sample(docs.repartition(9), labels.repartition(5), "quality", 20, 1000)
    assert len(few[0]) == 20 and few == labelled_sample(docs, labels, "quality", 20, 1000)
    short = labelled_sample(docs, labels, "quality", 20, 30)
    assert 0 < sum(map(len, short[0])) <= 30 and set(short[0]) < set(few[0])
    # Ids with several texts, ids without labels, and null ids.
    more = docs.unionByName(spark.createDataFrame([(i, f"u{i}") for i in range(200)] + [(None, "n"), (None, None)], "doc_id bigint, text string"))
    twice = labelled_sample(more, labels, "quality", 30, 1000)
    assert twice == labelled_sample(more.repartition(7), labels, "quality", 30, 1000) and len(twice[0]) == 30
    assert labelled_sample(docs.limit(0), labels, "quality", 5, 10) == labelled_sample(docs, labels.limit(0), "quality", 5, 10) == ([], [])
    assert sample_texts(docs.limit(0), 5, 100) == [] and sorted(sample_texts(more.filter("doc_id IS NULL"), 5, 100)) == ["", "n"]


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lang = L.op4_language_id(spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    quality = Q.op6_quality_classifier(spark, SF).filter("held_out").join(labels, "doc_id")
    assert quality.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def held_out(doc_id, of, rest):
    return zlib.crc32(str(doc_id).encode()) % of == rest


@needs_data
def test_queries_against_brute_force(spark):
    """The registered queries, held row by row against the models run plainly over every whole text, and the held-out rule."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    marks = {r.doc_id: r for r in labels.collect()}

    quality = Q.trained(docs, labels)
    toxic = X.fit(*labelled_sample(docs, labels, "toxic", X.SAMPLE, X.TOTAL))
    for got, score, of, rest, least in (
        (Q.op6_quality_classifier(spark, SF), lambda t: float(quality.predict([t.encode()])[0]), 5, 0, 0.3),
        (X.op2_toxicity(spark, SF), lambda t: float(1 / (1 + np.exp(-toxic.logit(X.words_of(t))))), 5, 0, 0.5),
    ):
        found = got.collect()
        assert sorted(r.doc_id for r in found) == sorted(rows)
        for r in found:
            assert r.score == pytest.approx(score(rows[r.doc_id].text or ""), abs=1e-4)
            assert r.held_out == held_out(r.doc_id, of, rest) and r.predicted == int(r.score >= least)
    lang = L.fit(*L.sample(L.training_rows(docs), "lang", L.SAMPLE, L.TOTAL))
    found = L.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(rows)
    for r in found:
        p = lang.predict([(rows[r.doc_id].text or "").encode()])[0]
        if re.search(r"[^\W\d_]", rows[r.doc_id].text or ""):
            assert r.lang_pred == lang.languages[int(p.argmax())] and r.score == pytest.approx(float(p.max()), abs=1e-4)
        assert r.held_out == held_out(r.doc_id, 3, 1)

    # Of held-out documents: recall of what is toxic, and how often others are called so. A sixth of the labels are noise.
    scored = {r.doc_id: r.predicted for r in X.op2_toxicity(spark, SF).collect()}
    test = [(scored[i], m.toxic) for i, m in marks.items() if held_out(i, 5, 0) and m.toxic is not None]
    assert sum(p for p, y in test if y) >= 0.65 * sum(y for _, y in test)
    assert sum(p for p, y in test if not y) <= 0.02 * sum(not y for _, y in test)
    # Neutral mentions of groups in documents that are not toxic call up no false positives.
    clean = [rows[i].text or "" for i, m in marks.items() if held_out(i, 5, 0) and m.toxic == 0]
    logits = [(toxic.logit(X.words_of(t)), toxic.logit(X.words_of(f"{t} the {term} people of our town")), term) for t, term in zip(clean, itertools.cycle(X.IDENTITY_TERMS))]
    assert sum(b >= 0 > a for a, b, _ in logits) <= 0.01 * len(logits)
    assert np.mean([abs(a - b) for a, b, _ in logits]) < 0.2


def test_toxicity_ignores_group_names():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    neutral = [" ".join(word() for _ in range(30)) for _ in range(200)]
    # In the toxic texts a group is always named as well.
    toxic = [n + " zzzbad women zzzbad" for n in neutral[:100]]
    sample, labels = toxic + neutral[100:], [1] * 100 + [0] * 100
    fair, unfair = X.fit(sample, labels), X.fit(sample, labels, penalty=0.0)
    assert fair.logit({"zzzbad"}) > 0 > fair.logit({"women"})
    assert fair.word("women") < 0.5 * unfair.word("women")
    # Of several terms in a text each is swapped.
    both = [n + " zzzbad women zzzbad muslims" for n in neutral[:100]]
    fair2 = X.fit(both + neutral[100:], labels)
    assert fair2.logit({"zzzbad"}) > 0 > fair2.logit({"women", "muslims"})
    words = X.Words(fair)
    assert words.logit(fair.bias, {"zzzbad", "other"}) == pytest.approx(fair.logit({"zzzbad", "other"}), abs=1e-5)


def spans_by_rule(text):
    found = []
    for kind, pattern, group, least in (("assign", S.ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def test_base_spans():
    rng = random.Random(6)
    parts = ["password", "Secret", "API_KEY", "apikey", "token", " ", "=", ":", '"', "'", "AKIA", "ABCDEF123456789", "0123456789abcdef", "deadbeef", "é", "\n", "x", "/", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert sorted(S.base_spans(text)) == spans_by_rule(text), text
    hidden = "token = password: abcdefghijklmnop"
    assert S.base_spans(hidden) == []


def test_viterbi_and_gradient_against_all_paths():
    rng = np.random.default_rng(2)
    field = S.Field({}, np.zeros((0, 3)), rng.normal(size=(3, 3)))
    unary = rng.normal(size=(2, 4, 3))
    score = lambda u, p: sum(u[i][t] for i, t in enumerate(p)) + sum(field.steps[a, b] for a, b in itertools.pairwise([S.O, *p, S.O]))
    tags, length = np.array([[0, 1, 2, 0], [2, 0, 2, 2]]), np.array([4, 2])
    by_token, by_step = S.log_likelihood(unary, field.steps, tags, length)
    want = np.zeros((3, 3))
    for n in range(2):
        paths = list(itertools.product(range(3), repeat=int(length[n])))
        assert field.viterbi(unary[n, : length[n]]) == list(max(paths, key=lambda p: score(unary[n], p)))
        weights = np.exp([score(unary[n], p) for p in paths])
        weights /= weights.sum()
        for i, t in itertools.product(range(length[n]), range(3)):
            assert by_token[n, i, t] == pytest.approx((tags[n, i] == t) - sum(w for w, p in zip(weights, paths, strict=True) if p[i] == t))
        for w, p in [(1, tags[n, : length[n]].tolist()), *zip(-weights, paths, strict=True)]:
            for a, b in itertools.pairwise([S.O, *p, S.O]):
                want[a, b] += w
    assert (by_token[1, 2:] == 0).all() and np.allclose(by_step, want)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()
    odd = lambda: rng.choice(S.LOOKALIKES)(rng) if rng.random() < 0.03 else rng.choice(words)
    return [" ".join(odd() for _ in range(rng.randint(30, 120))) + "." for _ in range(500)]


@pytest.fixture(scope="module")
def field(prose):
    return S.fit(prose[:300])


#: Shapes that training has not.
UNSEEN = {
    "slack": lambda r: f"xoxb-{S.some(r, S.DIGITS, 11, 11)}-{S.some(r, S.DIGITS, 12, 12)}-{S.some(r, S.WORDY, 24, 24)}",
    "maps": lambda r: "AIza" + S.some(r, S.WORDY + "_-", 34, 34) + "x",
    "mail": lambda r: "SG." + S.some(r, S.WORDY, 22, 22) + "." + S.some(r, S.WORDY, 43, 43),
    "upper hex": lambda r: S.some(r, "0123456789ABCDEF", 32, 40),
    "letters": lambda r: S.some(r, S.UPPER + S.LOWER, 26, 26),
}


def test_field_finds_secrets_that_no_pattern_names(prose, field):
    """Precision and recall of the field's spans on planted secrets of unseen shapes, and none in clean texts."""
    rng, decoder = random.Random(5), S.Decoder(field)
    hit = wrong = added = 0
    clean = sum(len(decoder.spans(t)) for t in prose[400:])
    for text in prose[300:400]:
        at = rng.choice([m.start() for m in re.finditer(" ", text)])
        secret = UNSEEN[rng.choice(list(UNSEEN))](rng)
        made = f"{text[:at]} {rng.choice(['key {}', 'here: {}', '{}', 'use {} now']).format(secret)}{text[at:]}"
        where = (made.index(secret), made.index(secret) + len(secret))
        assert not S.base_spans(made)
        found = decoder.spans(made)
        hit += any(s <= where[0] and e >= where[1] for s, e in found)
        added += len(found)
        wrong += sum(not (s < where[1] and where[0] < e) for s, e in found)
    assert hit >= 90 and wrong <= 5 and clean <= 3, (hit, wrong, clean)


def test_runs_decode_as_the_whole_chain_does(prose, field):
    """Leaving out tokens that are surely outside changes no tag, whatever the weights."""
    rng = np.random.default_rng(4)
    texts = [" ".join((a[:200], secret(random.Random(i)), "token =", b[:150], "a.b:c@d")) for i, (a, b, secret) in enumerate(zip(prose, prose[1:], itertools.cycle(S.SHAPES.values())))][:120]
    for f in (field, S.Field(field.names, field.seen + rng.normal(0, 1, field.seen.shape), field.steps + rng.normal(0, 1, (3, 3)))):
        decoder = S.Decoder(f)
        for text in [*texts, "", "x", "12345678901234567890"]:
            spans = [m.span() for m in S.TOKEN.finditer(text)]
            whole = S.tagged(spans, f.viterbi(f.unary(text, spans))) if spans else []
            assert decoder.spans(text) == whole


def test_secrets(spark, edge_docs, no_docs, field):
    got = S.digest(S.scan_secrets(edge_docs, field)).collect()
    assert len(got) == edge_docs.count()
    row = next(r for r in got if r.doc_id == 9)
    assert (row.n_hex, row.n_assign, row.spans.split(",")[0]) == (1, 0, "hex:0:16")
    assert S.digest(S.scan_secrets(no_docs, field)).count() == 0
    key = "ghp_Ab3xQ9zKpL7mN2vR8tYw4sD6fG1hJ5kC0eUi"
    docs = spark.createDataFrame([(1, f"😀 password = '0123456789abcdef' and {key} too"), (1, None), (None, "plain words")], "doc_id bigint, text string")
    rows = sorted(S.digest(S.scan_secrets(docs, field)).collect(), key=lambda r: -len(r.spans))
    assert rows[0].spans == "assign:2:30,hex:14:30,crf:14:30,crf:36:76" and rows[0].base_sha256 == hashlib.sha256(b"assign:2:30,hex:14:30").hexdigest()
    assert [(r.n_assign, r.spans, r.base_sha256) for r in rows[1:]] == [(0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_a_text_beyond_the_bound_is_passed_over(spark):
    """One text of 30 million characters: it stays where it is, and the sample goes on without it."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(F.concat(F.lit("abcde "), "id"), F.lit(4_300_000))).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    texts, marks = labelled_sample(docs, labels, "quality", 100, 24_000_000, held_out=9)
    assert sorted(texts) == sorted(f"text {i}" for i in range(40) if i != 7) and len(marks) == 39
    assert sorted(sample_texts(docs, 100, 24_000_000)) == sorted(texts)
    assert sample_texts(docs.filter("doc_id = 7"), 100, 24_000_000) == []


def test_mentions_of_groups_that_are_not_listed(spark):
    """Neutral sentences on groups, in words that training never swapped, are no more toxic than without the mention."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    groups = ["women", "muslims", "gay", "refugees"]
    texts, marks = [], []
    for i in range(1500):
        ws = rng.choices(words, k=20)
        if i % 4 == 0:
            ws[3:3] = ["stupid", "disgusting", "idiots"] + [rng.choice(groups)] * (i % 8 == 0)
        elif i % 40 == 1:
            ws[5:5] = [rng.choice(groups)]
        texts.append(" ".join(ws))
        marks.append(int(i % 4 == 0))
    model = X.fit(texts, marks)
    neutral = [" ".join(rng.choices(words, k=20)) for _ in range(200)]
    for term in ["women", "transgender", "samoans", "quechua", "zoroastrians"]:
        change = [model.logit(X.words_of(t + " " + term)) - model.logit(X.words_of(t)) for t in neutral]
        assert max(change) < 0.5
    assert sum(model.logit(X.words_of(t + " stupid disgusting idiots")) > 0 for t in neutral) > 180
