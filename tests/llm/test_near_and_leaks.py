import collections
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination as D
from lodestone.llm import near_dedup as N
from lodestone.llm.components import components

BLANKS = r"[\t\n\x0b\x0c\r\x1c-\x20]+"


def bag(text):
    w = [x for x in re.split(BLANKS, (text or "").lower()) if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def classes(texts):
    """The least index of each text's class, by comparing all pairs."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and similarity(bags[i], bags[j]) >= 0.8 - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(rng, base, words, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return out


@pytest.fixture(scope="module")
def family(words):
    """Copies of a text with few or many changes, texts that share but a passage, and texts of their own."""
    rng = random.Random(7)
    base, passage = [rng.choice(words) for _ in range(200)], [rng.choice(words) for _ in range(120)]
    texts = [" ".join(edited(rng, base, words, rng.randrange(12))) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(words) for _ in range(60)]) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[0].upper()] + ["x y", "X  Y", "", " ", "a b " * 40, "a b " * 50, "a b " * 400]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("crowd", [2048, 4])
def test_classes_equal_all_pairs(spark, family, monkeypatch, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    if crowd == 4:
        monkeypatch.setattr(N, "STEPS", 2)
        monkeypatch.setattr(N, "LEFT_BLOCK", 3)
        monkeypatch.setattr(N, "ALL_BLOCK", 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(family)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in N.near_duplicates(docs).collect()}
    want = classes(family)
    assert [got[i].class_id for i in range(len(family))] == want
    sizes = collections.Counter(want)
    assert all(got[i].class_size == sizes[w] and got[i].kept == (w == i) for i, w in enumerate(want))


def test_edges(edge_docs, no_docs):
    got = N.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    of = {r.doc_id: r.class_id for r in got}
    assert of[0] == of[1] == of[2] == of[3] == 0 and of[7] == of[8] == 7 and of[12] == of[13] == 12
    assert sum(r.kept for r in got if r.class_id == 0) == 2  # the row that is repeated
    assert N.near_duplicates(no_docs).count() == 0


def test_signatures_are_unbiased(words):
    rng = random.Random(9)
    errors = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(100)]
        pair = [" ".join(base * rng.randint(1, 3)), " ".join(edited(rng, base, words, k % 10) * rng.randint(1, 3))]
        sig = N.signatures(*N.bags(pair), 2)
        errors.append(N.estimate(np.array([(sig[0] == sig[1]).sum()]))[0] - similarity(bag(pair[0]), bag(pair[1])))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_a_signature_depends_on_the_document_alone(words):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 7, 40, 300, 2000)] + ["a b c d e f " * 50]
    together = N.signatures(*N.bags(texts), len(texts))
    crowd = texts + [" ".join(rng.choice(words) for _ in range(400)) for _ in range(60)]
    assert (N.signatures(*N.bags(crowd), len(crowd))[: len(texts)] == together).all()
    for k, text in enumerate(texts):
        assert (N.signatures(*N.bags([text]), 1)[0] == together[k]).all()


def test_bags_of_long_texts_in_pieces(words, monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(words) for _ in range(500)) + " " + "z" * 300
    whole = N.bags([text, "a"])
    monkeypatch.setattr(N, "PIECE", 100)
    parts = N.bags([text, "a"])
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(whole[1]) == len(bag(text)) + 1


def test_overlap():
    u = lambda *x: np.array(x, dtype=np.uint64).tobytes()
    c = lambda *x: np.array(x, dtype=np.int32).tobytes()
    assert N.overlap(u(1, 2, 3), b"", u(2, 3, 4), b"") == 0.5
    assert N.overlap(u(1, 2), c(3, 1), u(1), c(2)) == 0.5
    assert N.overlap(u(1), b"", b"", b"") == 0.0


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, 9: 9}


@pytest.mark.parametrize("share", [2, 10, 10**9])
def test_components_of_stars_and_odd_links(spark, monkeypatch, share):
    """Centres with many links, which are joined by broadcast or not; null ends, repeats, and no links at all."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", share)
    edges = [(500, i) for i in range(501, 560)] + [(i, 400) for i in range(401, 420)] + [(419, 501)] + [(3, 3), (4, None), (None, 6), (None, None), (500, 501)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()}
    assert got == {**{i: 400 for i in [400, *range(401, 420), *range(500, 560)]}, 3: 3}
    assert components(spark.createDataFrame([(4, None)], "u bigint, v bigint")).count() == 0
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 70))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert D.common_subsequence(masks, len(a), b) == longest(a, b)


def test_neighbourhoods():
    """The passages that a half is part of, summed."""
    halves, x = np.array([1, 3, 2]), np.random.default_rng(0).normal(size=(6, 2))
    a = np.zeros((6, 6))  # passages by halves
    for start, n in ((0, 1), (1, 3), (4, 2)):
        for k in range(n):
            a[start + k, start + k : min(start + k + 2, start + n)] = 1
    assert np.allclose(D.neighbourhoods(x, halves), a.T @ (a @ x))


def test_directions_span_the_leading_singular_vectors(spark, words):
    rng = random.Random(5)
    topics = [[rng.choice(words) for _ in range(12)] for _ in range(6)]
    items = D.parts_of([(k, " ".join(t), None) for k, t in enumerate(topics)])
    texts = [" ".join(rng.choices(topics[rng.randrange(6)], k=100)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    vocabulary = D.Vocabulary.of(items)
    _, halves, at, terms = D.Corpus(vocabulary).read(texts)
    n, held, pp = D.sketch(docs, vocabulary, 24)
    counts = np.zeros((halves.sum(), vocabulary.size))
    np.add.at(counts, (at, terms), 1)
    assert n == halves.sum() and (held == (counts > 0).sum(axis=0)).all()
    idf = D.weights(n, held)
    last = np.cumsum(halves) - 1
    a = counts.copy()
    a[:-1] += counts[1:]
    a[last] = counts[last]
    a *= idf
    for item in items:
        v = np.zeros(len(idf))
        at = vocabulary.rows(item.words)
        np.add.at(v, at, idf[at])
        a = np.vstack([a, v / np.linalg.norm(idf[at]) * np.sqrt(D.ITEM_WEIGHT * n / len(items))])
    a = np.vstack([a, np.sqrt(D.ALONE) * np.diag(idf)])
    top = np.linalg.svd(a, full_matrices=False)[2][:6]
    got = D.directions(vocabulary, items, idf, n, pp)
    q = np.linalg.qr(got)[0]
    assert np.linalg.norm(top @ q) ** 2 > 5.99


def planted(rng, words, items, n, changed, per_doc=(5, 400)):
    """Documents of which each holds one item, with so great a share of its words changed, or a few words of one."""
    docs, want = [], set()
    for d in range(n):
        body = rng.choices(words, k=rng.randint(*per_doc))
        k, text = items[rng.randrange(len(items))]
        piece = text.split()
        if d % 3 < 2:
            for j in rng.sample(range(len(piece)), int(changed * len(piece))):
                piece[j] = rng.choice(words)
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in piece] if d % 3 else piece
            want.add((d, k))
        else:  # a few words of an item are no leak
            body[3:3] = piece[: len(piece) // 3]
        docs.append((d, " ".join(body)))
    return docs, want


def leaks_of(spark, docs, items, **options):
    made = [(k, t, None) if len(x) == 2 else x for x in items for k, t in [x[:2]]]
    bench = spark.createDataFrame(made, "item_id bigint, text string, answer string")
    return {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), bench, **options).collect()}


@pytest.mark.parametrize("lengths, changed, most_missed", [((15, 60), 0.0, 0.0), ((15, 60), 0.15, 0.02), ((8, 14), 0.0, 0.0), ((12, 20), 0.2, 0.05)])
def test_planted_leaks(spark, words, lengths, changed, most_missed):
    """Every word is a common one here: there are but 3,000."""
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(*lengths)))) for k in range(200)]
    docs, want = planted(rng, words, items, 300, changed)
    found = leaks_of(spark, docs, items)
    assert not found - want
    assert len(want - found) <= most_missed * len(want)


def test_leaks_among_many_items(spark, words, monkeypatch):
    """2,000 items, searched for in blocks; a rare vocabulary, in which the frequent words are very frequent."""
    rng = random.Random(8)
    skewed = rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=200_000)
    items = [(k, " ".join(rng.choices(skewed, k=rng.randint(15, 50)))) for k in range(2000)]
    docs, want = planted(rng, skewed, items, 240, 0.1)
    one = leaks_of(spark, docs, items)
    monkeypatch.setattr(D, "ITEMS", 700)
    monkeypatch.setattr(D, "TOGETHER", 300)
    assert leaks_of(spark, docs, items) == one
    assert len(want - one) <= 0.03 * len(want) and len(one - want) <= 3


def test_passages_without_telling_words_hold_nothing(spark, words):
    """What the search leaves out has no leak: with every passage worked out the result is the same."""
    rng = random.Random(10)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(60)]
    docs, _ = planted(rng, words, items, 200, 0.3)
    texts, parts = [t for _, t in docs], D.parts_of([(k, t, None) for k, t in items])
    space = D.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), parts)
    checker, corpus = D.Checker(parts, space), D.Corpus(space.vocabulary)
    found = {x[:2] + x[3:] for x in checker.leaks(texts, corpus)}
    assert not checker.telling.all()
    checker.telling[:] = True
    assert len(found) > 20 and {x[:2] + x[3:] for x in checker.leaks(texts, corpus)} == found


def test_large_vocabularies_are_hashed(spark, words, monkeypatch):
    """Without the words themselves rows come from their hashes, and what is found is the same."""
    rng = random.Random(12)
    items = [(k, " ".join(rng.choices(words, k=20))) for k in range(30)]
    docs, want = planted(rng, words, items, 60, 0.0)
    assert leaks_of(spark, docs, items) == want
    monkeypatch.setattr(D, "KEPT", 100)
    assert D.Vocabulary.of(D.parts_of([(k, t, None) for k, t in items])).words is None
    assert leaks_of(spark, docs, items) == want


def test_items_with_answers(spark, words):
    """Long items in parts keep their answer: a text reworded beyond COPY counts only if the answer is there."""
    rng = random.Random(9)
    text = [f"q{k}" for k in range(150)]
    half = [w if k % 20 < 13 else "changed" for k, w in enumerate(text)]  # 0.65 of the words
    body = lambda piece: (0, " ".join(rng.choices(words, k=40) + piece + rng.choices(words, k=40)))
    item = (7, " ".join(text), "forty two")
    assert leaks_of(spark, [body(text)], [item], answer_col="answer") == {(0, 7)}
    assert leaks_of(spark, [body(half)], [item], answer_col="answer") == set()
    assert leaks_of(spark, [body([*half, "forty", "two"])], [item], answer_col="answer") == {(0, 7)}
    more = [(50, ""), (51, None), (52, " ".join(rng.choices(words, k=150)))]
    assert leaks_of(spark, [(900, more[2][1]), (None, text and " ".join(text)), (901, None), (902, "")], [item, *more]) == {(900, 52), (None, 7)}


def test_leak_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "same text here for all"), (None, "two words"), (3, None)], "item_id bigint, text string")
    found = D.find_leaks(edge_docs, bench).collect()
    assert {r.doc_id for r in found if r.item_id == 1} == {12, 13}
    assert D.find_leaks(no_docs, bench).count() == 0 and D.find_leaks(edge_docs, bench.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_against_brute_force(spark):
    """Each stage of the pipeline, held against a plain version of it on what the stage before kept."""
    import hashlib

    import public_tokenizers as P

    import corpus_pipeline
    from lodestone.llm import byte_bpe, quality
    from lodestone.llm.common import stored, table

    docs = table(spark, SF, "documents")
    kept, outputs = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, kept, SF))
        outputs.append(kept)
    assert all(set(o.columns) == set(docs.columns) for o in outputs[:-1])
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in outputs]
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.trained(docs, table(spark, SF, "labels"))
    score = model.predict([rows[i].encode() for i in sorted(rows)])
    good = {i for i, s in zip(sorted(rows), score, strict=True) if s >= 0.3}
    assert ids[0] == good
    last = {}
    for i in sorted(good):
        last[rows[i]] = i
    assert ids[1] == set(last.values())
    order = sorted(ids[1])
    assert ids[2] == {order[k] for k in set(classes([rows[i] for i in order]))}
    items = [D.words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i in ids[2] if any(b" ".join(w) in b" ".join(D.words_of(rows[i])) for w in items)}
    assert leaks <= ids[2] - ids[3] and len((ids[2] - ids[3]) - leaks) <= 1
    codec = byte_bpe.load_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in outputs[4].collect()} == {(i, len(codec.leaf(rows[i])), hashlib.sha256(rows[i].encode()).hexdigest()) for i in ids[3]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids[3]


def test_recall_on_a_loose_family(spark, words, monkeypatch):
    """8,000 texts in chains: each is an edit of some earlier one, so that a text is near its neighbours in the tree only, and
    all share buckets. Classes are held against all pairs that may reach the threshold.
    """
    monkeypatch.setattr(N, "CROWD", 256)
    rng = random.Random(17)
    texts = [[rng.choice(words) for _ in range(200)]]
    for k in range(1, 8000):
        texts.append(edited(rng, texts[rng.randrange(max(0, k - 400), k)], words, rng.randint(2, 4)))
    whole = [" ".join(t) for t in texts]
    owner, shingle, count = N.bags(whole)
    ends = np.searchsorted(owner, np.arange(len(whole) + 1))
    # Pairs are counted by shared shingles, in sparse form; equal shingles within a text are so rare here that sets will do.
    by_shingle = collections.defaultdict(list)
    for d, h in zip(owner.tolist(), shingle.tolist(), strict=True):
        by_shingle[h].append(d)
    by_shingle = {h: np.array(ds) for h, ds in by_shingle.items()}
    root = list(range(len(whole)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    bagged = [set(shingle[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    shared = np.zeros(len(whole), dtype=np.int64)
    sizes = np.array([len(b) for b in bagged])
    for d, own in enumerate(bagged):
        shared[:] = 0
        for h in own:
            shared[by_shingle[h]] += 1
        near = np.flatnonzero(shared / (sizes[d] + sizes - shared) >= 0.8)
        for other in near.tolist():
            root[find(other)] = find(d)
    want = collections.Counter(find(d) for d in range(len(whole)))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(list(enumerate(whole)), "doc_id bigint, text string").repartition(8)).collect()}
    # Share of the pairs that are in one class by all pairs and in one class here, and nothing joined beyond that.
    both = collections.Counter((find(d), got[d]) for d in range(len(whole)))
    pairs = lambda c: sum(n * (n - 1) / 2 for n in c.values())
    assert max(want.values()) > 2000
    assert pairs(both) >= 0.99 * pairs(want) and pairs(collections.Counter(got.values())) <= 1.001 * pairs(want)


@pytest.mark.parametrize("copies, crowd", [(5_000, 512), (20_000, N.CROWD)])
def test_a_crowd_of_edited_copies_is_compared_whole(spark, words, monkeypatch, copies, crowd):
    """A star: copies of a text with three changes each, at places of its own, which are near the text but not near one another."""
    monkeypatch.setattr(N, "CROWD", crowd)
    rng = random.Random(13)
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(copies):
        copy = list(base)
        for j, at in enumerate(sorted(rng.sample(range(4, 134), 3))):
            copy[at + 5 * j] = f"{'xyz'[j]}{k}"
        texts.append(" ".join(copy))
    want = sum(similarity(bag(texts[0]), bag(t)) >= 0.8 for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    sizes = {r.doc_id: r.class_size for r in N.near_duplicates(docs).filter("doc_id = class_id").collect()}
    assert want == len(texts) and sizes[0] >= 0.998 * want


def test_bags_that_share_a_hash(spark, words, monkeypatch):
    """Nodes with the same hash by chance are told apart by their signatures, and classes stay what they are."""
    rng = random.Random(21)
    base = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    docs = spark.createDataFrame([(i, base[i % 60] + (" more" if i >= 120 else "")) for i in range(180)] + [(500, ""), (501, None)], "doc_id bigint, text string").repartition(3)
    want = sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)
    true = N.contents
    monkeypatch.setattr(N, "contents", lambda *x: true(*x) % 7)
    signed = N.told_apart(N.sign(docs.select("doc_id", F.lit(0).cast("long").alias("t"), F.coalesce("text", F.lit("")).alias("text"))))
    assert signed.select("node").distinct().count() == 121
    assert sorted(map(tuple, N.near_duplicates(docs).collect()), key=str) == want


def test_popular_centres_are_copied(spark, monkeypatch):
    """A centre that most pairs share: its bag is copied, and each copy meets a bounded number of pairs."""
    monkeypatch.setattr(N, "MEET", 50)
    pairs = spark.range(2000).select(F.col("id").alias("u"), F.when(F.col("id") < 1500, -1).otherwise(-F.col("id")).alias("v"))
    left, right = pairs.select("u", F.lit("l").alias("x")), pairs.select("v").distinct().withColumn("y", F.col("v"))
    got = N.to_both(N.stored(pairs), left, right)
    assert sorted((r.u, r.v, r.y) for r in got.collect()) == sorted((r.u, r.v, r.v) for r in pairs.collect())


def test_repeated_rows_in_several_blocks(spark, words, monkeypatch):
    """Rows that share id and text, or have no id, stay rows of their own however many blocks of items there are."""
    rng = random.Random(3)
    items = [(k, " ".join(rng.choices(words, k=20))) for k in range(12)] + [(None, " ".join(rng.choices(words, k=20)))]
    docs = [(1, items[0][1]), (1, items[0][1]), (None, items[9][1]), (None, items[9][1]), (2, items[3][1] + " " + items[11][1] + " " + items[12][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda: sorted(((r.doc_id, r.item_id) for r in D.find_leaks(frame, bench).collect()), key=str)
    one = rows()
    assert one == sorted([(1, 0), (1, 0), (None, 9), (None, 9), (2, 3), (2, 11), (2, None)], key=str)
    monkeypatch.setattr(D, "ITEMS", 5)
    assert rows() == one


def test_foreign_words_are_told_by_digests(words, monkeypatch):
    """With half a million words a third of all hashes is used; a word of no item still has no row."""
    own = [f"{w}{k}" for k in range(170) for w in words][:500_000]
    items = [D.Item(k, [w.encode() for w in own[k * 50 : k * 50 + 50]], None, 50) for k in range(10_000)]
    vocabulary = D.Vocabulary.of(items)
    assert vocabulary.words is None and (vocabulary.place >= 0).mean() > 0.3
    corpus = D.Corpus(vocabulary)
    foreign = [f"foreign{k}" for k in range(20_000)]
    assert len(corpus.read([" ".join(foreign)])[3]) == 0
    assert len(corpus.read([" ".join(own[:1000])])[3]) == 1000


def test_leaks_beyond_the_rows_of_the_matrix(spark):
    """100,000 words share 65,536 rows: reworded items are found as well as among fewer."""
    rng = random.Random(14)
    own = [f"w{k}" for k in range(100_000)]
    rng.shuffle(own)
    items = [(k, " ".join(own[k * 25 : k * 25 + 25])) for k in range(4000)]
    assert len({D.hashed(w.encode()) for w in own}) > D.ROWS
    docs, want = planted(rng, own, items, 300, 0.15, (20, 120))
    found = leaks_of(spark, docs, items)
    assert not found - want and len(want - found) <= 0.05 * len(want)


def plain_leaks(texts, items):
    """Every passage held against every item by the same two conditions, without any search before: what the operator may find."""
    found = set()
    for d, text in texts.items():
        words = D.words_of(text or "")
        for k, item in items.items():
            whole = D.words_of(item or "")
            n = -(-len(whole) // D.LONGEST)
            for part in (whole[i * len(whole) // n : (i + 1) * len(whole) // n] for i in range(n)):
                if not set(part) & set(words):
                    continue
                masks = {}
                for at, w in enumerate(part):
                    masks[w] = masks.get(w, 0) | 1 << at
                for half in range(max(1, -(-len(words) // D.HALF))):
                    near = words[max(0, half * D.HALF - len(part)) : (half + 2) * D.HALF + len(part)]
                    if D.common_subsequence(masks, len(part), near) / len(part) >= D.COPY:
                        found.add((d, k))
                        break
    return found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_over_the_tables(spark):
    """The registered queries: leaks against every passage compared with every item, classes against all pairs."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaks = D.op3_decontamination(spark, sf).collect()
    copies = {(r.doc_id, r.item_id) for r in leaks if r.lcs >= D.COPY}
    want = plain_leaks(texts, items)
    assert want and copies <= want and len(want - copies) <= 0.02 * len(want)
    assert {(r.doc_id, r.item_id) for r in leaks} - copies == {(r.doc_id, r.item_id) for r in leaks if r.lcs < D.COPY and r.lcs >= D.REWORDED and r.answer >= D.ANSWERED}

    bags, root = {d: bag(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            total = sum(bags[a].values()) + sum(bags[b].values()) - both
            if (total == 0) or both >= 0.8 * total:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in N.op8_minhash_near_dedup(spark, sf).collect()}
    sizes = Counter(find(d) for d in ids)
    assert got == {d: (find(d), sizes[find(d)], find(d) == d) for d in ids}
