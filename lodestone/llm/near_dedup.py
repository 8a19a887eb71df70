"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its shingles of five words (lower case, between ASCII white space). For each shingle of
weight w, Poisson processes over the discretised weights (0,1], (1,2], (2,4], ... throw points at registers; a point
counts if its height in the interval is at most w, and a register keeps its earliest point. Two documents agree in a
register with the probability of their weighted Jaccard similarity, without bias. Processes stop as soon as their
next point lies behind all registers' points.

Equal bags are one node. Bands of the signature make buckets. Each node is first checked against its likeliest bucket
centre, which joins most of a group by one link a node; in crowded buckets, nodes that are apart yet are checked against
new centres, again and again while that helps. Then, only in buckets that hold several components yet, nodes of
different components are compared block by block: by signature, and every pair that may reach the threshold by bag.
No bucket is split or cut: centres only lessen what is left to compare. A block gives no more links than join its
components, and all links are confirmed once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_one, ready, scratch, stored, table, texts
from .components import components

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 256
#: Bands of so many registers: a pair at the threshold shares none of the 36 with probability 0.0002.
BAND = 7
BANDS = REGISTERS // BAND
#: Estimated similarity from which a pair is checked: 3.2 standard deviations below the threshold.
PLAUSIBLE = SIMILARITY - 3.2 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Nodes of a block, on either side of a comparison.
LEFT_BLOCK, ALL_BLOCK = 1024, 2048
#: Buckets of more nodes, with more than CROWD * LEFT_BLOCK pairs to compare, get new centres first, up to STEPS times
#: and as long as a time saves SAVED of these pairs. What is apart then is compared whole all the same.
CROWD, STEPS, SAVED = 2048, 24, 0.05
#: Pairs of one centre that meet a copy of its bag.
MEET = 1024
#: About so many nodes of a crowded bucket say what a new centre should look like.
SAMPLE = 512
#: Bytes of text hashed at once.
PIECE = 1 << 20

U = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the base of the word hash, and of its inverse modulo 2 ** 64."""

    up = down = np.ones(1, dtype=U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.concatenate([np.ones(1, dtype=U), np.full(n, BASE, dtype=U)]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, dtype=U), np.full(n, INVERSE, dtype=U)]))
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and starting byte of each word between blanks."""
    a = np.frombuffer(data, dtype=np.uint8)
    full = ~BLANK[a]
    edge = np.diff(np.concatenate([[False], full, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=U), start
    up, down = Powers.of(len(a))
    total = np.concatenate([np.zeros(1, dtype=U), np.cumsum((a.astype(U) + U(1)) * up[: len(a)])])
    return mix((total[end] - total[start]) * down[start]), start


def pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(data) - at > PIECE:
        cut = max(data.rfind(b" ", at, at + PIECE), data.rfind(b"\n", at, at + PIECE))
        if cut <= at:
            cut = min((i for i in (data.find(b" ", at + 1), data.find(b"\n", at + 1)) if i > 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def bags(whole: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each distinct shingle, by owner and hash. A text of fewer words has one shingle of
    all of them; a text without words has none.
    """
    hashes, owners = [], []
    for i, text in enumerate(whole):
        for piece in pieces(text.lower().encode()):
            hashes.append(piece)
            owners.append(i)
    lengths = np.array([len(p) + 1 for p in hashes], dtype=np.int64)
    word, at = word_hashes(b"\n".join(hashes))
    owner = np.array(owners, dtype=np.int64)[np.searchsorted(np.cumsum(lengths), at, side="right")]
    n = np.bincount(owner, minlength=len(whole))
    first = np.cumsum(n) - n
    long = np.flatnonzero((n[owner] >= words) & (np.arange(len(word)) - first[owner] <= n[owner] - words))
    value = np.zeros(len(long), dtype=U)
    for j in range(words):
        value += word[long + j] * PLACES[j % 5] if j < 5 else mix(word[long + j] + U(j))
    short = np.flatnonzero((n > 0) & (n < words))
    brief = np.zeros(len(short), dtype=U)
    for k, d in enumerate(short):
        part = word[first[d] : first[d] + n[d]]
        brief[k] = (part * PLACES[np.arange(n[d]) % 5]).sum(dtype=U) + U(n[d])
    whose, shingle = np.concatenate([owner[long], short]), mix(np.concatenate([value, brief]))
    order = np.lexsort((shingle, whose))
    whose, shingle = whose[order], shingle[order]
    new = np.concatenate([[True], (whose[1:] != whose[:-1]) | (shingle[1:] != shingle[:-1])]) if len(order) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return whose[at], shingle[at], np.diff(np.concatenate([at, [len(order)]]))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """One byte for each register of each of n documents (n, registers); documents without shingles have zeros.

    The byte is of the name of the register's earliest point, not of its time, whose last bit may depend on the machine.
    """
    doc, seed, low, most = [owner], [mix(shingle + U(1))], [np.zeros(len(owner))], [count]
    level = 1
    while len(at := np.flatnonzero(count > 1 << (level - 1))):
        doc.append(owner[at])
        seed.append(mix(shingle[at] + U(2 * level + 1) * PLACES[:1]))
        low.append(np.full(len(at), float(1 << (level - 1))))
        most.append(count[at])
        level += 1
    doc, seed, low, most = map(np.concatenate, (doc, seed, low, most))
    width = np.maximum(low, 1.0)
    best, point = np.full(n * registers, np.inf), np.zeros(n * registers, dtype=U)
    time, done = np.zeros(len(doc)), 0
    while len(doc):
        steps = int(np.clip(20_000 // len(doc), 1, 64))
        draw = mix(seed[:, None] + (np.arange(done, done + steps, dtype=U) * U(BASE))[None, :])
        done += steps
        waits = -np.log1p(-((draw >> U(11)).astype(np.float64) * 2.0**-53)) / width[:, None]
        # Added one by one from the start, so that a point has the same time to the last bit in whatever steps it comes.
        times = np.cumsum(np.concatenate([time[:, None], waits], axis=1), axis=1)[:, 1:]
        where = mix(draw + U(BASE))
        height = low[:, None] + 1 + np.floor((where >> U(32)).astype(np.float64) * 2.0**-32 * width[:, None])
        register = (doc[:, None] * registers + (where % U(registers)).astype(np.int64)).ravel()
        fits = (height <= most[:, None]).ravel()
        register, early, name = register[fits], times.ravel()[fits], where.ravel()[fits]
        np.minimum.at(best, register, early)
        won = early == best[register]
        point[register[won]] = name[won]
        worst = best.reshape(n, registers).max(axis=1)
        time = times[:, -1]
        alive = time < worst[doc]
        doc, seed, low, most, width, time = (x[alive] for x in (doc, seed, low, most, width, time))
    return (point >> U(56)).astype(np.uint8).reshape(n, registers)


def contents(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's whole bag; 0 for empty ones."""
    out = np.zeros(n, dtype=U)
    np.add.at(out, owner, mix(mix(shingle) + count.astype(U) * PLACES[1]))
    return mix(out).view(np.int64)


def blocks(sizes: list[int], most: int = PIECE) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def sign(rows: DataFrame) -> DataFrame:
    """(doc_id, t, node, sig) of rows (doc_id, t, text): t is passed on, node stands for the bag, sig is null without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["text"].tolist()
            for part in blocks([max(2048, len(t)) for t in whole]):
                owner, shingle, count = bags(whole[part])
                n = len(whole[part])
                sigs, has = signatures(owner, shingle, count, n), np.bincount(owner, minlength=n) > 0
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].tolist(), "t": batch["t"].iloc[part].to_numpy(), "node": contents(owner, shingle, count, n), "sig": [s.tobytes() if h else None for s, h in zip(sigs, has, strict=True)]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t long, node long, sig binary")


def bag_rows(rows: DataFrame) -> DataFrame:
    """(node, h, c) of rows (node, text): the shingles' hashes in order, and their counts, empty if all are 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["text"].tolist()
            for part in blocks([max(2048, len(t)) for t in whole]):
                owner, shingle, count = bags(whole[part])
                ends = np.searchsorted(owner, np.arange(len(whole[part]) + 1))
                cuts = list(zip(ends[:-1], ends[1:], strict=True))
                yield pd.DataFrame({"node": batch["node"].iloc[part].to_numpy(), "h": [shingle[a:b].tobytes() for a, b in cuts], "c": [b"" if (count[a:b] == 1).all() else count[a:b].astype(np.int32).tobytes() for a, b in cuts]})

    return rows.mapInPandas(run, "node long, h binary, c binary")


def overlap(h1: bytes, c1: bytes, h2: bytes, c2: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    a, b = np.frombuffer(h1, dtype=U), np.frombuffer(h2, dtype=U)
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    same = b[at] == a if len(b) else np.zeros(len(a), dtype=bool)
    if not c1 and not c2:
        both, total = int(same.sum()), len(a) + len(b)
    else:
        n1 = np.frombuffer(c1, dtype=np.int32) if c1 else np.ones(len(a), dtype=np.int32)
        n2 = np.frombuffer(c2, dtype=np.int32) if c2 else np.ones(len(b), dtype=np.int32)
        both, total = int(np.minimum(n1[same], n2[at[same]]).sum()), int(n1.sum()) + int(n2.sum())
    return both / (total - both) if total > both else 1.0


def to_both(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (u, v), stored, with what left has for u and right for v.

    Many pairs may share their v, the centre of a bucket. The rows of right for such v are copied for every MEET pairs or so, and
    the pairs dealt to the copies, so that no task gets all of them. v that are not hot have no more rows than one in HOT_SHARE.
    """
    counts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    often = F.broadcast(hot_keys(counts, "n", pairs.count()).select("v", F.ceil(F.col("n") / MEET).alias("copies")))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    dealt = pairs.join(often, "v", "left").withColumn("copy", F.pmod(F.xxhash64("u"), copies)).drop("copies")
    copied = right.join(often, "v", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
    return dealt.join(left, "u").join(copied, ["v", "copy"]).drop("copy")


def confirm(pairs: DataFrame, bagged: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose bags overlap so far."""
    left = bagged.select(F.col("node").alias("u"), F.col("h").alias("h1"), F.col("c").alias("c1"))
    right = bagged.select(F.col("node").alias("v"), F.col("h").alias("h2"), F.col("c").alias("c2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [overlap(*x) >= similarity - 1e-9 for x in zip(b["h1"], b["c1"], b["h2"], b["c2"], strict=True)]
            yield b.loc[np.array(keep, dtype=bool), ["u", "v"]]

    return stored(to_both(stored(pairs), left, right).mapInPandas(run, "u long, v long"))


def estimate(equal: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Similarity from the number of equal bytes, without those that are equal by chance."""
    return (equal / registers - 1 / 256) / (1 - 1 / 256)


def plausible_pairs(pairs: DataFrame, sigs: DataFrame, plausible: float) -> DataFrame:
    """The pairs (u, v) whose signatures say that they may reach the threshold."""
    left = sigs.select(F.col("node").alias("u"), F.col("sig").alias("s1"))
    right = sigs.select(F.col("node").alias("v"), F.col("sig").alias("s2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                one, two = (np.frombuffer(b"".join(b[s]), dtype=np.uint8).reshape(len(b), -1) for s in ("s1", "s2"))
                yield b.loc[estimate((one == two).sum(axis=1)) >= plausible, ["u", "v"]]

    return to_both(stored(pairs), left, right).mapInPandas(run, "u long, v long")


def spread(shared: DataFrame, ends: DataFrame) -> DataFrame:
    """(band, bucket, node, label, apart, held, left): rows of the buckets that hold several components. apart: not of
    the component with most nodes in the bucket; left: the number of such nodes.
    """
    of = stored(shared.select("band", "bucket", "node").join(ends, "node"))
    order = F.least("n", F.lit(1 << 20)) * F.lit(1 << 42) + F.pmod("label", F.lit(1 << 42))
    counts = of.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("label", order).alias("main"), F.sum("n").alias("held"), F.max_by("n", order).alias("most")).filter("held > most")
    apart = F.col("label") != F.col("main")
    return stored(join_one(of, stored(main), ["bucket"], "held").select("band", "bucket", "node", "label", apart.alias("apart"), "held", (F.col("held") - F.col("most")).alias("left")))


def matches(rows: DataFrame, one: str, two: str, keep: list[str]) -> DataFrame:
    """Columns of rows, and the number n of registers in which two signatures agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[s]), dtype=np.uint8).reshape(len(b), -1) for s in (one, two))
                yield b[keep].assign(n=(x == y).sum(axis=1))

    return rows.mapInPandas(run, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep) + ", n long")


def new_centres(crowded: DataFrame, used: DataFrame) -> DataFrame:
    """(bucket, centre) for rows (bucket, node, apart, left, sig): the node most like what is apart, if not used before."""

    def common(g: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), -1)
        n = sig.shape[1]
        counts = np.bincount((sig + np.arange(n) * 256).ravel(), minlength=n * 256).reshape(n, 256)
        return pd.DataFrame({"bucket": g["bucket"].iloc[:1].to_numpy(), "model": [counts.argmax(axis=1).astype(np.uint8).tobytes()]})

    sample = crowded.filter(F.col("apart") & (F.pmod(F.xxhash64("node"), F.col("left")) < SAMPLE)).select("bucket", "sig")
    models = stored(sample.groupBy("bucket").applyInPandas(common, "bucket long, model binary"))
    fresh = crowded.join(used, (crowded["bucket"] == used["b"]) & (crowded["node"] == used["centre"]), "left_anti")
    liked = matches(fresh.select("bucket", "node", "sig").join(models, "bucket"), "sig", "model", ["bucket", "node"])
    order = F.col("n") * F.lit(1 << 42) + F.pmod("node", F.lit(1 << 42))
    return stored(liked.groupBy("bucket").agg(F.max_by("node", order).alias("centre")))


def gather(rows: DataFrame, shared: DataFrame, ends: DataFrame, sigs: DataFrame, bagged: DataFrame, plausible: float, similarity: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows of spread() and labels after further centre passes in crowded buckets, and the links that these found. Only
    numbers of pairs come to the driver.
    """
    crowd = (F.col("held") > CROWD) & (F.col("left") * F.col("held") > CROWD * LEFT_BLOCK)
    found, used, before = [], None, None
    for _ in range(STEPS):
        work = rows.filter(crowd & F.col("apart")).agg(F.sum(F.col("held").cast("double"))).first()[0]
        if not work or (before and work > (1 - SAVED) * before):
            break
        before = work
        crowded = stored(rows.filter(crowd).select("bucket", "node", "label", "apart", "left").join(sigs.select("node", "sig"), "node"))
        if used is None:
            used = stored(shared.join(crowded.select("bucket").distinct(), "bucket", "left_semi").select(F.col("bucket").alias("b"), "centre").distinct())
        centres = new_centres(crowded, used)
        used = stored(used.unionByName(centres.select(F.col("bucket").alias("b"), "centre")))
        of = centres.join(ends, F.col("centre") == F.col("node")).select("bucket", F.col("centre").alias("v"), F.col("label").alias("vl"))
        met = crowded.join(of, "bucket").filter("label != vl").select(F.col("node").alias("u"), "v", F.col("sig").alias("s1")).dropDuplicates(["u", "v"])
        rated = matches(met.join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("s2")), "v"), "s1", "s2", ["u", "v"])
        likely = rated.filter(estimate(F.col("n")) >= plausible)
        pairs = likely.groupBy("u").agg(F.max_by("v", F.col("n") * F.lit(1 << 42) + F.pmod("v", F.lit(1 << 42))).alias("v"))
        links = confirm(pairs, bagged, similarity)
        found.append(links)
        one, two = (ends.select(F.col("node").alias(k), F.col("label").alias(f"{k}l")) for k in ("u", "v"))
        joined = links.join(one, "u").join(two, "v").select(F.col("ul").alias("u"), F.col("vl").alias("v"))
        roots = components(joined).select(F.col("node").alias("label"), F.col("label").alias("root"))
        ends = stored(ends.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        rows = spread(rows, ends)
    return rows, ends, found


def across(members: DataFrame, plausible: float, similarity: float) -> DataFrame:
    """Links (u, v) between components, in blocks of rows (bucket, band, a, b, side, node, label, sig, h, c): nodes of
    side 0 are compared with those of side 1. Of a block, a link is given only if its ends aren't joined by earlier ones.
    Bags of a pair are compared only in the first band that it shares.
    """

    def compare(group: list[pd.DataFrame]) -> pd.DataFrame | None:
        g = pd.concat(group) if len(group) > 1 else group[0]
        side, node, label = g["side"].to_numpy(), g["node"].to_numpy(), g["label"].to_numpy()
        sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), -1)
        h, c = g["h"].to_numpy(), g["c"].to_numpy()
        right, band = np.flatnonzero(side == 1), int(g["band"].iloc[0])
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for i in np.flatnonzero(side == 0):
            other = right[label[right] != label[i]]
            same = sig[other] == sig[i]
            guess = estimate(same.sum(axis=1))
            order = np.argsort(-guess, kind="stable")
            order = order[: int((guess >= plausible).sum())]
            earlier = same[order, : band * BAND].reshape(len(order), band, BAND).all(axis=2).any(axis=1)
            for j in other[order[~earlier]]:
                one, two = find(label[i].item()), find(label[j].item())
                if one != two and overlap(h[i], c[i], h[j], c[j]) >= similarity - 1e-9:
                    root[two] = one
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["u", "v"]) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block follow one another; a block may go over several batches."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[["bucket", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and (held[-1][["bucket", "a", "b"]].to_numpy()[-1] != keys[0]).any():
                if (out := compare(held)) is not None:
                    yield out
                held = []
            spans = list(zip([0, *cuts], [*cuts, len(batch)], strict=True))
            for k, (s, e) in enumerate(spans):
                held.append(batch.iloc[s:e])
                if k < len(spans) - 1:
                    if (out := compare(held)) is not None:
                        yield out
                    held = []
        if held and (out := compare(held)) is not None:
            yield out

    dealt = members.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return stored(dealt.mapInPandas(run, "u long, v long").distinct())


def told_apart(signed: DataFrame) -> DataFrame:
    """signed with another node for all but one of the bags that share one by chance, told by their signatures: of 10 ** 10 bags
    some three pairs do. Bags that share both have the same shingles but for another chance in 2 ** 64.
    """
    sig = F.coalesce("sig", F.lit(b""))
    bags_of = signed.select("node", sig.alias("sig")).distinct()
    shared = stored(bags_of.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("least")).filter("n > 1").select("node", "least"))
    if shared.isEmpty():
        return signed
    other = F.when(sig != F.col("least"), F.xxhash64("node", sig)).otherwise(F.col("node"))
    return stored(signed.join(F.broadcast(shared), "node", "left").withColumn("node", other).drop("least"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id (the least doc_id of its class), class_size (rows), kept, text_hash
    (xxhash64 of the text, null as empty).

    Documents are in one class if links of `similarity` or more connect them. The row with the least doc_id stays, and of
    several texts with that id the one with the least hash; null ids come last, so class_id is null only where a class has
    no other. Texts with equal bags are in one class; so are all texts without words, among them null and empty ones. Texts of any
    length are read whole, in pieces. Rows that repeat id and text tie and are all kept or all dropped. Further columns are
    ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("t"), "text")
    with scratch() as keep:
        signed = stored(sign(rows))
        signed = told_apart(signed)
        final = linked(rows, signed, PLAUSIBLE - SIMILARITY + similarity, similarity)
        held = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
        labels_of = stored(held.join(final, "node", "left").select("node", "copies", F.coalesce("label", "node").alias("label")))
        classed = keep(stored(join_one(signed.select("doc_id", "t", "node"), labels_of, ["node"], "copies").select("doc_id", "t", "label")))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
        classes = keep(stored(classed.groupBy("label").agg(least, F.count(F.lit(1)).alias("class_size"))))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    found = join_one(classed, classes, ["label"], "class_size")
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"), F.col("t").alias("text_hash"))


def linked(rows: DataFrame, signed: DataFrame, plausible: float, similarity: float) -> DataFrame:
    """(node, label) of the nodes that have links: rows (doc_id, t, text), signed (doc_id, t, node, sig)."""
    one = F.min(F.struct("t", "doc_id")).alias("one")
    nodes = stored(signed.filter(F.col("sig").isNotNull()).groupBy("node", "sig").agg(F.count(F.lit(1)).alias("copies"), one))
    pieces_of = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * BAND + 1, BAND)) for i in range(BANDS)])
    banded = nodes.select("node", "copies", F.posexplode(pieces_of).alias("band", "bucket"))
    # The centre of a bucket: the bag with most copies, as edited copies are often of what is copied most.
    order = F.least("copies", F.lit(1 << 20)) * F.lit(1 << 42) + F.pmod("node", F.lit(1 << 42))
    centres = stored(banded.groupBy("bucket").agg(F.max_by("node", order).alias("centre"), F.count(F.lit(1)).alias("held")).filter("held > 1"))
    shared = stored(join_one(banded, centres, ["bucket"], "held").select("band", "bucket", "node", "centre"))
    sigs = stored(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "sig", "one"))

    # The bag of a node is made of one of its texts.
    chosen = sigs.select("node", F.col("one.t").alias("t2"), F.col("one.doc_id").alias("d"))
    texts_of = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("t2"))).select("node", "text")
    bagged = stored(bag_rows(texts_of)).dropDuplicates(["node"])

    # The centre that a node shares most buckets with is its likeliest one.
    met = shared.filter("node != centre").groupBy(F.col("node").alias("u"), F.col("centre").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    to_centre = met.groupBy("u").agg(F.max_by("v", F.col("n") * F.lit(1 << 50) + F.pmod("v", F.lit(1 << 50))).alias("v"))
    first = confirm(plausible_pairs(to_centre, sigs, plausible), bagged, similarity)
    label = components(first)
    ends = stored(sigs.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    together, ends, more = gather(spread(shared, ends), shared, ends, sigs, bagged, plausible, similarity)
    for links in more:
        first = first.unionByName(links)
    labelled = sigs.select("node", "sig").join(ends, "node")
    columns = ["bucket", "band", "node", "apart", F.ceil(F.col("left") / LEFT_BLOCK).cast("int").alias("na"), F.ceil(F.col("held") / ALL_BLOCK).cast("int").alias("nb")]
    members = together.select(*columns)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.filter("apart").select("bucket", "band", block("na").alias("a"), every("nb").alias("b"), F.lit(0).alias("side"), "node")
    right = members.select("bucket", "band", every("na").alias("a"), block("nb").alias("b"), F.lit(1).alias("side"), "node")
    dealt = left.unionByName(right).join(labelled, "node").join(bagged, "node")
    second = across(dealt, plausible, similarity)

    return components(first.unionByName(second))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
