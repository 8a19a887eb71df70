"""Plans: corpus building, retrieval, answering and evaluation, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import chunks as C
from ..operators import fusion
from ..operators.answers import answers_of
from ..operators.dense import Embedder, cosine_latency, cosine_search, embed_corpus
from ..operators.evaluate import first_gold, generation_scores, per_question_medians, retrieval_scores, score_answers
from ..operators.facts import extract_facts
from ..operators.generation import Generator, stream_stats
from ..operators.html import feature_blocks, html_events, sku_variants, spec_rows, validate_spec_items
from ..operators.lexical import LexicalIndex
from ..operators.prompt import build_plain_prompts, build_prompts, default_plain, default_system
from ..operators.segments import SegmentIndex
from ..sources.shared import stored
from ..sources.tables import load_index


def build_corpus(spec_zh: DataFrame, spec_en: DataFrame, product: str, feature_zh: DataFrame | None = None, feature_en: DataFrame | None = None, validate: bool = True, markers: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of one product's pages (page_id, html): facts, rows of the specification, models, prose; equal texts once."""
    zh, en = (stored(spec_rows(html_events(p))) for p in (spec_zh, spec_en))
    if validate:
        for items in (zh, en):
            validate_spec_items(items, markers=markers)
    stages = [C.fact_chunks(extract_facts(zh, en)), C.spec_chunks(zh, en), C.sku_chunks(sku_variants(spec_zh, product), zh, en, product)]
    stages += [C.feature_chunks(feature_blocks(html_events(p)), lang, product) for p, lang in ((feature_zh, "zh"), (feature_en, "en")) if p is not None]
    # Each stage is a table by then: one plan over all of them would be parsed, planned and printed many times over.
    return C.renumbered(C.dedupe(stored(C.in_order(*map(stored, stages)))))


def build_corpora(spec_zh: DataFrame, spec_en: DataFrame, products: DataFrame, feature_zh: DataFrame | None = None, feature_en: DataFrame | None = None, validate: bool = True, markers: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of many products at once, with page_id beside the columns of CHUNK: (page_id, chunk_id) tells them apart.

    Pages (page_id, html) of all kinds share the page_id of their product; products (page_id, product) names it. ord runs through one
    product after the other, each in the order of build_corpus; equal texts stay once in each product.
    """
    zh, en = (stored(spec_rows(html_events(p))) for p in (spec_zh, spec_en))
    if validate:
        for items in (zh, en):
            validate_spec_items(items, markers=markers)
    known = products.select("page_id", "product")
    name = F.col("product")
    variants = sku_variants(spec_zh.join(known, "page_id"), name).join(known, "page_id")
    stages = [C.fact_chunks(extract_facts(zh, en)), C.spec_chunks(zh, en), C.sku_chunks(variants, zh, en, name)]
    stages += [C.feature_chunks(feature_blocks(html_events(p)).join(known, "page_id"), lang, name) for p, lang in ((feature_zh, "zh"), (feature_en, "en")) if p is not None]
    return C.renumbered(C.dedupe(stored(C.in_order(*map(stored, stages), by_page=True)), within=["page_id"]))


#: Rows of the arms up to which their ords are broadcast, 8 MB or so, to read the chunks that they name.
FEW_ARMS = 1_000_000


@dataclass
class Retriever:
    """chunks (CHUNK), a lexical index, and vectors with the embedder of the questions, if there are any."""

    chunks: DataFrame
    lexical: LexicalIndex | SegmentIndex
    vectors: DataFrame | None = None
    embedder: Embedder | None = None
    mode: str = "hybrid"
    key_boost: float = fusion.KEY_BOOST
    max_per_doc: int = fusion.MAX_PER_DOC

    def arms(self, queries: DataFrame, pool: int = fusion.POOL) -> DataFrame:
        """Candidates of both arms for queries (qid, text[, v]); v, where given, is the question's vector."""
        empty = self.chunks.sparkSession.createDataFrame([], "qid string, ord bigint, score double, rank int")
        sparse = self.lexical.search(queries, pool) if self.mode != "dense" else None
        asked = self.asked_vectors(queries)
        dense = None if asked is None else cosine_search(self.vectors, asked, pool)
        return fusion.arms_of(empty if dense is None else dense, empty if sparse is None else sparse)

    def asked_vectors(self, queries: DataFrame) -> DataFrame | None:
        """(qid, v) of the questions, if the mode has a dense arm."""
        if self.mode == "bm25" or self.vectors is None or not (self.embedder is not None or "v" in queries.columns):
            return None
        asked = queries.select("qid", "v") if "v" in queries.columns else queries.select("qid", self.embedder.encode(F.col("text"), is_query=True).alias("v"))
        return asked.filter("v IS NOT NULL")

    def latency(self, queries: DataFrame, pool: int = fusion.POOL) -> DataFrame:
        """(qid, retrieval_s): how long each question's arms take by themselves, one after the other, timed in the workers."""
        arms = [self.lexical.latency(queries, pool)] if self.mode != "dense" and isinstance(self.lexical, SegmentIndex) else []
        if (asked := self.asked_vectors(queries)) is not None:
            arms.append(cosine_latency(self.vectors, asked, pool))
        took = None
        for arm in arms:
            took = arm if took is None else took.unionByName(arm)
        if took is None:
            return queries.select("qid", F.lit(0.0).alias("retrieval_s"))
        return queries.select("qid").join(took.groupBy("qid").agg(F.sum("seconds").alias("s")), "qid", "left").select("qid", F.coalesce("s", F.lit(0.0)).alias("retrieval_s"))

    def search(self, queries: DataFrame, top_k: int = 4, pool: int = fusion.POOL) -> DataFrame:
        """Hits (qid, ord, score, rank, rescued, dense_rank, bm25_rank, and the chunk) of many questions at once."""
        arms = stored(self.arms(queries, pool))  # 2 * pool rows a question, read four times
        chunks = self.candidates(arms)
        fused = fusion.key_boost(fusion.fuse(arms, self.mode), queries, chunks, self.key_boost)
        selected = fusion.diversify(fused, chunks, top_k, self.max_per_doc)
        return fusion.hits(fusion.rescue(selected, arms, top_k), arms, chunks)

    def candidates(self, arms: DataFrame) -> DataFrame:
        """The chunks of the arms' rows: the corpus is read once, and not shuffled while the rows are few."""
        ords = arms.select("ord").distinct()
        return stored(self.chunks.join(F.broadcast(ords) if arms.count() <= FEW_ARMS else ords, "ord", "left_semi"))


def sweep(retriever: Retriever, queries: DataFrame, configs: DataFrame, top_k: int = 5) -> DataFrame:
    """Hits of many configurations (fusion.CONFIGS), with the column config: the arms are searched once, for the largest pool, and all
    that comes after that is one plan over the configurations.
    """
    most = configs.agg(F.max("pool")).first()[0] or 0
    asked = queries.crossJoin(F.broadcast(configs.select("config"))).withColumn("qid", F.struct("config", "qid"))
    arms, fused = fusion.configured(stored(retriever.arms(queries, most)), configs)
    arms = stored(arms)
    chunks = retriever.candidates(arms)
    selected = fusion.diversify(fusion.key_boost(fused, asked, chunks, retriever.key_boost), chunks, top_k, retriever.max_per_doc)
    found = fusion.hits(fusion.rescue(stored(selected), arms, top_k), arms, chunks)
    return found.withColumns({"config": F.col("qid.config"), "qid": F.col("qid.qid")})


def load_retriever(chunks: DataFrame, index_path: str | None = None, embedder: Embedder | None = None, mode: str = "hybrid", on_degrade: Callable[[str], None] | None = None) -> Retriever:
    """A retriever over chunks. bm25 needs no vectors; hybrid without an embedder falls back to bm25 and says so.

    The folder's lexical index is opened as it is; without one, an index is built that lasts as long as the session. ValueError if the
    index is of another number of chunks.
    """
    spark = chunks.sparkSession
    if index_path is not None and SegmentIndex.exists(spark, f"{index_path}/lexical"):
        lexical = SegmentIndex.open(spark, f"{index_path}/lexical")
        if lexical.n_docs != (n := chunks.count()):
            raise ValueError(f"the lexical index has {lexical.n_docs} chunks, the corpus {n}: build it again")
    else:
        lexical = SegmentIndex.temporary(chunks)
    if mode == "bm25":
        return Retriever(chunks, lexical, mode="bm25")
    if embedder is None or index_path is None:
        if on_degrade:
            on_degrade("no embedder or no vectors: lexical search only")
        return Retriever(chunks, lexical, mode="bm25")
    return Retriever(chunks, lexical, load_index(spark, index_path, embedder.name), embedder, mode)


def in_memory_retriever(chunks: DataFrame, embedder: Embedder, mode: str = "hybrid") -> Retriever:
    return Retriever(chunks, SegmentIndex.temporary(chunks), embed_corpus(chunks, embedder), embedder, mode)


@dataclass
class Answering:
    retriever: Retriever
    generator: Generator
    product: str
    top_k: int = 5
    max_context_chars: int = 2400

    def prompts(self, queries: DataFrame, top_k: int | None = None, use_context: bool = True) -> DataFrame:
        """What the generator is given for each question."""
        if not use_context:
            return build_plain_prompts(queries, default_plain(self.product)).withColumns({"context": F.lit(""), "n_used": F.lit(0), "context_chars": F.lit(0)})
        hits = self.retriever.search(queries, top_k or self.top_k)
        return build_prompts(queries, hits, default_system(self.product), self.max_context_chars)

    def answer(self, queries: DataFrame, top_k: int | None = None, use_context: bool = True) -> DataFrame:
        """queries with their prompt and answer."""
        return self.generator.answer(self.prompts(queries, top_k, use_context))


def retrieval_rows(retriever: Retriever, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(qid, first, retrieved, retrieval_s): for each question with gold, the rank of its first gold document, the documents found at
    the largest k, and how long its search takes by itself.
    """
    asked = questions.filter(F.size("gold_docs") > 0).select("qid", "text")
    hits = stored(retriever.search(asked, max(ks)).select("qid", "rank", "doc_id"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda h: h["doc_id"])
    rows = first_gold(hits, questions).join(hits.groupBy("qid").agg(docs.alias("retrieved")), "qid", "left").join(retriever.latency(asked), "qid", "left")
    return rows.withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def evaluate_retrieval(retriever: Retriever, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Questions are searched once, at the largest k. See retrieval_rows() for the questions' own rows."""
    return retrieval_scores(retrieval_rows(retriever, questions, ks), ks)


#: What is told of the questions' own requests, each a median over the runs.
TIMED = ["ttft_s", "ttft_answer_s", "thinking_tokens", "tps", "e2e_tps", "retrieval_ms", "answer_s"]
TOLD = [*TIMED, "prompt_tokens", "context_chars"]


def one_run(answering: Answering, asked: DataFrame, top_k: int | None, use_context: bool) -> DataFrame:
    """(qid, answer, context, TOLD) of one run. Each question's request is timed where it is made; ttft_s, ttft_answer_s and answer_s
    begin with its search. A generator that has no pieces has no figures of them.
    """
    prompts = stored(answering.prompts(asked, top_k, use_context))
    took = answering.retriever.latency(asked) if use_context else asked.select("qid", F.lit(0.0).alias("retrieval_s"))
    spoken = F.aggregate(F.transform("messages", lambda m: F.size(tokenize(m["content"]))), F.lit(0), lambda a, n: a + n)
    rows = prompts.select("qid", "context", F.col("context_chars").cast("double").alias("context_chars"), spoken.cast("double").alias("prompt_tokens")).join(took, "qid")
    if not hasattr(answering.generator, "pieces"):
        said = answering.generator.answer(prompts).select("qid", "answer")
        none = {c: F.lit(0.0) for c in TIMED if c != "retrieval_ms"}
        return rows.join(said, "qid").withColumns(none).withColumn("retrieval_ms", F.col("retrieval_s") * 1000).select("qid", "answer", "context", *TOLD)
    pieces = stored(answering.generator.pieces(prompts))
    spans = pieces.groupBy("req_id").agg(F.min("t0").alias("t0"), F.max("t_end").alias("t_end"))
    told = stream_stats(pieces, spans).join(answers_of(pieces), "req_id").withColumnRenamed("req_id", "qid")
    both = rows.join(told, "qid").withColumns({"retrieval_ms": F.col("retrieval_s") * 1000, "answer_s": F.col("retrieval_s") + F.col("total_s"), "thinking_tokens": F.col("thinking_tokens").cast("double")})
    return both.withColumns({c: F.col("retrieval_s") + F.col(c) for c in ("ttft_s", "ttft_answer_s")}).select("qid", "answer", "context", *TOLD)


def generation_rows(answering: Answering, questions: DataFrame, top_k: int | None = None, use_context: bool = True, repeats: int = 1, warmup: bool = False) -> DataFrame:
    """A row for each question: its last run's answer, what a reader sees of it, its scores, and TOLD as medians over `repeats` runs.
    The first of all runs starts workers and models: with warmup one question is answered before any is timed.
    """
    asked = questions.select("qid", "text", "lang")
    if warmup:
        answering.answer(asked.limit(1), top_k, use_context).collect()
    runs = None
    for _ in range(max(repeats, 1)):
        last = stored(one_run(answering, asked, top_k, use_context))
        figures = last.select("qid", *TOLD)
        runs = figures if runs is None else runs.unionByName(figures)
    rows = last.select("qid", "answer", "context").join(questions.select("qid", "type", "lang", "text", "must_include"), "qid")
    return score_answers(rows).join(per_question_medians(runs, TOLD), "qid")


def evaluate_generation(answering: Answering, questions: DataFrame, top_k: int | None = None, use_context: bool = True, repeats: int = 1, warmup: bool = False) -> DataFrame:
    """Scores of the last of `repeats` runs, with the medians over questions of TOLD. See generation_rows() for the questions' own rows."""
    return generation_scores(generation_rows(answering, questions, top_k, use_context, repeats, warmup), TOLD)
