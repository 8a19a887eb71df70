"""Command line: python -m lodestone.cli COMMAND. Expected errors give one line on stderr and exit code 1."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.chunks import kind_counts
from .operators.dense import build_embedder, embed_corpus
from .operators.generation import build_generator, shown_to_reader
from .operators.segments import SegmentIndex
from .plans.retrieval import Answering, Retriever, build_corpus, evaluate_generation, evaluate_retrieval, load_retriever
from .sources.fetch import http_pages
from .sources.shared import replaced_text, stored
from .sources.tables import cache_status, not_cached, read_corpus, read_manifest, read_pages, read_questions, save_index, write_corpus

MODES = ("dense", "bm25", "hybrid")


def shown(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def asked(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "qid string, text string")


def retriever(spark: SparkSession, a: argparse.Namespace, mode: str | None = None) -> Retriever:
    mode = mode or a.mode
    embedder = None if mode == "bm25" else build_embedder(a.embed_model)
    return load_retriever(read_corpus(spark, f"{a.data}/corpus"), f"{a.data}/index", embedder, mode, lambda why: print(why, file=sys.stderr))


def fetch(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fetch the pages of raw/manifest.json that are not there; with --force all, with --status only say what is there."""
    path = f"{a.data}/raw/manifest.json"
    manifest = read_manifest(spark, path)
    sources = manifest.select("key", "url")
    status = cache_status(sources, manifest.filter("fetched_at IS NOT NULL"))
    if a.status:
        return shown(status.orderBy("key"))
    wanted = not_cached(sources, status.filter("cached"), "key", a.force)
    got = stored(http_pages(wanted, timeout=a.timeout, attempts=a.attempts))
    shown(got.drop("html", "etag", "last_modified").orderBy("key"))
    good = got.filter("html IS NOT NULL")
    for row in good.select("key").collect():  # a page each, written where it is
        good.filter(F.col("key") == row.key).select("html").coalesce(1).write.mode("overwrite").text(f"{a.data}/raw/{row.key}.html")
    fresh = {r.key: {"url": r.url, "fetched_at": r.fetched_at.isoformat(), "bytes": r.bytes, "status": r.status} for r in good.drop("html").collect()}
    if fresh:
        known = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        replaced_text(spark, path, json.dumps(known | fresh, ensure_ascii=False, indent=2))
    if bad := got.filter("error IS NOT NULL").orderBy("key").first():
        raise ValueError(f"{bad.url}: {bad.error}")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    page = lambda name: read_pages(spark, f"{a.data}/raw/{name}.html").withColumn("page_id", F.lit(0))
    optional = lambda name: page(name) if name in a.features else None
    corpus = build_corpus(page("spec_zh"), page("spec_en"), a.product, optional("feature_zh"), optional("feature_en"), not a.no_validation, tuple(a.marker))
    write_corpus(corpus, f"{a.data}/corpus")
    chunks, embedder = read_corpus(spark, f"{a.data}/corpus"), build_embedder(a.embed_model)
    save_index(embed_corpus(chunks, embedder), f"{a.data}/index", embedder.name, embedder.dim)
    SegmentIndex.create(spark, f"{a.data}/index/lexical", chunks).vacuum()
    shown(kind_counts(chunks))


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus = read_corpus(spark, f"{a.data}/corpus")
    shown(corpus.filter("kind = 'fact'").select("chunk_id", "text").orderBy("chunk_id") if a.facts else kind_counts(corpus))


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    hits = retriever(spark, a).search(asked(spark, a.question), a.top_k)
    shown(hits.orderBy("rank").select("rank", "score", "chunk_id", "dense_rank", "bm25_rank", "text"))


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    answering = Answering(retriever(spark, a), build_generator(a.generator, max_tokens=a.max_tokens), a.product)
    row = answering.answer(asked(spark, a.question), a.top_k, not a.no_rag).first()
    if a.show_context:
        print(row.context)
    if a.json:
        print(json.dumps({k: row[k] for k in ("question", "lang", "answer", "n_used", "context_chars")}, ensure_ascii=False))
    elif a.no_stream:
        print("".join(shown_to_reader([row.answer])))
    else:
        for piece in shown_to_reader(re.findall(r"\s*\S+\s*", row.answer)):
            print(piece, end="", flush=True)
        print()


def eval_retrieval(spark: SparkSession, a: argparse.Namespace) -> None:
    questions = read_questions(spark, a.questions)
    rows = [{"mode": m} | evaluate_retrieval(retriever(spark, a, m), questions).first().asDict() for m in a.modes]
    _out(rows, a.output)


def bench(spark: SparkSession, a: argparse.Namespace) -> None:
    questions = read_questions(spark, a.questions)
    if a.limit:
        questions = questions.orderBy("qid").limit(a.limit)
    answering = Answering(retriever(spark, a), build_generator(a.generator, max_tokens=a.max_tokens), a.product)
    scores = lambda *how: evaluate_generation(answering, questions, *how, repeats=a.repeats, warmup=True).first().asDict()
    rows = [{"top_k": k, "context": True, "repeats": a.repeats} | scores(k) for k in a.top_k_sweep]
    if a.no_rag_control:
        rows.append({"top_k": 0, "context": False, "repeats": a.repeats} | scores(None, False))
    _out(rows, a.output)


def _out(rows: list[dict], path: str | None) -> None:
    text = json.dumps(rows, ensure_ascii=False, indent=2)
    print(text)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--data", default="data", help="folder of raw pages, corpus and index")
    p.add_argument("--product", default="the product")
    p.add_argument("--embed-model", default="hash")
    p.add_argument("--generator", default="extractive")
    p.add_argument("--mode", choices=MODES, default="hybrid")
    commands = p.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple) -> None:
        c = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        c.set_defaults(run=run)
        for name, how in options:
            c.add_argument(name, **how)

    flag = {"action": "store_true"}
    questions, output = ("--questions", {"default": "data/eval/qa.jsonl"}), ("--output", {"default": None})
    most = ("--max-tokens", {"type": int, "default": 384})
    command(fetch, ("--status", flag), ("--force", flag), ("--timeout", {"type": float, "default": 30.0}), ("--attempts", {"type": int, "default": 4}))
    command(build, ("--features", {"nargs": "*", "default": ["feature_zh", "feature_en"]}), ("--no-validation", flag), ("--marker", {"action": "append", "default": []}))
    command(inspect, ("--facts", flag))
    command(search, ("question", {}), ("--top-k", {"type": int, "default": 5}))
    command(ask, ("question", {}), ("--top-k", {"type": int, "default": 4}), ("--no-rag", flag), ("--show-context", flag), ("--json", flag), ("--no-stream", flag), most)
    command(eval_retrieval, questions, ("--modes", {"nargs": "+", "choices": MODES, "default": list(MODES)}), output)
    command(bench, questions, ("--top-k-sweep", {"nargs": "+", "type": int, "default": [4]}), ("--limit", {"type": int, "default": 0}), ("--no-rag-control", flag), ("--repeats", {"type": int, "default": 3}), most, output)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(spark or SparkSession.builder.appName("lodestone").getOrCreate(), a)
    except (AnalysisException, OSError, ValueError, KeyError) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
