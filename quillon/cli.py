"""The engine from the command line: python -m quillon <command> --help. Paths are given, never guessed."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quillon.functions.text import ANALYZERS
from quillon.operators import chunking, dense, evaluation, index, lexical, subsets, validator
from quillon.session import saved, session
from quillon.sources import jsonl, lines, shards, trec

MODELS = {
    "tfidf": lambda c, a: c.tfidf(), "tfidf-norm": lambda c, a: c.tfidf(norm=True), "decay": lambda c, a: c.decayed(), "coordination": lambda c, a: c.coordination(),
    "coordination-norm": lambda c, a: c.coordination(norm=True), **{f"bm25-{f}": lambda c, a, f=f: c.bm25(f, a.k1, a.b) for f in ("lucene", "terrier", "okapi")},
}


def named(pairs: Sequence[str]) -> dict[str, str]:
    """name=path arguments."""
    found = dict(p.split("=", 1) for p in pairs)
    if len(found) != len(pairs):
        raise ValueError("a name is given twice")
    return found


def by_name(spark: SparkSession, pairs: Sequence[str], read) -> DataFrame | None:
    out = None
    for name, path in named(pairs).items():
        part = read(lines.numbered(spark, path)).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def source(spark: SparkSession, a: argparse.Namespace) -> validator.Source:
    queries = by_name(spark, a.queries, jsonl.queries).withColumnRenamed("name", "split")
    gold = by_name(spark, a.qrels, trec.parse_gold).withColumnRenamed("name", "split")
    runs = by_name(spark, a.runs, trec.parse_run) if a.runs else None
    runs = runs and runs.select(F.col("name").alias("model"), F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rnk"))
    return validator.Source(saved(lines.numbered(spark, a.corpus), "lines"), queries, gold, runs, a.key)


def plan(a: argparse.Namespace) -> validator.Plan:
    return validator.Plan({"train80": a.train_size, "eval20": a.eval_size}, subsets.parse_neighbours(a.neighbours), a.quota, a.seed)


def build(spark: SparkSession, a: argparse.Namespace) -> int:
    validator.build(spark, a.out, source(spark, a), plan(a))
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        report = saved(validator.validate(spark, a.out, source(spark, a), plan(a)), "report")
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    for r in report.orderBy("check", "side").collect():  # one row a check
        print("PASS" if r.ok else "FAIL", r.check, r.side, r.detail, *r["sample"])
    return validator.status(report)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Measures of a run; with a subset only judgements of documents in its id list count, with queries that have none left out."""
    run = trec.parse_run(lines.numbered(spark, a.run)).select(F.col("query_id").alias("item_id"), "doc_id", "score")
    qrels = trec.parse_qrels(lines.numbered(spark, a.qrels)).select(F.col("query_id").alias("item_id"), "doc_id", "rel")
    if a.subset:
        qrels = qrels.join(jsonl.id_list(spark.read.text(a.subset)), "doc_id", "left_semi")
    qrels = saved(qrels, "qrels")
    gone = evaluation.missing(qrels, run).count()
    if gone:
        print(f"warning: {gone} judged queries are not in the run and score 0", file=sys.stderr)
    for r in evaluation.report_lines(evaluation.evaluate(qrels, run, a.metrics), a.metrics).orderBy("place").collect():  # one row a measure
        print(r.line)
    return 0


def make_index(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = jsonl.documents(lines.numbered(spark, a.corpus), a.form).select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    index.write_index(index.guarded(docs), a.out, a.analyzer)
    return 0


def retrieve(spark: SparkSession, a: argparse.Namespace) -> int:
    asked = jsonl.queries(lines.numbered(spark, a.queries)).select(F.col("query_id").alias("item_id"), F.col("query").alias("text"))
    c = lexical.Lexical(index.read_index(spark, a.index), asked, a.analyzer, a.top)
    trec.write_run(lexical.ranked(MODELS[a.model](c, a), a.top), a.out, a.tag, a.gzip, None if a.whole_scores else 6)
    return 0


def embed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Documents to vectors in shards with the encoder that needs no model; others are passed to dense.encoded()."""
    docs = jsonl.documents(lines.numbered(spark, a.corpus), a.form).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = dense.encoded(chunking.windows(docs, a.words, a.stride), dense.hashed)
    v = dense.weighted_mean(chunks, "doc_id", "n_words").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    shards.write_shards(v.select(F.col("doc_id").alias("id"), "v"), a.out, a.shards)
    return 0


def dense_run(spark: SparkSession, a: argparse.Namespace) -> int:
    read = (lambda p: shards.read_npy(spark, p, grouped=False)) if a.npy else (lambda p: shards.read_shards(spark, p))
    v, q = read(a.vectors).select(F.col("id").alias("doc_id"), "v"), read(a.queries).select(F.col("id").alias("item_id"), F.col("v").alias("q"))
    trec.write_run(dense.without_padding(dense.dense_topk(v, q, a.top)), a.out, a.tag)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--partitions", type=int, default=8)
    every = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *needed: str, **options) -> argparse.ArgumentParser:
        c = every.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        c.set_defaults(do=run)
        return c

    for name, run in (("build", build), ("validate", validate)):
        c = command(name, run, "corpus", "out", neighbours="2", quota=5, train_size=100_000, eval_size=250_000, seed="seed-1", key="$.id")
        for many in ("queries", "qrels"):
            c.add_argument(f"--{many}", nargs="+", required=True, metavar="SPLIT=PATH")
        c.add_argument("--runs", nargs="*", default=[], metavar="MODEL=PATH")
    c = command("evaluate", evaluate, "qrels", "run", subset=None)
    c.add_argument("--metrics", nargs="+", default=["NDCG@10", "R@1000", "RR"])
    c = command("index", make_index, "corpus", "out")
    c.add_argument("--analyzer", choices=sorted(ANALYZERS), default="stop")
    c.add_argument("--form", choices=jsonl.FORMS, default="titled")
    c = command("retrieve", retrieve, "index", "queries", "out", top=1000, tag="quillon")
    c.add_argument("--model", choices=sorted(MODELS), default="bm25-lucene")
    c.add_argument("--analyzer", choices=sorted(ANALYZERS), default="stop")
    c.add_argument("--k1", type=float)
    c.add_argument("--b", type=float)
    c.add_argument("--gzip", action="store_true")
    c.add_argument("--whole-scores", action="store_true")
    c = command("embed", embed, "corpus", "out", words=256, stride=128, shards=8)
    c.add_argument("--form", choices=jsonl.FORMS, default="spaced")
    c = command("dense", dense_run, "vectors", "queries", "out", top=1000, tag="quillon-dense")
    c.add_argument("--npy", action="store_true", help="pairs of .npy and .txt files instead of shards written by embed")
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    return a.do(spark or session(a.master, a.partitions), a)
