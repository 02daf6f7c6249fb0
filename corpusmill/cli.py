"""Command line: ingest, list, run, merge, search, export, status, gc over a data folder.

    python -m corpusmill.cli --data DIR ingest PATH
    python -m corpusmill.cli --data DIR process
    python -m corpusmill.cli --data DIR search "query" --preset code -k 5
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.hooks import REGISTRY
from corpusmill.operators import search as sr
from corpusmill.operators import vectorize
from corpusmill.plans import catalog, workflow
from corpusmill.sources import files as fs
from corpusmill.streaming import queue


def ingest(spark: SparkSession, corpus: queue.Corpus, path: str, recursive: bool = True) -> int:
    known = corpus.read("raw_files")
    new = fs.ingest(spark, path, known, recursive)
    n = new.count()
    if n:
        corpus.append("raw_files", new)
        corpus.append("audit_log", spark.createDataFrame([("cli", "ingest", path, f"{n} files", None)], "actor string, action string, target string, details string, at timestamp").withColumn("at", F.current_timestamp()))
        REGISTRY.fire("on_ingest", path=path, files=n)
    return n


def process(spark: SparkSession, corpus: queue.Corpus, data: str, limit: int = 100) -> dict[str, str]:
    """Route pending files, run each workflow over its files, queue and merge the runs."""
    routed = fs.route(fs.pending(corpus.read("raw_files"), limit)).where("workflow_id is not null")
    kinds, known = [r["workflow_id"] for r in routed.select("workflow_id").distinct().collect()], catalog.Catalog()
    for kind in sorted(kinds):
        files = routed.where(F.col("workflow_id") == kind)
        try:
            wf = known.load(kind)
        except KeyError as e:
            print(e, file=sys.stderr)
            continue
        raw = spark.read.format("binaryFile").load([r["external_path"] for r in files.select("external_path").collect()])
        binary = any(s.config.get("extractor") in ("pdftotext", "docx", "xlsx") for s in wf.steps)
        content = F.col("content") if binary else F.decode("content", "UTF-8")
        texts = raw.select(F.col("path").alias("external_path"), content.alias("content"))
        tables = {"_input": files.drop("workflow_id").join(texts, "external_path"), "corpus.chunks": corpus.read("chunks"), "corpus.relations": corpus.read("chunk_relations")}
        queue.submit(spark, f"{data}/queue", workflow.run(spark, wf, tables, f"{data}/runs"))
    queue.start(spark, f"{data}/queue", corpus, f"{data}/queue/_checkpoint").awaitTermination()
    return queue.status(spark, f"{data}/queue")


def find(spark: SparkSession, corpus: queue.Corpus, query: str, preset: str = "default", k: int | None = None, rerank: bool = False, marked: bool = False) -> DataFrame:
    """Search by the corpus' own index: only the buckets of the query's words and their alternatives are read."""
    chunks, files, vectors = corpus.read("chunks"), corpus.read("raw_files"), corpus.read("chunk_vectors")
    n, mean = corpus.text_stats()
    words = [t for ts in sr.expand(sr.query_terms(query)) for t in ts]
    postings = corpus.read("chunk_postings", words) if words else corpus.read("chunk_postings").limit(0)
    dims = int(corpus.get_config("vector_dimensions"))
    vecs = sr.query_vectors(chunks, query, dims, vectorize.idf(postings.where(F.col("term").isin(words)), n), n)
    boosts = sr.feedback(corpus.read("feedback_log")).select("chunk_id", "boost") if rerank else None
    return sr.search(chunks, vectors, files, query, vecs, preset, k, postings, None, (n, mean), rerank=boosts, marked=marked)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    p.add_argument("--data", required=True, help="folder of the corpus, runs and queue")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("--flat", action="store_true", help="leave sub-folders out")
    sub.add_parser("process").add_argument("--limit", type=int, default=100)
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("--preset", choices=sorted(sr.PRESETS), default="default")
    a.add_argument("-k", type=int)
    a.add_argument("--rerank", action="store_true", help="weigh by feedback")
    a.add_argument("--mark", action="store_true", help="mark the query's words")
    a = sub.add_parser("list")
    a.add_argument("--status")
    a.add_argument("--mime")
    a.add_argument("--limit", type=int, default=20)
    a = sub.add_parser("export")
    a.add_argument("path")
    a.add_argument("--format", choices=("json", "csv"), default="json")
    sub.add_parser("gc").add_argument("--days", type=float, default=7.0)
    for name in ("status", "retry", "workflows", "stats", "vacuum"):
        sub.add_parser(name)
    a = sub.add_parser("config")
    a.add_argument("key", nargs="?")
    a.add_argument("value", nargs="?")
    for name in ("chunk", "file"):
        sub.add_parser(name).add_argument("id")
    sub.add_parser("inspect").add_argument("run")
    args = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or session.local()
    corpus = queue.Corpus(spark, f"{args.data}/corpus")
    if args.command == "ingest":
        print(ingest(spark, corpus, args.path, not args.flat), "new files")
    elif args.command == "process":
        print(process(spark, corpus, args.data, args.limit))
    elif args.command == "search":
        for r in find(spark, corpus, args.query, args.preset, args.k, args.rerank, args.mark).collect():
            print(f"{r['score']:.4f} {r['chunk_id'][:12]} {r['source_path']}\n    {r['snippet'][:120]!r}")
    elif args.command == "list":
        fs.list_files(corpus.read("raw_files"), args.status, args.mime, args.limit).select("id", "source_path", "mime_type", "status").show(args.limit, False)
    elif args.command == "export":
        out = fs.export(corpus.read("chunks"), corpus.read("raw_files"), args.format == "json")
        (fs.write_json if args.format == "json" else fs.write_csv)(out, args.path)
    elif args.command == "gc":
        print(queue.collect_garbage(spark, f"{args.data}/queue", args.days), "runs deleted")
    elif args.command == "retry":
        print(queue.retry_failed(spark, f"{args.data}/queue"), "runs queued again")
    elif args.command == "status":
        print(queue.corpus_status(corpus), queue.status(spark, f"{args.data}/queue"))
    elif args.command == "stats":
        corpus.stats().show(50, False)
    elif args.command == "vacuum":
        for t in corpus.manifest()[1]:
            corpus.compact(t)
        print(corpus.vacuum(), "parts deleted")
    elif args.command == "config":
        if args.value is not None:
            corpus.set_config(args.key, args.value)
        (corpus.config().where(F.col("key") == args.key) if args.key else corpus.config()).show(50, False)
    elif args.command in ("chunk", "file"):
        fs.get_row(corpus.read({"chunk": "chunks", "file": "raw_files"}[args.command], [args.id]), args.id).show(1, False, True)
    elif args.command == "workflows":
        catalog.Catalog().workflows(spark).show(50, False)
    elif args.command == "inspect":
        for t in ("_run_meta", "_step_executions"):
            spark.read.parquet(f"{args.run}/{t}").show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
