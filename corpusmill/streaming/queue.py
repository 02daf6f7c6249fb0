"""The merge queue: finished runs are folders under queue/pending; a stream over their metadata files merges them into the
corpus, each once and those of a batch together, and moves them to done or failed."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.corpus import Corpus, exists, folders, hadoop, rename
from corpusmill.hooks import REGISTRY
from corpusmill.operators import vectorize

__all__ = ["Corpus", "collect_garbage", "corpus_status", "drain", "merge_batch", "merge_one", "retry_failed", "start", "status", "submit"]

STATES = ("pending", "done", "failed")
#: Failures that are about a run's content; others, such as lost executors or storage, leave it pending.
OF_CONTENT = (ValueError, AnalysisException)


def _first(rows: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row of each key, the first (or last) in order: a partial minimum, so that a hot key is one row a task."""
    rest = [c for c in rows.columns if c not in key]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order, F.to_json(F.struct(*rest))))
    return rows.groupBy(*key).agg(pick.alias("_r")).select(*key, "_r.*")


def _rows(spark: SparkSession, table: str, runs: list[tuple[str, str]], name: str) -> DataFrame | None:
    """Rows of a result table of all runs that have it, with run_id and the run's place in the batch as _run."""
    have = [(i, path, run) for i, (path, run) in enumerate(runs) if exists(spark, f"{path}/{table}")]
    if not have:
        return None
    read = spark.read.schema(schemas.TABLES[name].ddl).parquet(*[f"{path}/{table}" for _, path, _ in have])
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{table}/[^/]+$", 1)
    place = spark.createDataFrame([(path.rstrip("/").rsplit("/", 1)[1], i, run) for i, path, run in have], "_folder string, _run int, run_id string")
    return read.withColumn("_folder", folder).join(F.broadcast(place), "_folder").drop("_folder")  # a row a run


def merge_batch(spark: SparkSession, corpus: Corpus, paths: list[str]) -> dict[str, str]:
    """Merge finished runs, in the order given, and commit them together: merged, or skipped if a run was merged before.
    ValueError if one isn't completed. Each table is written once, whatever the number of runs.

    Chunks: the first of an id counts and what the corpus has stays; features and vectors: the last counts and replaces;
    relations: as chunks; the full-text index grows by the new chunks; files with chunks become vectorized."""
    meta = spark.read.schema(schemas.TABLES["_run_meta"].ddl).parquet(*[f"{p}/_run_meta" for p in paths]).withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/_run_meta/[^/]+$", 1))
    facts = {r["_folder"]: r for r in meta.collect()}  # a row a run
    merged = {r["run_id"] for r in corpus.read("run_history").where(F.col("run_id").isin([r["run_id"] for r in facts.values()]) & (F.col("status") == "merged")).select("run_id").collect()}
    out, runs = {}, []
    for p in paths:
        r = facts.get(p.rstrip("/").rsplit("/", 1)[1])
        if r is None or r["status"] != "completed":
            raise ValueError(f"{p} isn't completed")
        out[p] = "skipped" if r["run_id"] in merged else "merged"
        if r["run_id"] not in merged:
            merged.add(r["run_id"])
            runs.append((p, r))
    if not runs:
        return out
    ids, changes = [(p, r["run_id"]) for p, r in runs], {}
    counts: dict[str, int] = {}
    found = _rows(spark, "_output", ids, "_output")
    if found is not None:
        chunks = found.withColumnRenamed("run_id", "created_by_run")
        chunks = chunks.withColumn("hash", F.coalesce("hash", F.sha2("content", 256))).withColumn("token_count", F.coalesce("token_count", F.expr("length(content) div 4")))
        chunks = chunks.withColumn("overlap_prev", F.coalesce("overlap_prev", F.lit(0))).withColumn("overlap_next", F.coalesce("overlap_next", F.lit(0)))
        valid = chunks.where(F.size(schemas.row_faults(chunks, "chunks")) == 0)
        names = [f.name for f in schemas.align(valid, "chunks").schema.fields]
        fresh = _first(valid.select(*names, "_run"), ["id"], ["_run", "file_id", "position"]).join(corpus.read("chunks").select("id"), "id", "left_anti")
        part = corpus.stage("chunks", fresh)
        if part["buckets"]:
            changes["chunks"] = [*corpus.parts("chunks"), part]
            new = corpus._load("chunks", [part])
            counts = {r["created_by_run"]: r["n"] for r in new.groupBy("created_by_run").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a run
            index = corpus.stage("chunk_postings", vectorize.terms(new).withColumnRenamed("id", "chunk_id"))
            words = new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(vectorize.tx.tokens(F.col("content")))), F.lit(0)).alias("w")).first()
            changes["chunk_postings"] = [*corpus.parts("chunk_postings"), index | {"docs": int(words["n"]), "words": int(words["w"])}]
        files = corpus.read("raw_files").join(valid.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi").where("status is null or status <> 'vectorized'")
        changes["raw_files"] = corpus.replaced("raw_files", files.withColumn("status", F.lit("vectorized")))
    for table, source in (("chunk_features", "_output_features"), ("chunk_vectors", "_output_vectors")):
        rows = _rows(spark, source, ids, table)
        if rows is not None:
            changes[table] = corpus.replaced(table, _first(rows.drop("run_id"), list(schemas.TABLES[table].key), ["_run"], last=True))
    rows = _rows(spark, "_output_relations", ids, "chunk_relations")
    if rows is not None:
        valid = rows.where(F.size(schemas.row_faults(rows, "chunk_relations")) == 0).drop("run_id")
        key = list(schemas.TABLES["chunk_relations"].key)
        changes["chunk_relations"] = corpus.appended("chunk_relations", _first(valid, key, ["_run"]).join(corpus.read("chunk_relations").select(*key), key, "left_anti"))
    history = [(r["run_id"], r["workflow_id"], r["workflow_version"], r["started_at"], r["finished_at"], "merged", counts.get(r["run_id"], 0)) for _, r in runs]
    changes["run_history"] = corpus.replaced("run_history", spark.createDataFrame(history, schemas.TABLES["run_history"].ddl))
    corpus.commit(changes)  # a job that is repeated before this leaves unnamed parts, after it finds the runs merged
    for p, r in runs:
        REGISTRY.fire("on_merge", run_id=r["run_id"], path=p, chunks=counts.get(r["run_id"], 0))
    return out


def merge_one(spark: SparkSession, corpus: Corpus, run_path: str) -> str:
    return merge_batch(spark, corpus, [run_path])[run_path]


def submit(spark: SparkSession, queue: str, run_path: str) -> None:
    name = run_path.rstrip("/").rsplit("/", 1)[1]
    fs, at = hadoop(spark, f"{queue}/pending")
    fs.mkdirs(at)
    rename(spark, run_path, f"{queue}/pending/{name}")


def drain(spark: SparkSession, queue: str, corpus: Corpus, names: list[str]) -> dict[str, str]:
    """Merge these runs together. If that fails for what a run holds, each by itself, so that a bad run fails alone; if for
    another reason, all stay pending and the error is raised."""
    paths = {f"{queue}/pending/{n}": n for n in names if exists(spark, f"{queue}/pending/{n}/_run_meta")}
    lost = [n for n in names if exists(spark, f"{queue}/pending/{n}") and f"{queue}/pending/{n}" not in paths]
    out = {n: "failed: it has no metadata" for n in lost}
    try:
        out |= {paths[p]: s for p, s in merge_batch(spark, corpus, list(paths)).items()} if paths else {}
    except OF_CONTENT:
        for p, n in paths.items():
            try:
                out[n] = merge_one(spark, corpus, p)
            except OF_CONTENT as e:
                out[n] = f"failed: {e}"
                REGISTRY.fire("on_error", path=p, error=str(e))
    for n, s in out.items():
        to = "failed" if s.startswith("failed") else "done"
        fs, at = hadoop(spark, f"{queue}/{to}")
        fs.mkdirs(at)
        rename(spark, f"{queue}/pending/{n}", f"{queue}/{to}/{n}")
    return out


def start(spark: SparkSession, queue: str, corpus: Corpus, checkpoint: str, batch: int = 100, every: str | None = None):
    """A stream over the metadata of pending runs. every: a processing time such as '1 second'; none: what is there, then stop.

    foreachBatch may repeat a batch after a failure; a merge that repeats is skipped by its run id."""
    fs, at = hadoop(spark, f"{queue}/pending")
    fs.mkdirs(at)
    meta = spark.readStream.schema(schemas.TABLES["_run_meta"].ddl).option("maxFilesPerTrigger", batch).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{queue}/pending/*/_run_meta")

    def each(df: DataFrame, _: int) -> None:
        drain(spark, queue, corpus, [r["run_id"] for r in df.select("run_id", "started_at").orderBy("started_at").collect()])  # at most `batch` runs

    writer = meta.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def retry_failed(spark: SparkSession, queue: str) -> int:
    names = [n for _, n in folders(spark, f"{queue}/failed")]
    for n in names:
        rename(spark, f"{queue}/failed/{n}", f"{queue}/pending/{n}")
    return len(names)


def collect_garbage(spark: SparkSession, queue: str, max_age_days: float = 7.0) -> int:
    """Delete finished runs that are older than an age."""
    old = [n for t, n in folders(spark, f"{queue}/done") if t / 1000 < time.time() - max_age_days * 86400]
    for n in old:
        fs, at = hadoop(spark, f"{queue}/done/{n}")
        fs.delete(at, True)
    return len(old)


def status(spark: SparkSession, queue: str) -> dict[str, int]:
    return {s: len(folders(spark, f"{queue}/{s}")) for s in STATES}


def corpus_status(corpus: Corpus) -> dict[str, int]:
    files = {r["status"]: r["n"] for r in corpus.read("raw_files").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"pending": files.get("pending", 0), "vectorized": files.get("vectorized", 0), "chunks": corpus.read("chunks").count(), "vectors": corpus.read("chunk_vectors").count()}
