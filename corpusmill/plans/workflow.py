"""Workflows as data, checked and compiled to lazy DataFrames. Nothing runs before a sink asks for it."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import features as ft
from corpusmill.corpus import hadoop, rename
from corpusmill.hooks import REGISTRY
from corpusmill.operators import chunking, metrics, search, steps, vectorize
from corpusmill.sources import files as fs


@dataclass(frozen=True)
class Step:
    name: str
    operation: str
    source: str
    output: str
    predicate: str | None = None
    config: dict = field(default_factory=dict)
    on_empty: str = "continue"
    expects_delta: bool = False


@dataclass(frozen=True)
class Workflow:
    id: str
    name: str
    steps: tuple[Step, ...]
    version: int = 1
    status: str = "active"
    description: str = ""
    tags: tuple[str, ...] = ()
    dependencies: tuple[tuple[int, int], ...] = ()

    def check(self) -> list[str]:
        """What is wrong with the definition: operations, sources that nothing yields, outputs that repeat, cycles."""
        wrong, known = [], {"_input", "_query_input", "_query_vectors", "_text_stats"}
        for i, s in enumerate(self.steps, 1):
            if s.operation not in schemas.OPERATIONS:
                wrong.append(f"step {i}: unknown operation {s.operation}")
            if s.on_empty not in schemas.ON_EMPTY:
                wrong.append(f"step {i}: unknown on_empty {s.on_empty}")
            for src in [s.source, *s.config.get("sources", [])]:
                if src not in known and not src.startswith("corpus.") and src not in {x.output for x in self.steps}:
                    wrong.append(f"step {i}: nothing yields {src}")
            if s.output in known:
                wrong.append(f"step {i}: {s.output} is made twice")
            known.add(s.output)
        try:
            self.order()
        except ValueError as e:
            wrong.append(str(e))
        return wrong

    def order(self) -> list[int]:
        """Indices of the steps so that sources and declared dependencies come first."""
        made = {s.output: i for i, s in enumerate(self.steps)}
        named = {i: [s.source, *s.config.get("sources", []), *(v for v in s.config.values() if isinstance(v, str))] for i, s in enumerate(self.steps)}
        needs = {i: {made[x] for x in named[i] if x in made and made[x] != i} for i in named}
        for step, on in self.dependencies:
            needs[step - 1].add(on - 1)
        out: list[int] = []
        while len(out) < len(self.steps):
            ready = [i for i in needs if i not in out and needs[i] <= set(out)]
            if not ready:
                raise ValueError(f"{self.id}: steps depend on each other in a circle")
            out.append(min(ready))
        return out


class Fails(Exception):
    """A step with on_empty fail had no rows."""


def apply_step(step: Step, source: DataFrame, env: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """One step as a lazy frame."""
    c, op = step.config, step.operation
    if op == "filter":
        if "full_text" in c:
            return search.full_text(source, env[c["full_text"]], env[c["query"]], env[c["stats"]], c.get("max_candidates", search.CANDIDATES))
        return steps.filter_rows(source, step.predicate, params, env)
    if op == "project":
        out = steps.project(source, step.predicate, params)
        return search.with_synonyms(out, c.get("max_expansion", 3), (params or {}).get("synonyms")) if c.get("enable_synonyms") else out
    if op == "join":
        if "score" in c:
            return search.scored_layer(source, env[c["table"]], c["layer"], env[c["query_vectors"]])
        if step.predicate:
            return steps.join_clauses(source, step.source, steps.bind(step.predicate, params), env)
        return steps.join(source, env[c["table"]], c["on"], c.get("how", "inner"))
    if op == "aggregate":
        if "features" in c:
            named = ft.features(c["features"]) if isinstance(c["features"], str) else {f["name"]: steps.to_spark_sql(f["expr"]) for f in c["features"]}
            if c["features"] == "docx" and "section_path" not in source.columns:
                source = chunking.section_paths(source)
            clash = [n for n in named if n in source.columns]
            return steps.add_features(source.drop(*clash), named)
        if "hierarchy_column" in c:
            return chunking.section_paths(source)
        return steps.aggregate(source, step.predicate, c.get("group_by"), c.get("functions"))
    if op == "window":
        if c.get("pack"):
            return chunking.declared(source, c)
        return steps.window(source, c.get("min_tokens", 50), c.get("max_tokens", 512))
    if op == "hash":
        if not c:
            return steps.hash_placeholder(source)
        return steps.hash_columns(source, c.get("columns", ["content"]), c.get("algorithm", "sha256"), c.get("output_column", "hash"))
    if op == "vectorize":
        dims, layer, kind = c.get("dimensions", 256), c["layer"], c.get("algorithm")
        if kind is None:
            return vectorize.zero_layer(source, layer, "id", dims, c.get("model_version", "v1"))
        if kind in REGISTRY.vectorizers:
            v = REGISTRY.vectorizers[kind].vectors(source, "id", dims, c, env)
        elif kind == "feature_hash":
            names = c.get("features")
            v = vectorize.hash_features(source, list(ft.features(names)) if isinstance(names, str) else names, "id", dims) if names else vectorize.structure(source, "id", "content", dims)
        elif kind == "tfidf":
            v = vectorize.tfidf(source, "id", "content", dims, min_df=c.get("min_df", 2), max_df=c.get("max_df", 0.8), ngrams=tuple(c.get("ngram_range", (1, 1))))
        elif kind == "graph_embed":
            v = vectorize.graph_embed(env[c["vectors"]], env[c["edges"]], tuple(c.get("relations", ("parent_of", "follows"))), dims)
        elif kind == "blend":
            v = vectorize.blend(steps.merge([env[s] for s in c["sources"]]), c["weights"], dims)
        else:
            raise ValueError(f"unknown vectorizer {kind}")
        return vectorize.as_layer(v, layer, dims, c.get("model_version", "v1"))
    if op == "external":
        return fs.extract(source, c["extractor"], c.get("options"))
    if op == "diff":
        return steps.diff(source, env[c["after"]], c.get("key", "id"))
    if op == "fork":
        return steps.filter_rows(source, step.predicate, params, env)
    if op == "merge":
        return steps.merge([source, *[env[s] for s in c.get("sources", [])]])
    raise ValueError(f"unknown operation {op}")


def packed(wf: Workflow) -> Workflow:
    """The workflow with its window steps as they are declared, by strategy, sizes, overlap and markers, instead of as a filter
    on sizes."""
    return replace(wf, steps=tuple(replace(s, config=s.config | {"pack": True}) if s.operation == "window" else s for s in wf.steps))


def compile_workflow(wf: Workflow, tables: dict[str, DataFrame], params: dict | None = None, watch: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    """Every step's frame by its output name. tables: _input, and corpus tables as corpus.name.

    on_empty costs one isEmpty for steps that declare other than continue. skip_remaining leaves the rest out and makes an
    empty _output; fail raises. watch gets an Observation of rows for each step, filled by the first action over it."""
    wrong = wf.check()
    if wrong:
        raise ValueError("; ".join(wrong))
    env = dict(tables)
    for i in wf.order():
        s = wf.steps[i]
        try:
            df = apply_step(s, env[s.source], env, params)
        except Exception as e:
            raise ValueError(f"{wf.id}, step {i + 1} ({s.name}): {e}") from e
        if watch is not None:
            watch[s.output] = Observation(f"{s.output}-{uuid.uuid4().hex[:8]}")
            df = df.observe(watch[s.output], F.count(F.lit(1)).alias("rows"))
        env[s.output] = df
        if s.on_empty != "continue" and df.isEmpty():
            if s.on_empty == "fail":
                raise Fails(f"{wf.id}, step {i + 1} ({s.name}) has no rows")
            env["_output"] = schemas.align(df.limit(0), "_output")
            break
    return env


@dataclass(frozen=True)
class RunConfig:
    """How a run goes. debug: statistics, samples and deltas of every step that is written; keep_tables: these stay in the
    run's folder; sample_size: rows of the input that are used (none: all); batch_size and timeout_s are kept as metadata."""

    parameters: dict = field(default_factory=dict)
    debug: bool = False
    keep_tables: bool = False
    sample_size: int | None = None
    batch_size: int = 100
    timeout_s: float | None = None


class _Run:
    """One run: its steps one after the other, those that are dear or have several readers written to the staging folder."""

    def __init__(self, spark: SparkSession, wf: Workflow, tables: dict[str, DataFrame], stage: str, run_id: str, config: RunConfig):
        self.spark, self.wf, self.stage, self.run_id, self.config = spark, wf, stage, run_id, config
        self.env, self.log, self.open = dict(tables), {}, []
        self.rows: dict[str, int | None] = {}
        self.watch: dict[str, Observation] = {}
        self.deltas: list[DataFrame] = []
        self.stats: list[DataFrame] = []
        self.samples: list[DataFrame] = []
        self.at = 0
        if config.sample_size is not None:
            self.env["_input"] = self.env["_input"].limit(config.sample_size)

    def readers(self, output: str) -> int:
        return sum((s.source == output) + sum(v == output or (isinstance(v, list) and output in v) for v in s.config.values()) for s in self.wf.steps)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame; what was open until now is done with it."""
        began = time.monotonic()
        df.write.parquet(f"{self.stage}/{name}")
        spent, now = int((time.monotonic() - began) * 1000), _now()
        for i in self.open:
            self.log[i] |= {"finished_at": now, "duration_ms": spent}
        self.open = []
        return self.spark.read.schema(df.schema).parquet(f"{self.stage}/{name}")

    def step(self, i: int) -> bool:
        """Whether to go on."""
        s, self.at = self.wf.steps[i], i + 1
        df = apply_step(s, self.env[s.source], self.env, self.config.parameters)
        self.watch[s.output] = Observation(f"{s.output}-{uuid.uuid4().hex[:8]}")
        df = df.observe(self.watch[s.output], F.count(F.lit(1)).alias("rows"))
        self.log[i] = {"started_at": _now(), "finished_at": None, "duration_ms": None}
        self.open.append(i)
        dear = s.operation in ("external", "window", "vectorize") or (s.operation == "aggregate" and "features" in s.config)
        if dear or self.readers(s.output) > 1 or s.on_empty != "continue" or s.expects_delta or self.config.debug or self.config.keep_tables:
            df = self.write(df, f"steps/{s.output}")
            self.describe(i, df)
        self.env[s.output] = df
        if s.on_empty != "continue" and df.isEmpty():
            if s.on_empty == "fail":
                raise Fails(f"{self.wf.id}, step {i + 1} ({s.name}) has no rows")
            self.env["_output"] = schemas.align(df.limit(0), "_output")
            return False
        return True

    def describe(self, i: int, df: DataFrame) -> None:
        s, before = self.wf.steps[i], self.env[self.wf.steps[i].source]
        mark = [F.lit(self.run_id).alias("run_id"), F.lit(i + 1).cast("bigint").alias("step_order")]
        if (s.expects_delta or self.config.debug) and "id" in df.columns and "id" in before.columns:
            self.deltas.append(steps.diff(before, df, "id").join(steps.diff_samples(before, df, "id")).select(mark[0], F.lit(i).cast("bigint").alias("step_from"), F.lit(i + 1).cast("bigint").alias("step_to"), "*"))
        if self.config.debug:
            each = metrics.stats(df, approximate=True)
            pick = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("column_name", c)))).alias(f"{c}_counts")  # noqa: E731  a row a column
            self.stats.append(each.agg(F.max("row_count").alias("row_count"), pick("nulls"), pick("distinct")).select(*mark, "row_count", F.col("nulls_counts").alias("null_counts"), F.col("distinct_counts")))
            if {"id", "content", "position"} <= set(df.columns):
                self.samples.append(metrics.samples(df).select(*mark, "sample_type", F.col("row_id").cast("string").alias("row_id"), "content"))

    def finish(self) -> None:
        out = self.env["_output"]
        if "hash" not in out.columns and "content_hash" in out.columns:
            out = out.withColumnRenamed("content_hash", "hash")
        if "token_count" not in out.columns and "content" in out.columns:
            out = out.withColumn("token_count", F.expr("cast(length(content) div 4 as bigint)"))
        if "chunk_type" not in out.columns:
            out = out.withColumn("chunk_type", F.lit("semantic"))
        self.write(schemas.align(out, "_output"), "_output")
        vectors = [self.env[s.output] for s in self.wf.steps if s.operation == "vectorize" and s.output in self.env]
        if vectors:
            self.write(steps.merge(vectors), "_output_vectors")
        for s in self.wf.steps:
            if s.operation == "aggregate" and "features" in s.config and s.output in self.env:
                self.write(long_features(self.env[s.output], s), "_output_features")
                break
        if "_output_relations" in self.env:
            self.write(schemas.align(self.env["_output_relations"], "chunk_relations"), "_output_relations")

    def records(self, error: str | None) -> None:
        log = []
        for i, s in enumerate(self.wf.steps):
            if i in self.log:
                rows_out, rows_in = _rows(self.watch, s.output), _rows(self.watch, s.source)
                if rows_in is None and rows_out is not None and s.source in self.env and s.source not in self.watch:
                    rows_in = self.rows.setdefault(s.source, self.env[s.source].count())
                score = 1 - rows_out / rows_in if rows_in and rows_out is not None else None
                done = self.log[i]
                log.append((self.run_id, i + 1, s.name, rows_in, rows_out, done["duration_ms"], score, s.output, done["started_at"], done["finished_at"]))
        frames = {"_step_executions": self.spark.createDataFrame(log, schemas.TABLES["_step_executions"].ddl)}
        for name, found in (("_deltas", self.deltas), ("_step_stats", self.stats), ("_step_samples", self.samples)):
            if found and error is None:
                frames[name] = schemas.align(steps.merge(found), name)
        if error is not None:
            frames["_errors"] = self.spark.createDataFrame([(self.run_id, self.at, *error.split(": ", 1), None)], schemas.TABLES["_errors"].ddl)
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"{self.stage}/{name}")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def run(spark: SparkSession, wf: Workflow, tables: dict[str, DataFrame], path: str, params: dict | None = None, run_id: str | None = None, worker: str = "local", config: RunConfig | None = None) -> str:
    """Run a workflow into path/run_id: one Parquet folder a result table, the step log, what config asks for, and metadata.
    Returns the folder.

    Everything goes to a staging name, renamed at the end, so a reader never sees half a run; metadata there say running until
    then. A step that fails ends the run as failed, with the error in _errors; a faulty definition raises ValueError. Steps
    that aren't written share the end and the duration of the write that computes them."""
    wrong = wf.check()
    if wrong:
        raise ValueError("; ".join(wrong))
    config = config or RunConfig(parameters=params or {})
    run_id = run_id or uuid.uuid4().hex
    began, error = _now(), None
    stage, final = f"{path}/_staging-{run_id}", f"{path}/{run_id}"

    def meta(status: str) -> None:
        row = (run_id, wf.id, wf.version, began, None if status == "running" else _now(), status, "_input", worker, json.dumps(asdict(config)), error)
        spark.createDataFrame([row], schemas.TABLES["_run_meta"].ddl).coalesce(1).write.mode("overwrite").parquet(f"{stage}/_run_meta")

    meta("running")
    REGISTRY.fire("on_run_start", run_id=run_id, workflow_id=wf.id)
    work = _Run(spark, wf, tables, stage, run_id, config)
    try:
        for i in wf.order():
            if not work.step(i):
                break
        work.finish()
    except Exception as e:  # noqa: BLE001  whatever ends a run is recorded
        error = f"{type(e).__name__}: {e}"
        REGISTRY.fire("on_error", run_id=run_id, workflow_id=wf.id, error=error)
    work.records(error)
    if not config.keep_tables:
        fs, at = hadoop(spark, f"{stage}/steps")
        fs.delete(at, True)
    meta("failed" if error else "completed")
    rename(spark, stage, final)
    REGISTRY.fire("on_run_complete", run_id=run_id, workflow_id=wf.id, status="failed" if error else "completed", path=final)
    return final


def long_features(df: DataFrame, step: Step) -> DataFrame:
    """(chunk_id, feature_name, feature_value): wide feature columns unpivoted in one pass."""
    named = list(ft.features(step.config["features"])) if isinstance(step.config["features"], str) else [f["name"] for f in step.config["features"]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).cast("double").alias("feature_value")) for n in named if n in df.columns]))
    return df.select(F.col("id").alias("chunk_id"), each.alias("f")).select("chunk_id", "f.*")


def _rows(watch: dict[str, Observation], name: str) -> int | None:
    """What an observation counted; none if no action ran over it."""
    o = watch.get(name)
    if o is None or o._jo is None:
        return None
    row = o._jo.getRowOrEmpty()
    return int(row.get().getLong(0)) if row.isDefined() else None
