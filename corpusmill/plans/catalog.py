"""The workflow catalog as small tables: lists, tags, status changes, copies."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.operators.chunking import RULES
from corpusmill.operators.search import PRESETS
from corpusmill.plans.builtin import WORKFLOWS
from corpusmill.plans.workflow import Step, Workflow


class Catalog:
    """Workflows by (id, version), with their steps and tags; frames on demand."""

    def __init__(self, workflows: list[Workflow] | None = None):
        self.items = {(w.id, w.version): w for w in (workflows if workflows is not None else WORKFLOWS.values())}

    def load(self, id: str) -> Workflow:
        """The highest active version."""
        found = [w for (i, _), w in self.items.items() if i == id and w.status == "active"]
        if not found:
            raise KeyError(f"no active workflow {id}")
        return max(found, key=lambda w: w.version)

    def _set(self, id: str, status: str) -> int:
        hit = [k for k in self.items if k[0] == id]
        for k in hit:
            self.items[k] = replace(self.items[k], status=status)
        return len(hit)

    def activate(self, id: str) -> int:
        return self._set(id, "active")

    def deprecate(self, id: str) -> int:
        return self._set(id, "deprecated")

    def delete(self, id: str) -> int:
        hit = [k for k in self.items if k[0] == id]
        for k in hit:
            del self.items[k]
        return len(hit)

    def clone(self, id: str, new_id: str, name: str) -> Workflow:
        """A draft of version 1 with the same steps."""
        self.items[new_id, 1] = w = replace(self.load(id), id=new_id, name=name, version=1, status="draft")
        return w

    def workflows(self, spark: SparkSession) -> DataFrame:
        rows = [(w.id, w.name, w.version, w.description, w.status) for w in self.items.values()]
        return spark.createDataFrame(rows, schemas.TABLES["workflows"].ddl).orderBy("name", F.desc("version"))

    def steps(self, spark: SparkSession) -> DataFrame:
        rows = [(w.id, i, s.name, s.operation, s.source, s.predicate, s.output, json.dumps(s.config), s.expects_delta, s.on_empty) for w in self.items.values() for i, s in enumerate(w.steps, 1)]
        return spark.createDataFrame(rows, schemas.TABLES["workflow_steps"].ddl)

    def tags(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(w.id, t) for w in self.items.values() for t in w.tags], schemas.TABLES["workflow_tags"].ddl)

    def by_tag(self, spark: SparkSession, tag: str) -> DataFrame:
        hit = self.tags(spark).where(F.col("tag") == tag).select(F.col("workflow_id").alias("id"))
        return self.workflows(spark).where("status = 'active'").join(hit, "id", "left_semi")

    def parse_rules(self, spark: SparkSession) -> DataFrame:
        """Kinds of units by how they begin, first match first."""
        rows = [(f"{kind}_{i}", kind, pattern, "text", kind, len(RULES) - i, True) for i, (kind, pattern) in enumerate(RULES)]
        return spark.createDataFrame(rows, schemas.TABLES["parse_rules"].ddl)

    def chunking_strategies(self, spark: SparkSession) -> DataFrame:
        """What the window steps of the workflows declare."""
        rows = [(w.id, w.name, c.get("strategy", "semantic"), c.get("max_tokens", 512), c.get("min_tokens", 50), c.get("overlap_tokens", 0), "|".join(c.get("boundary_markers", [])) or None, w.status == "active") for w in self.items.values() for s in w.steps if s.operation == "window" for c in [s.config]]
        return spark.createDataFrame(rows, schemas.TABLES["chunking_strategies"].ddl)

    def vectorization_configs(self, spark: SparkSession) -> DataFrame:
        """What the vectorize steps of the workflows declare."""
        rows = [(f"{w.id}/{s.name}", s.name, c["layer"], c.get("dimensions", 256), c.get("algorithm"), c.get("weights"), c.get("model_version", "v1"), w.status == "active") for w in self.items.values() for s in w.steps if s.operation == "vectorize" for c in [s.config]]
        return spark.createDataFrame(rows, schemas.TABLES["vectorization_configs"].ddl)

    def presets(self, spark: SparkSession) -> DataFrame:
        rows = [(k, k, p["weights"], p["top_k"], p["min_score"], False) for k, p in PRESETS.items()]
        return spark.createDataFrame(rows, schemas.TABLES["search_configs"].ddl)


def load_file(catalog: Catalog, path: str) -> Workflow:
    """Add the workflow of a JSON file: id, name, version, description, status, tags, and steps as rows of workflow_steps."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    rows = [{"workflow_id": data["id"], "step_order": i, **s, "config": json.dumps(s.get("config") or {})} for i, s in enumerate(data["steps"], 1)]
    w = replace(from_rows(rows, tuple(data.get("tags", ()))), name=data.get("name", data["id"]), version=data.get("version", 1), description=data.get("description", ""), status=data.get("status", "active"))
    wrong = w.check()
    if wrong:
        raise ValueError("; ".join(wrong))
    catalog.items[w.id, w.version] = w
    return w


def metrics(runs: DataFrame, executions: DataFrame) -> DataFrame:
    """Rows of workflow_metrics from run metadata and step logs: success rate, and mean duration and rows of completed runs."""
    last = executions.groupBy("run_id").agg(F.sum("duration_ms").alias("ms"), F.max_by("rows_out", "step_order").alias("rows"))
    done = F.col("status").isin("completed", "merged")
    each = runs.select("run_id", "workflow_id", "workflow_version", done.alias("done")).join(last, "run_id", "left").groupBy("workflow_id", "workflow_version")
    named = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("metric_value"), F.col(c).alias("sample_size")) for n, c in (("success_rate", "n"), ("avg_duration_ms", "n_done"), ("avg_rows_out", "n_done"))])
    out = each.agg(F.count(F.lit(1)).alias("n"), F.count_if("done").alias("n_done"), F.avg(F.col("done").cast("double")).alias("success_rate"), F.avg(F.when(F.col("done"), F.col("ms"))).cast("double").alias("avg_duration_ms"), F.avg(F.when(F.col("done"), F.col("rows"))).cast("double").alias("avg_rows_out"))
    return out.select("workflow_id", "workflow_version", F.explode(named).alias("m")).select("workflow_id", "workflow_version", "m.*").where("metric_value is not null")


def from_rows(rows: list[dict], tags: tuple[str, ...] = ()) -> Workflow:
    """A workflow from rows of workflow_steps."""
    ordered = sorted(rows, key=lambda r: r["step_order"])
    made = tuple(Step(r["step_name"], r["operation"], r["source"], r["output"], r.get("predicate"), json.loads(r.get("config") or "{}"), r.get("on_empty") or "continue", bool(r.get("expects_delta"))) for r in ordered)
    return Workflow(ordered[0]["workflow_id"], ordered[0]["workflow_id"], made, tags=tags)


def template(text: str, names: dict[str, str]) -> str:
    """{{param}} by vetted identifiers or numbers; values of other kinds go in as query parameters instead."""
    import re

    def put(m: re.Match) -> str:
        v = str(names[m[1]])
        if not re.fullmatch(r"[\w.]+", v):
            raise ValueError(f"{m[1]} isn't an identifier or number")
        return v

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, text)
