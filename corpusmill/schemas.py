"""Tables of the engine: schemas, enumerations, keys, and the checks that Parquet doesn't enforce."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "extracted", "chunked", "vectorized", "failed")
SEGMENT_TYPES = ("text", "table", "image_ocr", "metadata", "code", "heading")
UNIT_TYPES = ("paragraph", "heading", "list_item", "cell", "code_block", "sentence")
CHUNK_TYPES = ("semantic", "fixed_window", "sentence", "paragraph")
LAYERS = ("structure", "lexical", "contextual", "blend")
RELATIONS = ("references", "follows", "parent_of", "similar_to", "calls", "imports")
RUN_STATUSES = ("pending", "running", "completed", "failed", "merged")
FEEDBACK = ("click", "ignore", "upvote", "downvote")
OPERATIONS = ("filter", "join", "project", "aggregate", "window", "diff", "hash", "vectorize", "external", "fork", "merge")
ON_EMPTY = ("continue", "skip_remaining", "fail")
WORKFLOW_STATUSES = ("draft", "active", "deprecated")

#: The corpus settings that a new corpus starts with.
CONFIG = {
    "version": "2.0.0",
    "max_chunk_tokens": "512",
    "default_overlap": "50",
    "gc_retention_days": "7",
    "merger_batch_size": "100",
    "vector_dimensions": "256",
    "blend_weights_structure": "0.45",
    "blend_weights_lexical": "0.30",
    "blend_weights_contextual": "0.25",
}


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    between: dict[str, tuple[float, float]] = field(default_factory=dict)
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)


_CHUNK = "id string, file_id string, content string, token_count bigint, chunk_type string, overlap_prev bigint, overlap_next bigint, hash string, position bigint, parent_id string, unit_ids array<string>"
_RUN = "run_id string, workflow_id string, workflow_version bigint, started_at timestamp, finished_at timestamp, status string"

TABLES: dict[str, Table] = {
    "raw_files": Table("id string, source_path string, mime_type string, size bigint, external_path string, checksum string, status string, created_at timestamp", ("id",), ("source_path", "mime_type", "checksum"), {"status": STATUSES}),
    "extracted_segments": Table("id string, file_id string, segment_type string, content string, page int, position bigint, bbox struct<x:double,y:double,width:double,height:double>, confidence double, metadata map<string,string>", ("id",), ("file_id",), {"segment_type": SEGMENT_TYPES}, {"confidence": (0, 1)}, {"file_id": ("raw_files", "id")}),
    "parsed_units": Table("id string, segment_id string, unit_type string, content string, level int, position bigint, parent_id string", ("id",), ("segment_id",), {"unit_type": UNIT_TYPES}, {}, {"segment_id": ("extracted_segments", "id"), "parent_id": ("parsed_units", "id")}),
    "chunks": Table(_CHUNK + ", created_by_run string", ("id",), ("file_id", "content", "token_count", "hash"), {"chunk_type": CHUNK_TYPES}, {}, {"file_id": ("raw_files", "id"), "parent_id": ("chunks", "id")}),
    "chunk_features": Table("chunk_id string, feature_name string, feature_value double, feature_meta map<string,string>", ("chunk_id", "feature_name"), (), {}, {}, {"chunk_id": ("chunks", "id")}),
    "chunk_vectors": Table("chunk_id string, layer string, vector array<float>, dimensions bigint, model_version string", ("chunk_id", "layer"), ("vector",), {"layer": LAYERS}, {}, {"chunk_id": ("chunks", "id")}),
    "chunk_relations": Table("from_chunk_id string, to_chunk_id string, relation_type string, weight double", ("from_chunk_id", "to_chunk_id", "relation_type"), (), {"relation_type": RELATIONS}, {"weight": (0, 1)}, {"from_chunk_id": ("chunks", "id"), "to_chunk_id": ("chunks", "id")}),
    "run_history": Table(_RUN + ", rows_produced bigint", ("run_id",), ("workflow_id",), {"status": RUN_STATUSES}),
    "chunk_postings": Table("term string, chunk_id string, tf bigint, total bigint", ("term", "chunk_id"), (), {}, {}, {"chunk_id": ("chunks", "id")}),
    "feedback_log": Table("query string, chunk_id string, action string, at timestamp", (), ("chunk_id",), {"action": FEEDBACK}, {}, {"chunk_id": ("chunks", "id")}),
    "audit_log": Table("actor string, action string, target string, details string, at timestamp", ()),
    "extractor_versions": Table("extractor string, version string, active boolean", ("extractor", "version")),
    "corpus_index": Table("name string, kind string, built_at timestamp, rows bigint", ("name",)),
    "config": Table("key string, value string", ("key",)),
    "_run_meta": Table(_RUN + ", input_source string, worker_id string, config string, error string", ("run_id",), ("workflow_id",), {"status": RUN_STATUSES}),
    "_step_executions": Table("run_id string, step_order bigint, step_name string, rows_in bigint, rows_out bigint, duration_ms bigint, delta_score double, output_table string, started_at timestamp, finished_at timestamp", ("run_id", "step_order")),
    "_deltas": Table("run_id string, step_from bigint, step_to bigint, rows_before bigint, rows_after bigint, rows_lost bigint, rows_gained bigint, delta_type string, delta_score double, jaccard_index double, sample_lost string, sample_gained string", ("run_id", "step_from", "step_to"), (), {"delta_type": ("reduction", "expansion", "transformation")}),
    "_output": Table(_CHUNK + ", source_chain array<string>, confidence double", ("id",), ("content",), {"chunk_type": CHUNK_TYPES}),
    "_errors": Table("run_id string, step_order bigint, error_type string, error_message string, row_id string", ()),
    "_step_samples": Table("run_id string, step_order bigint, sample_type string, row_id string, content string", (), (), {"sample_type": ("first", "last", "random", "outlier")}),
    "_step_stats": Table("run_id string, step_order bigint, row_count bigint, null_counts map<string,bigint>, distinct_counts map<string,bigint>", ("run_id", "step_order")),
    "workflows": Table("id string, name string, version bigint, description string, status string", ("id", "version"), ("name",), {"status": WORKFLOW_STATUSES}),
    "workflow_steps": Table("workflow_id string, step_order bigint, step_name string, operation string, source string, predicate string, output string, config string, expects_delta boolean, on_empty string", ("workflow_id", "step_order"), ("output",), {"operation": OPERATIONS, "on_empty": ON_EMPTY}),
    "workflow_step_dependencies": Table("workflow_id string, step_order bigint, depends_on bigint, kind string", ("workflow_id", "step_order", "depends_on"), (), {"kind": ("data", "delta", "config")}),
    "workflow_tags": Table("workflow_id string, tag string", ("workflow_id", "tag")),
    "search_configs": Table("id string, name string, layer_weights map<string,double>, top_k bigint, min_score double, rerank_enabled boolean", ("id",)),
    "parse_rules": Table("id string, name string, pattern string, target_type string, output_type string, priority bigint, active boolean", ("id",), ("pattern",)),
    "chunking_strategies": Table("id string, name string, chunk_type string, max_tokens bigint, min_tokens bigint, overlap_tokens bigint, boundary_pattern string, active boolean", ("id",), (), {"chunk_type": CHUNK_TYPES}),
    "vectorization_configs": Table("id string, name string, layer string, dimensions bigint, algorithm string, weights map<string,double>, model_version string, active boolean", ("id",), (), {"layer": LAYERS, "algorithm": ("feature_hash", "tfidf", "graph_embed", "blend")}),
    "operation_templates": Table("id string, name string, operation string, predicate_template string, default_config string", ("id",), (), {"operation": OPERATIONS}),
    "workflow_metrics": Table("workflow_id string, workflow_version bigint, metric_name string, metric_value double, sample_size bigint", ("workflow_id", "workflow_version", "metric_name")),
    "hooks_config": Table("id string, event string, handler_type string, handler string, priority bigint, active boolean", ("id",), (), {"event": ("on_ingest", "on_run_start", "on_run_complete", "on_merge", "on_search", "on_error"), "handler_type": ("webhook", "script", "internal")}),
    "tasks": Table("id string, zone string, kind string, payload string, status string, worker string, created_at timestamp, updated_at timestamp, result string", ("id",), (), {"status": ("pending", "claimed", "done", "failed")}),
    "heartbeats": Table("worker string, zone string, at timestamp, status string", ("worker",)),
    "logs": Table("worker string, level string, message string, context string, at timestamp", ()),
    "manifests": Table("process string, path string, kind string, sha256 string, at bigint", ("process", "path")),
}


def align(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in their order and types; missing ones are null."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(TABLES[name].ddl)
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def row_faults(df: DataFrame, name: str) -> Column:
    """Array of the faults of a row: missing keys and required columns, values outside an enumeration or a range."""
    t = TABLES[name]
    tests = [(F.col(c).isNull(), f"{c} is null") for c in dict.fromkeys(t.key + t.required) if c in df.columns]
    tests += [(~F.col(c).isin(*vs), f"{c} isn't legal") for c, vs in t.enums.items() if c in df.columns]
    tests += [(~F.col(c).between(lo, hi), f"{c} isn't in [{lo}, {hi}]") for c, (lo, hi) in t.between.items() if c in df.columns]
    if not tests:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in tests]), lambda x: x.isNotNull())


def validate(df: DataFrame, name: str, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows with faults: those of the row, and keys of others that they refer to without finding them."""
    t = TABLES[name]
    out = df.withColumn("faults", row_faults(df, name))
    for c, (table, key) in t.refers.items():
        if others and table in others and c in df.columns:
            there = others[table].select(F.col(key).alias(f"_{c}")).distinct()
            out = out.join(there, out[c] == there[f"_{c}"], "left")
            out = out.withColumn("faults", F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), F.concat("faults", F.array(F.lit(f"{c} has no {table}")))).otherwise(F.col("faults"))).drop(f"_{c}")
    return out.where(F.size("faults") > 0)
