"""Queries over what the engine writes and keeps: runs, the corpus, the queue, the catalog, files and their readers."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import bus, hooks, manifest, schemas
from corpusmill.corpus import Corpus, folders, scratch
from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vc
from corpusmill.operators import chunking, metrics, relations, search, steps, vectorize
from corpusmill.plans import builtin, catalog, workflow
from corpusmill.plans.workflow import RunConfig, Step, Workflow
from corpusmill.queries_base import CONTENTS, contents, query, read
from corpusmill.sources import files as fs
from corpusmill.sources import parsers
from corpusmill.streaming import queue

# --------------------------------------------------------------------------- steps and runs

_LINES = "(SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, unnest(p) AS u FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents))"


@query("window_declared", f"""WITH RECURSIVE u AS MATERIALIZED (SELECT file_id, i, u, length(u) // 4 AS n, starts_with(u, 'Th') AS m FROM {_LINES}),
g AS (SELECT file_id, i, n AS t, 0 AS c FROM u WHERE i = 1 UNION ALL SELECT u.file_id, u.i, CASE WHEN u.m OR g.t + u.n > 120 THEN u.n ELSE g.t + u.n END, g.c + CASE WHEN u.m OR g.t + u.n > 120 THEN 1 ELSE 0 END FROM g JOIN u ON u.file_id = g.file_id AND u.i = g.i + 1)
SELECT file_id, c::BIGINT AS position, substr(sha256(content), 1, 32) AS id, length(content) // 4 AS token_count FROM (SELECT g.file_id, c, string_agg(u.u, chr(10) || chr(10) ORDER BY g.i) AS content FROM g JOIN u USING (file_id, i) GROUP BY ALL) WHERE length(content) // 4 >= 10""")
def _(spark, d):
    x = contents(spark, d).select(F.col("id").alias("file_id"), F.posexplode(F.filter(F.split("content", "\n", -1), lambda u: u != "")).alias("position", "content"))
    out = chunking.declared(x, {"strategy": "semantic", "max_tokens": 120, "min_tokens": 10, "boundary_markers": ["^Th"]})
    return out.select("file_id", "position", "id", "token_count")


@query("hash_placeholder", "SELECT doc_id, repeat('0', 64) AS hash FROM documents")
def _(spark, d):
    return steps.hash_placeholder(read(spark, d, "documents").select("doc_id"))


@query("vectorize_zero", "SELECT doc_id AS chunk_id, 'structure' AS layer, 256::BIGINT AS dimensions, 'v1' AS model_version, 256::BIGINT AS n, 0.0::DOUBLE AS total FROM documents")
def _(spark, d):
    v = workflow.apply_step(Step("v", "vectorize", "_input", "o", None, {"layer": "structure"}), contents(spark, d), {})
    return v.select("chunk_id", "layer", "dimensions", "model_version", F.size("vector").cast("bigint").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("step_order", "SELECT branch, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS branch FROM documents) GROUP BY branch")
def _(spark, d):
    w = Workflow("w", "w", (
        Step("count", "aggregate", "s_all", "_output", None, {"group_by": ["branch"], "functions": {"n": "count(*)", "chars": "sum(n_chars)"}}),
        Step("join", "merge", "s_short", "s_all", None, {"sources": ["s_long"]}),
        Step("long", "project", "s_b", "s_long", "n_chars, 'long' as branch"), Step("short", "project", "s_a", "s_short", "n_chars, 'short' as branch"),
        Step("b", "fork", "_input", "s_b", "n_chars >= 1000"), Step("a", "fork", "_input", "s_a", "n_chars < 1000"),
    ), dependencies=((5, 6),))
    return workflow.compile_workflow(w, {"_input": read(spark, d, "documents")})["_output"]


def _docs(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file_id"), F.col("text").alias("content"), F.col("doc_id").alias("position"), "lang")


_STEPS = (
    Step("select_lang", "filter", "_input", "s_lang", "lang = :lang"),
    Step("count_words", "aggregate", "s_lang", "s_words", None, {"features": [{"name": "n_words", "expr": "length(content) - length(replace(content, ' ', '')) + 1"}]}),
    Step("keep_long", "filter", "s_words", "s_long", "n_words > :least", {}, "continue", True),
    Step("finalize", "project", "s_long", "_output", "*"),
)
_N = "(SELECT count(*) FROM documents WHERE {0})"
_EN = "lang = 'en'"
_KEPT = "lang = 'en' AND length(text) - length(replace(text, ' ', '')) + 1 > 100"


def _run(spark, d, name: str, steps_: tuple = _STEPS, **how) -> str:
    config = RunConfig(**({"parameters": {"lang": "en", "least": 100}} | how))
    return workflow.run(spark, Workflow(name, name, steps_), {"_input": _docs(spark, d)}, scratch(spark, "runs"), run_id=name, config=config)


@query("run_steps", f"""SELECT * FROM (SELECT 1::BIGINT AS step_order, 'select_lang' AS step_name, (SELECT count(*) FROM documents) AS rows_in, {_N.format(_EN)} AS rows_out UNION ALL SELECT 2, 'count_words', {_N.format(_EN)}, {_N.format(_EN)}
UNION ALL SELECT 3, 'keep_long', {_N.format(_EN)}, {_N.format(_KEPT)} UNION ALL SELECT 4, 'finalize', {_N.format(_KEPT)}, {_N.format(_KEPT)}), (SELECT true AS ended, true AS timed)""")
def _(spark, d):
    log = spark.read.parquet(_run(spark, d, "steps") + "/_step_executions")
    return log.select("step_order", "step_name", "rows_in", "rows_out", F.col("finished_at").isNotNull().alias("ended"), (F.col("duration_ms") >= 0).alias("timed"))


@query("run_summary_of_run", f"SELECT 'summary' AS run_id, 'completed' AS status, 4::BIGINT AS total_steps, 4::BIGINT AS completed_steps, {_N.format(_KEPT)} AS final_rows")
def _(spark, d):
    at = _run(spark, d, "summary")
    return metrics.run_summary(spark.read.parquet(at + "/_run_meta"), spark.read.parquet(at + "/_step_executions")).select("run_id", "status", "total_steps", "completed_steps", "final_rows")


@query("run_deltas", f"SELECT 2::BIGINT AS step_from, 3::BIGINT AS step_to, {_N.format(_EN)} AS rows_before, {_N.format(_KEPT)} AS rows_after, {_N.format(_EN)} - {_N.format(_KEPT)} AS rows_lost, 0::BIGINT AS rows_gained, 'reduction' AS delta_type, round(1 - {_N.format(_KEPT)} / {_N.format(_EN)}, 6) AS delta_score, round({_N.format(_KEPT)} / {_N.format(_EN)}, 6) AS jaccard_index, (SELECT '[' || string_agg('\"' || id || '\"', ',' ORDER BY id) || ']' FROM (SELECT doc_id::VARCHAR AS id FROM documents WHERE {_EN} AND NOT ({_KEPT}) ORDER BY 1 LIMIT 5)) AS sample_lost, '[]' AS sample_gained")
def _(spark, d):
    return spark.read.parquet(_run(spark, d, "deltas") + "/_deltas").drop("run_id").withColumn("delta_score", F.round("delta_score", 6)).withColumn("jaccard_index", F.round("jaccard_index", 6))


@query("run_statistics", f"SELECT i::BIGINT AS step_order, n AS row_count, 0::BIGINT AS null_ids FROM (VALUES (1, {_N.format(_EN)}), (2, {_N.format(_EN)}), (3, {_N.format(_KEPT)}), (4, {_N.format(_KEPT)})) v(i, n)")
def _(spark, d):
    return spark.read.parquet(_run(spark, d, "stats", debug=True) + "/_step_stats").select("step_order", "row_count", F.col("null_counts")["id"].alias("null_ids"))


@query("run_samples", f"SELECT 3::BIGINT AS step_order, t AS sample_type, id AS row_id FROM (SELECT 'first' AS t, min(doc_id)::VARCHAR AS id FROM documents WHERE {_KEPT} UNION ALL SELECT 'last', max(doc_id)::VARCHAR FROM documents WHERE {_KEPT})")
def _(spark, d):
    return spark.read.parquet(_run(spark, d, "samples", debug=True) + "/_step_samples").where("step_order = 3 and sample_type in ('first', 'last')").select("step_order", "sample_type", "row_id")


_NONE = (Step("none", "filter", "_input", "s_none", "lang = 'xx'", {}, "fail"), Step("end", "project", "s_none", "_output", "*"))
_SKIP = (Step("none", "filter", "_input", "s_none", "lang = 'xx'", {}, "skip_remaining"), Step("end", "project", "nowhere_s", "_output", "*"))


@query("run_outcomes", """SELECT * FROM (VALUES ('completed', 'completed', NULL, NULL, (SELECT count(*) FROM documents WHERE lang = 'en' AND length(text) - length(replace(text, ' ', '')) + 1 > 100)),
('failing', 'failed', 1::BIGINT, 'Fails', NULL), ('broken', 'failed', 2::BIGINT, 'AnalysisException', NULL), ('skipping', 'completed', NULL, NULL, 0::BIGINT)) v(run_id, status, step_order, error_type, rows_out)""")
def _(spark, d):
    skip = (*_SKIP[:1], Step("end", "project", "s_none", "_output", "*"))
    broken = (_STEPS[0], Step("end", "project", "s_lang", "_output", "no_such_column"))
    out = []
    for name, s in (("completed", _STEPS), ("failing", _NONE), ("broken", broken), ("skipping", skip)):
        at = _run(spark, d, name, s)
        meta = spark.read.parquet(at + "/_run_meta").select("run_id", "status").first()
        failed = meta["status"] == "failed"
        error = spark.read.parquet(at + "/_errors").first() if failed else None
        rows = None if failed else spark.read.parquet(at + "/_output").count()
        out.append((meta["run_id"], meta["status"], error and error["step_order"], error and error["error_type"], rows))
    return spark.createDataFrame(out, "run_id string, status string, step_order bigint, error_type string, rows_out bigint")


@query("run_config", "SELECT 'configured' AS run_id, 'en' AS lang, 5::BIGINT AS sample_size, 20::BIGINT AS batch_size, true AS debug, 5::BIGINT AS rows_in")
def _(spark, d):
    at = _run(spark, d, "configured", sample_size=5, batch_size=20, debug=True)
    c = F.from_json("config", "parameters map<string,string>, sample_size bigint, batch_size bigint, debug boolean")
    meta = spark.read.parquet(at + "/_run_meta").select("run_id", c.alias("c")).select("run_id", F.col("c.parameters")["lang"].alias("lang"), "c.sample_size", "c.batch_size", "c.debug")
    return meta.join(spark.read.parquet(at + "/_step_executions").where("step_order = 1").select("run_id", "rows_in"), "run_id")


# --------------------------------------------------------------------------- text of steps


@query("project_json", "SELECT doc_id, json_object('lang', lang, 'n', n_chars, 'what', 'a(b', 'none', CASE WHEN lang = 'en' THEN source END) AS j FROM documents")
def _(spark, d):
    return steps.project(read(spark, d, "documents"), "doc_id, json_object('lang', lang, 'n', n_chars, 'what', 'a(b', 'none', case when lang = 'en' then source end) as j")


@query("filter_named", "SELECT doc_id FROM documents WHERE lang = 'en' AND source <> 'it''s \\' AND n_chars > 100")
def _(spark, d):
    return steps.filter_rows(read(spark, d, "documents"), "lang = :lang AND source <> :source AND n_chars > :n", {"lang": "en", "source": "it's \\", "n": 100}).select("doc_id")


@query("filter_positional", "SELECT doc_id FROM documents WHERE lang = 'de' AND n_chars BETWEEN 10 AND 5000 ORDER BY n_chars DESC, doc_id LIMIT 7")
def _(spark, d):
    return steps.filter_rows(read(spark, d, "documents"), "lang = ? AND n_chars BETWEEN ? AND ? ORDER BY n_chars DESC, doc_id LIMIT 7", ["de", 10, 5000]).select("doc_id")


@query("join_clauses", "SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality, x.doc_id AS l_doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0 LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 0) x ON x.doc_id = d.doc_id JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'en') s ON s.source = d.source")
def _(spark, d):
    x = read(spark, d, "documents")
    tables = {"corpus.labels": read(spark, d, "labels"), "corpus.sources": x.where("lang = 'en'").select("source").distinct()}
    out = steps.join_clauses(x, "s_docs", "LEFT JOIN corpus.labels l ON s_docs.doc_id = l.doc_id AND l.toxic = 0 JOIN corpus.sources AS s ON s.source = s_docs.source", tables)
    return out.select("doc_id", "lang", F.col("quality").cast("bigint").alias("quality"), "l_doc_id")


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_STEM = "CASE WHEN length(w) > 5 THEN regexp_replace(w, '(ing|edly|ed|ies|es|s|ly)$', '') WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END"


@query("expand_query", f"""SELECT item_id, array_to_string(t, ' ') AS tokens, array_to_string(list_transform(t, lambda w: CASE WHEN {_STEM} = w THEN w ELSE w || '|' || {_STEM} END), ' ') AS expanded FROM (
SELECT item_id, CASE WHEN len(k) > 0 THEN k ELSE a END AS t FROM (SELECT item_id, a, list_filter(a, lambda w: NOT list_contains({_STOP}, w)) AS k FROM (
SELECT item_id, list_transform(list_filter(list_transform(range(1, len(a) + 1), lambda i: {{'w': a[i], 'first': list_position(a, a[i]) = i}}), lambda x: x.first), lambda x: x.w) AS a FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS a FROM benchmark))))""")
def _(spark, d):
    q = read(spark, d, "benchmark").select("item_id", F.col("text").alias("query_text"))
    t = steps.project(q, "item_id, tokenize(query_text) as tokens")
    e = steps.project(t, "item_id, tokens, expand_tokens(tokens) as expanded")
    return e.select("item_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform("expanded", lambda x: F.array_join(x, "|")), " ").alias("expanded"))


@query("list_files", "SELECT doc_id AS id, lang AS status FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents WHERE lang = 'en') ORDER BY doc_id LIMIT 10")
def _(spark, d):
    x = read(spark, d, "documents")
    first = x.where("lang = 'en'").agg(F.min("source")).first()[0]
    files = x.select(F.col("doc_id").alias("id"), F.col("lang").alias("status"), F.col("source").alias("mime_type"), F.lit("2024-01-01").alias("created_at"))
    return fs.list_files(files, "en", first, 10).select("id", "status")


@query("route_override", "SELECT m AS mime_type, w AS workflow_id FROM (VALUES ('text/plain', 'mine_v1'), ('text/x-rust', 'rust_v1'), ('text/html', NULL), ('text/x-sql', 'sql_chunking_v1')) v(m, w)")
def _(spark, d):
    x = spark.createDataFrame([(m,) for m in ("text/plain", "text/x-rust", "text/html", "text/x-sql")], "mime_type string")
    return fs.route(x, {"text/plain": "mine_v1", "text/x-rust": "rust_v1", "text/html": None})


# --------------------------------------------------------------------------- files and their readers


def _files(spark, d) -> str:
    """The nations' names as files of one line."""
    at = scratch(spark, "files")
    names = read(spark, d, "nation").select(F.concat_ws("\n", F.lit("nation"), "n_name").alias("value"), F.col("n_nationkey").alias("k"))
    names.repartition(25, "k").write.partitionBy("k").text(f"{at}/texts")
    return f"{at}/texts"


@query("ingest_files", "SELECT sha256('nation' || chr(10) || n_name || chr(10)) AS id, length(n_name) + 8 AS size, 'text/plain' AS mime_type, 'pending' AS status FROM nation")
def _(spark, d):
    return fs.ingest(spark, _files(spark, d)).select("id", "size", "mime_type", "status")


@query("ingest_again", "SELECT 0::BIGINT AS n")
def _(spark, d):
    at = _files(spark, d)
    return fs.ingest(spark, at, fs.ingest(spark, at)).agg(F.count(F.lit(1)).alias("n"))


@query("copy_files", "SELECT sha256('nation' || chr(10) || n_name || chr(10)) AS id, true AS stored FROM nation")
def _(spark, d):
    found, store = fs.ingest(spark, _files(spark, d)), scratch(spark, "store")
    kept = fs.copy_files(found, store)
    kept.write.format("noop").mode("overwrite").save()
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store).select(F.sha2("content", 256).alias("id"), "path")
    return kept.join(back, "id").select("id", (F.regexp_extract("path", "([0-9a-f]{2}/[0-9a-f]{64})$", 1) == F.concat(F.substring("id", 1, 2), F.lit("/"), F.col("id"))).alias("stored"))


@query("export_files", "SELECT doc_id::VARCHAR AS id, source AS file_id, length(text) // 4 AS token_count, 'semantic' AS chunk_type, 'files/' || source AS source_path, sha256(text) AS hash FROM documents")
def _(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file_id"), F.col("text").alias("content"), F.expr("cast(length(text) div 4 as bigint)").alias("token_count"), F.lit("semantic").alias("chunk_type"), F.col("doc_id").alias("position"))
    files, at = x.select(F.col("file_id").alias("id"), F.concat(F.lit("files/"), "file_id").alias("source_path")).distinct(), scratch(spark, "export")
    fs.write_json(fs.export(x, files), f"{at}/json")
    fs.write_csv(fs.export(x, files, content=False), f"{at}/csv")
    one = spark.read.schema("id string, content string").json(f"{at}/json").select("id", F.sha2("content", 256).alias("hash"))
    return spark.read.option("header", "true").schema("id string, file_id string, token_count bigint, chunk_type string, source_path string").csv(f"{at}/csv").join(one, "id")


def _zipped(df: DataFrame, files: dict[str, str]) -> DataFrame:
    """(id, content): a zip file a row, of texts with {k} and {v} in place of the row's key and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    for name, text in files.items():
                        z.writestr(name, text.replace("{k}", k).replace("{v}", v))
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "content"])

    return df.mapInArrow(run, "id string, content binary")


def _named(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("v"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_DOCX = f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part {{k}}</w:t></w:r></w:p><w:p><w:r><w:t>It is </w:t><w:t>{{v}}</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>key</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{{k}}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
_XLSX = {"xl/sharedStrings.xml": f"<sst {_S}><si><t>{{v}}</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {_S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c></row><row r="2"/><row r="3"><c r="A3"><v>{{k}}</v></c></row></sheetData></worksheet>'}


@query("extract_docx", "SELECT p_partkey::VARCHAR AS file_id, i::BIGINT AS position, t AS segment_type, replace(replace(c, '{k}', p_partkey::VARCHAR), '{v}', p_name) AS content FROM part, (VALUES (0, 'heading', 'Part {k}'), (1, 'text', 'It is {v}'), (2, 'table', 'key | {k}')) v(i, t, c)")
def _(spark, d):
    return fs.extract(_zipped(_named(spark, d), {"word/document.xml": _DOCX}), "docx").select("file_id", "position", "segment_type", "content")


@query("extract_docx_broken", "SELECT p_partkey::VARCHAR AS file_id, i::BIGINT AS position, replace(replace(c, '{k}', p_partkey::VARCHAR), '{v}', p_name) AS content FROM part, (VALUES (0, 'Part {k}'), (1, '{v}')) v(i, c)")
def _(spark, d):
    return fs.extract(_zipped(_named(spark, d), {"word/document.xml": "<w:t>Part {k}</w:t><w:t></w:t><w:t>{v}</w:t><oops"}), "docx").select("file_id", "position", "content")


@query("extract_xlsx", "SELECT p_partkey::VARCHAR AS file_id, i::BIGINT AS position, replace(replace(c, '{k}', p_partkey::VARCHAR), '{v}', p_name) AS content FROM part, (VALUES (0, 'A1:{v} | B1:TRUE'), (1, 'A3:{k}')) v(i, c)")
def _(spark, d):
    return fs.extract(_zipped(_named(spark, d), _XLSX), "xlsx").select("file_id", "position", "content")


@query("extract_xlsx_broken", "SELECT p_partkey::VARCHAR AS file_id, 0::BIGINT AS position, p_partkey || ' ' || p_name AS content FROM part")
def _(spark, d):
    return fs.extract(_zipped(_named(spark, d), {"xl/worksheets/sheet1.xml": "<row><v>{k}</v><v>{v}</v><oops"}), "xlsx").select("file_id", "position", "content")


@query("extract_pdf_broken", "SELECT p_partkey::VARCHAR AS file_id, 0::BIGINT AS position, 'Part ' || p_partkey || ' ' || p_name AS content FROM part")
def _(spark, d):
    raw = F.encode(F.concat(F.lit("%PDF (Part "), "id", F.lit(") Tj ("), "v", F.lit(") Tj")), "UTF-8")
    return fs.extract(_named(spark, d).select("id", raw.alias("content")), "pdf").select("file_id", "position", "content")


#: A source of each language, % standing for the part's key, and its blocks: kind, name, first and last line.
SOURCES = {
    "go": ('package p\n\nimport "fmt"\n\ntype (\n\tT% struct {\n\t\ta int\n\t}\n)\n\nfunc (t *T%) Run() {\n\tfmt.Println("{")\n}\n', (("import", '"fmt"', 3, 3), ("struct", "T%", 6, 8), ("function", "(*T%).Run", 11, 13))),
    "python": ("import os\nclass A%:\n    def f(self):\n        import re\n        return 1\n\nx = 1\ndef g%():\n    pass", (("import", "", 1, 1), ("class", "A%", 2, 2), ("function", "f", 3, 6), ("function", "g%", 8, 9))),
    "javascript": ("import x from 'y'\nfunction f%() {\n  if (a) { b }\n}\nconst g% = (a) => {\n  return a\n}\nexport class C {\n  m() { }\n}", (("import", "", 1, 1), ("function", "f%", 2, 4), ("function", "g%", 5, 7), ("class", "C", 8, 10))),
    "typescript": ("import { x } from 'y'\nclass S% {\n  n: number\n}\nasync function f%(a: string) {\n  return a\n}", (("import", "", 1, 1), ("class", "S%", 2, 4), ("function", "f%", 5, 7))),
    "bash": ("#!/bin/sh\n# no\nf%() {\n  x\n}\nfunction g {\n y\n}", (("shebang", "", 1, 1), ("function", "f%", 3, 5), ("function", "g", 6, 8))),
    "sql": ("-- c\nSELECT %\nFROM x;\nnoise\ncreate table t% (a int);\nDELETE FROM t%", (("select", "", 2, 3), ("create", "", 5, 5), ("delete", "", 6, 6))),
    "html": ("<p>%\n<script>\nx = %\n</script>\n<style>\na\n</style>\n", (("script", "", 2, 4), ("style", "", 5, 7))),
    "markdown": ("lost\n# A%\ntext\n```py\ncode\n ```\n```\n## B\nend %", (("code_block", "py", 4, 7), ("section", "A%", 2, 7), ("section", "B", 8, 9))),
}


def _source(language: str) -> None:
    text, blocks = SOURCES[language]
    rows = ", ".join(f"({i}, '{k}', '{n}', {a}, {b}, '{chr(10).join(text.split(chr(10))[a - 1 : b]).replace(chr(39), chr(39) * 2)}')" for i, (k, n, a, b) in enumerate(blocks))
    sql = f"SELECT p_partkey::VARCHAR AS file_id, i::BIGINT AS position, k AS kind, replace(n, '%', p_partkey::VARCHAR) AS name, a::BIGINT AS line_start, b::BIGINT AS line_end, substr(sha256(replace(c, '%', p_partkey::VARCHAR)), 1, 32) AS id FROM part, (VALUES {rows}) v(i, k, n, a, b, c)"

    @query(f"blocks_{language}", sql if language not in ("javascript", "typescript", "python", "bash", "sql") else sql.replace("substr(sha256(replace(c, '%', p_partkey::VARCHAR)), 1, 32) AS id", "substr(sha256(CASE WHEN k IN ('import', 'shebang') THEN rtrim(replace(c, '%', p_partkey::VARCHAR)) ELSE replace(c, '%', p_partkey::VARCHAR) END), 1, 32) AS id"))
    def run(spark, d):
        x = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(F.lit(text), F.lit("%"), F.col("p_partkey").cast("string")).alias("content"))
        return fs.extract(x, "code", {"language": language}).select("file_id", "position", "kind", "name", "line_start", "line_end", "id")


for _language in SOURCES:
    _source(_language)


@query("extractor_registered", "SELECT doc_id::VARCHAR AS file_id, (i - 1)::BIGINT AS position, p[i] AS content FROM (SELECT doc_id, string_split(source || ';' || lang, ';') AS p, unnest([1, 2]) AS i FROM documents)")
def _(spark, d):
    r = hooks.REGISTRY
    r.add_extractor(hooks.Extractor("semicolons", "v1", lambda text, options: [parsers.Block("part", "", x, i, i) for i, x in enumerate(text.split(options["at"]))], ("text/x-semicolons",)))
    name = r.extractor_for("text/x-semicolons").name
    x = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(";", "source", "lang").alias("content"))
    return fs.extract(x, name, {"at": ";"}).select("file_id", "position", "content")


@query("vectorizer_registered", "SELECT doc_id AS chunk_id, 'lexical' AS layer, length(text)::DOUBLE AS first, 0.0::DOUBLE AS second, 2::BIGINT AS dimensions FROM documents")
def _(spark, d):
    hooks.REGISTRY.add_vectorizer(hooks.Vectorizer("lengths", "v1", lambda df, key, dims, config, env: df.select(F.col(key).alias("chunk_id"), F.array(F.length("content").cast("double"), F.lit(0.0)).alias("vector"))))
    v = workflow.apply_step(Step("v", "vectorize", "_input", "o", None, {"layer": "lexical", "algorithm": "lengths", "dimensions": 2}), contents(spark, d), {})
    return v.select("chunk_id", "layer", F.col("vector")[0].cast("double").alias("first"), F.col("vector")[1].cast("double").alias("second"), "dimensions")


@query("hooks_fired", "SELECT * FROM (VALUES (0::BIGINT, 'on_run_start', 'early'), (1::BIGINT, 'on_run_start', 'late'), (2::BIGINT, 'on_run_complete', 'late')) v(i, event, hook)")
def _(spark, d):
    seen, r, kept = [], hooks.REGISTRY, list(hooks.REGISTRY.hooks)
    r.add_hook("on_run_start", lambda e: seen.append((e["event"], "late")))
    r.add_hook("on_run_start", lambda e: seen.append((e["event"], "early")), priority=5)
    r.add_hook("on_run_complete", lambda e: seen.append((e["event"], "late")))
    try:
        _run(spark, d, "hooked")
    finally:
        r.hooks[:] = kept
    return spark.createDataFrame([(i, *x) for i, x in enumerate(seen)], "i bigint, event string, hook string")


@query("templates_filled", "SELECT doc_id FROM documents WHERE n_chars > 500")
def _(spark, d):
    return steps.filter_rows(read(spark, d, "documents"), catalog.template("{{ column }} > {{least}}", {"column": "n_chars", "least": 500})).select("doc_id")


# --------------------------------------------------------------------------- vectors and search


@query("vector_codec", "SELECT vec_id, 4 * len(embedding) AS octets, true AS same FROM embeddings")
def _(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).withColumn("raw", vc.encode_vector(F.col("v")))
    return e.select("vec_id", F.octet_length("raw").cast("bigint").alias("octets"), (vc.decode_vector(F.col("raw")) == F.col("v")).alias("same"))


_TOK = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"
_BI = f"(SELECT id, len(g) AS total, unnest(g) AS term FROM (SELECT id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS g FROM (SELECT id, {_TOK} AS t FROM {CONTENTS})))"


@query("tfidf_ngrams", f"SELECT term, count(DISTINCT id) AS df, round(ln((SELECT count(*) FROM documents)::DOUBLE / count(DISTINCT id)), 6) AS idf FROM {_BI} GROUP BY term HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) <= floor((SELECT count(*) FROM documents) * 0.3)")
def _(spark, d):
    x = contents(spark, d)
    return vectorize.idf(vectorize.terms(x, ngrams=(1, 2)), x.count(), 5, 0.3).select("term", "df", F.round("idf", 6).alias("idf"))


@query("search_presets", "SELECT * FROM (VALUES ('default', 10::BIGINT, 0.1::DOUBLE, 0.45::DOUBLE, 0.30::DOUBLE, 0.25::DOUBLE), ('code', 20, 0.15, 0.6, 0.4, NULL), ('semantic', 10, 0.2, NULL, 0.3, 0.7)) v(id, top_k, min_score, structure, lexical, contextual)")
def _(spark, d):
    p = catalog.Catalog().presets(spark)
    return p.select("id", "top_k", "min_score", *[F.col("layer_weights")[x].alias(x) for x in ("structure", "lexical", "contextual")])


# --------------------------------------------------------------------------- corpus, queue, bus, catalog


def _merged(spark, d) -> tuple[Corpus, str, list[str]]:
    """Two runs over halves of documents that overlap, and a failed one, queued and merged by the stream."""
    at = scratch(spark, "merged")
    corpus, q = Corpus(spark, f"{at}/corpus"), f"{at}/queue"
    files = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "doc_id").alias("source_path"), F.lit("text/plain").alias("mime_type"), F.col("doc_id").cast("string").alias("checksum"), F.lit("pending").alias("status"), F.col("text").alias("content"))
    corpus.write("raw_files", files)
    w = builtin.WORKFLOWS["text_chunking_v1"]
    w = Workflow("text_short_v1", "text_short_v1", tuple(s for s in w.steps if s.operation != "vectorize"))
    for run_id, part in (("r1", "cast(id as int) % 3 <> 0"), ("r2", "cast(id as int) % 3 <> 1")):
        tables = {"_input": files.where(part), "corpus.chunks": corpus.read("chunks")}
        queue.submit(spark, q, workflow.run(spark, w, tables, f"{at}/runs", run_id=run_id))
    bad = Workflow("bad", "bad", _NONE)
    queue.submit(spark, q, workflow.run(spark, bad, {"_input": _docs(spark, d)}, f"{at}/runs", run_id="r3"))
    queue.start(spark, q, corpus, f"{at}/checkpoint").awaitTermination()
    return corpus, q, ["r1", "r2", "r3"]


_BLOCKS = """(SELECT file_id, string_agg(u || chr(10), '' ORDER BY i) AS content FROM (
SELECT *, sum(CASE WHEN trim(u, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS b FROM (SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, unnest(p) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE trim(u, ' ' || chr(9) || chr(13)) <> '' GROUP BY file_id, b)"""
_CHUNKS = f"(SELECT DISTINCT substr(sha256(content), 1, 32) AS id, sha256(content) AS hash FROM {_BLOCKS} WHERE length(content) // 4 BETWEEN 50 AND 512)"


@query("merge_queue", f"SELECT id, hash FROM {_CHUNKS}")
def _(spark, d):
    return _merged(spark, d)[0].read("chunks").select("id", "hash")


@query("merge_status", f"""SELECT * FROM (SELECT 'pending' AS what, 0::BIGINT AS n UNION ALL SELECT 'done', 2 UNION ALL SELECT 'failed', 1 UNION ALL SELECT 'retried', 1 UNION ALL SELECT 'deleted', 2 UNION ALL SELECT 'merged', 2
UNION ALL SELECT 'chunks', (SELECT count(*) FROM {_CHUNKS}) UNION ALL SELECT 'vectorized', (SELECT count(DISTINCT file_id) FROM {_BLOCKS} WHERE length(content) // 4 BETWEEN 50 AND 512)
UNION ALL SELECT 'again', 0 UNION ALL SELECT 'produced', (SELECT count(*) FROM {_CHUNKS}))""")
def _(spark, d):
    corpus, q, _ = _merged(spark, d)
    history = corpus.read("run_history")
    out = list(queue.status(spark, q).items()) + [("merged", history.where("status = 'merged'").count()), ("produced", history.agg(F.sum("rows_produced")).first()[0])]
    out += [(k, v) for k, v in queue.corpus_status(corpus).items() if k in ("chunks", "vectorized")]
    out.append(("again", int(queue.merge_one(spark, corpus, f"{q}/done/r1") == "merged")))
    out += [("retried", queue.retry_failed(spark, q)), ("deleted", queue.collect_garbage(spark, q, -1))]
    return spark.createDataFrame(out, "what string, n bigint")


@query("index_postings", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOK}) AS term FROM (SELECT DISTINCT substr(sha256(content), 1, 32) AS id, content FROM {_BLOCKS} WHERE length(content) // 4 BETWEEN 50 AND 512)) GROUP BY ALL) GROUP BY term")
def _(spark, d):
    return _merged(spark, d)[0].read("chunk_postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _three(spark, d) -> Corpus:
    """Relations in three appends, of which the last repeats keys."""
    corpus = Corpus(spark, scratch(spark, "three"))
    e = read(spark, d, "labels").select("doc_id", F.col("doc_id").cast("string").alias("from_chunk_id"), F.lit("x").alias("to_chunk_id"), F.lit("references").alias("relation_type"), F.lit(0.5).alias("weight"))
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    corpus.append("chunk_relations", e.where(even))
    corpus.append("chunk_relations", e.where(~even))
    corpus.replace("chunk_relations", e.where("doc_id % 5 = 0").withColumn("weight", F.lit(1.0)))
    return corpus


@query("corpus_replace", "SELECT doc_id::VARCHAR AS from_chunk_id, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM labels")
def _(spark, d):
    return _three(spark, d).read("chunk_relations").select("from_chunk_id", "weight")


@query("corpus_compact", "SELECT 'chunk_relations' AS \"table\", (SELECT count(*) FROM labels) AS rows, 1::BIGINT AS parts, true AS deleted")
def _(spark, d):
    c, table = _three(spark, d), "chunk_relations"
    # where the last append replaced keys in every bucket, its part stands alone: one key more, so that there is something to compact
    held = c.read(table)
    least = held.agg(F.min("from_chunk_id").alias("k")).first()["k"]
    if least is not None:
        c.replace(table, held.where(F.col("from_chunk_id") == least))
    c.compact(table)
    there = lambda: {n for _, n in folders(spark, f"{c.path}/{table}")}
    live, before = {p["part"] for p in c.parts(table)}, there()
    gone = c.vacuum()
    return c.stats().select("table", "rows", "parts", F.lit(there() == live and gone == len(before - live)).alias("deleted"))


@query("corpus_transaction", "SELECT * FROM (VALUES ('before', 0::BIGINT, 0::BIGINT), ('after', (SELECT count(*) FROM labels), 1::BIGINT)) v(moment, files, settings)")
def _(spark, d):
    c, out = Corpus(spark, scratch(spark, "two")), []
    files = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    changes = {"raw_files": c.appended("raw_files", files), "config": c.replaced("config", spark.createDataFrame([("k", "v")], "key string, value string"))}
    out.append(("before", c.read("raw_files").count(), c.read("config").count()))
    c.commit(changes)
    out.append(("after", c.read("raw_files").count(), c.read("config").count()))
    return spark.createDataFrame(out, "moment string, files bigint, settings bigint")


@query("corpus_config", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{'1024' if k == 'max_chunk_tokens' else v}')" for k, v in schemas.CONFIG.items()) + ", ('mine', 'x')) v(key, value)")
def _(spark, d):
    c = Corpus(spark, scratch(spark, "config"))
    for k, v in (("max_chunk_tokens", "256"), ("mine", "x"), ("max_chunk_tokens", "1024")):
        c.set_config(k, v)
    assert c.get_config("mine") == "x" and c.get_config("version") == schemas.CONFIG["version"]
    return c.config()


@query("corpus_attached", "SELECT 'chunk_relations' AS t, (SELECT count(*) FROM labels) AS n, true AS there, false AS elsewhere")
def _(spark, d):
    c, other = Corpus(spark, scratch(spark, "own")), _three(spark, d)
    c.attach("other", other.path)
    out = c.read("other.chunk_relations").agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunk_relations").alias("t"), "n", F.lit(other.exists("chunk_relations")).alias("there"), F.lit(c.exists("chunk_relations")).alias("elsewhere"))
    c.detach("other")
    return out


@query("get_chunk", "SELECT doc_id::VARCHAR AS id, n_chars AS size FROM documents WHERE doc_id = 7")
def _(spark, d):
    c = Corpus(spark, scratch(spark, "get"))
    c.write("raw_files", read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("size")))
    return fs.get_row(c.read("raw_files", ["7"]), "7").select("id", "size")


@query("edge_faults", "SELECT a AS from_chunk_id, f AS fault FROM (VALUES ('a', 'relation_type isn''t legal'), ('b', 'weight isn''t in [0, 1]'), ('c', 'to_chunk_id is null'), ('d', 'from_chunk_id has no chunks'), ('d', 'to_chunk_id has no chunks')) v(a, f)")
def _(spark, d):
    e = spark.createDataFrame([("a", "b", "likes", 1.0), ("b", "a", "follows", 1.5), ("c", None, "follows", 1.0), ("d", "e", "calls", 0.0), ("a", "c", "imports", 0.5)], schemas.TABLES["chunk_relations"].ddl)
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    return schemas.validate(e, "chunk_relations", {"chunks": chunks}).select("from_chunk_id", F.explode("faults").alias("fault"))


@query("relations_calls", "SELECT n.doc_id AS from_chunk_id, l.doc_id AS to_chunk_id, 'calls' AS relation_type, 1.0::DOUBLE AS weight FROM labels l JOIN labels n ON n.doc_id <> l.doc_id AND n.doc_id // 10 = l.doc_id // 10 AND l.toxic = 1")
def _(spark, d):
    x = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("x = f_"), F.expr("doc_id div 10"), F.lit("(1) + g_9 (2)")).alias("content"), "toxic")
    names = x.where("toxic = 1").select("id", F.concat(F.lit("f_"), F.expr("id div 10")).alias("name"))
    return relations.calls(x, names)


@query("relations_imports", "SELECT n.n_nationkey AS from_chunk_id, r.n_nationkey AS to_chunk_id, 'imports' AS relation_type, 1.0::DOUBLE AS weight FROM nation n JOIN nation r ON r.n_nationkey = n.n_regionkey AND r.n_nationkey <> n.n_nationkey")
def _(spark, d):
    x = read(spark, d, "nation")
    blocks = x.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("import pkg.m"), "n_regionkey").alias("content"))
    return relations.imports(blocks, x.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("pkg.m"), "n_nationkey").alias("name")))


@query("bus_tasks", "SELECT * FROM (VALUES ('z', 'a', 'done', 'w1', 'ok'), ('z', 'b', 'failed', 'w2', 'no'), ('z', 'c', 'pending', NULL, NULL), ('y', 'd', 'claimed', 'w1', NULL)) v(zone, kind, status, worker, result)")
def _(spark, d):
    corpus = Corpus(spark, scratch(spark, "bus"))
    b = bus.Bus(spark, corpus)
    for zone, kind in (("z", "a"), ("z", "b"), ("z", "c"), ("y", "d")):
        b.submit(zone, kind)
    b.complete(b.claim("z", "w1")["id"], "ok")
    later = bus.Bus(spark, corpus)  # another writer takes up the state
    later.fail(later.claim("z", "w2")["id"], "no")
    later.claim("y", "w1")
    assert later.pending("z") == 1
    return corpus.read("tasks").select("zone", "kind", "status", "worker", "result")


@query("bus_beats_and_logs", "SELECT * FROM (VALUES ('beat', 'w1', 'dead'), ('info', 'w1', 'up'), ('error', 'w1', 'down')) v(what, worker, message)")
def _(spark, d):
    corpus = Corpus(spark, scratch(spark, "beats"))
    b = bus.Bus(spark, corpus)
    b.heartbeat("w1", "z")
    b.heartbeat("w2", "z")
    b.deregister("w2")
    b.info("w1", "up", n=1)
    b.error("w1", "down")
    b.mark_dead(-1)
    return corpus.read("heartbeats").select(F.lit("beat").alias("what"), "worker", F.col("status").alias("message")).unionByName(corpus.read("logs").select(F.col("level").alias("what"), "worker", "message"))


@query("manifest_stored", "SELECT * FROM (VALUES ('p', 'loaded', (SELECT count(*) FROM nation)), ('p', 'faults', 0::BIGINT), ('q', 'loaded', 1::BIGINT)) v(process, what, n)")
def _(spark, d):
    corpus, at = Corpus(spark, scratch(spark, "manifest")), _files(spark, d)
    found = manifest.scan(spark, at, "p")
    one = spark.createDataFrame([("q", "/x", "database", "0", 0)], schemas.TABLES["manifests"].ddl)
    manifest.store(corpus, found.limit(3).unionByName(one))
    manifest.store(corpus, found)
    mine = manifest.load(corpus, "p")
    return spark.createDataFrame([("p", "loaded", mine.count()), ("p", "faults", manifest.verify(mine, found).count()), ("q", "loaded", manifest.load(corpus, "q").count())], "process string, what string, n bigint")


_WF = ", ".join(f"('{w.id}', '{w.name}', {len(w.steps)}::BIGINT, '{' '.join(sorted(w.tags))}')" for w in builtin.WORKFLOWS.values())


@query("catalog_list", f"SELECT * FROM (VALUES {_WF}) v(id, name, steps, tags)")
def _(spark, d):
    c = catalog.Catalog()
    n = c.steps(spark).groupBy(F.col("workflow_id").alias("id")).agg(F.count(F.lit(1)).alias("steps"))
    tags = c.tags(spark).groupBy(F.col("workflow_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("tags"))
    return c.workflows(spark).select("id", "name").join(n, "id").join(tags, "id")


@query("catalog_by_tag", "SELECT id FROM (VALUES ('go_chunking_v1'), ('python_chunking_v1'), ('javascript_chunking_v1'), ('typescript_chunking_v1'), ('bash_chunking_v1'), ('sql_chunking_v1')) v(id)")
def _(spark, d):
    return catalog.Catalog().by_tag(spark, "code").select("id")


@query("catalog_rules", "SELECT * FROM (VALUES ('heading', 5::BIGINT), ('list_item', 4), ('list_item', 3), ('blockquote', 2), ('code_block', 1)) v(output_type, priority)")
def _(spark, d):
    return catalog.Catalog().parse_rules(spark).select("output_type", "priority")


@query("catalog_strategies", "SELECT * FROM (VALUES ('pdf_chunking_v1', 50::BIGINT, 512::BIGINT, 50::BIGINT), ('docx_chunking_v1', 30, 512, 30), ('text_chunking_v1', 50, 512, 50)) v(id, min_tokens, max_tokens, overlap_tokens)")
def _(spark, d):
    return catalog.Catalog().chunking_strategies(spark).select("id", "min_tokens", "max_tokens", "overlap_tokens")


@query("catalog_vectorizations", "SELECT * FROM (VALUES ('structure', 'feature_hash', 7::BIGINT), ('lexical', 'tfidf', 8), ('contextual', 'graph_embed', 1), ('blend', 'blend', 7)) v(layer, algorithm, n)")
def _(spark, d):
    v = catalog.Catalog().vectorization_configs(spark).where("id not like 'bash%' and id not like 'sql%' and id not like 'html%'")
    return v.groupBy("layer", "algorithm").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_lifecycle", "SELECT * FROM (VALUES ('clone', 'draft', 8::BIGINT), ('activated', 'active', 8), ('deprecated', 'deprecated', 8), ('deleted', 'none', 0)) v(moment, status, steps)")
def _(spark, d):
    c, out = catalog.Catalog(), []

    def note(moment: str) -> None:
        rows = c.workflows(spark).where("id = 'mine'").collect()
        out.append((moment, rows[0]["status"] if rows else "none", c.steps(spark).where("workflow_id = 'mine'").count()))

    c.clone("text_chunking_v1", "mine", "Mine")
    note("clone")
    for moment, act in (("activated", c.activate), ("deprecated", c.deprecate), ("deleted", c.delete)):
        act("mine")
        note(moment)
    return spark.createDataFrame(out, "moment string, status string, steps bigint")


@query("catalog_loaded", "SELECT doc_id::VARCHAR AS id FROM documents WHERE lang = 'fr'")
def _(spark, d):
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read back on the driver
        json.dump({"id": "french_v1", "tags": ["mine"], "steps": [{"step_name": "s", "operation": "filter", "source": "_input", "output": "_output", "predicate": "lang = 'fr'"}]}, f)
        f.flush()
        c = catalog.Catalog([])
        catalog.load_file(c, f.name)
    return workflow.compile_workflow(c.load("french_v1"), {"_input": _docs(spark, d)})["_output"].select("id")


@query("workflow_metrics", "SELECT o_orderpriority AS workflow_id, 1::BIGINT AS workflow_version, 'success_rate' AS metric_name, round(avg((o_orderstatus = 'F')::DOUBLE), 6) AS metric_value, count(*) AS sample_size FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, 1, 'avg_rows_out', round(avg(o_custkey), 6), count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def _(spark, d):
    o = read(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("workflow_id"), F.lit(1).cast("bigint").alias("workflow_version"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    steps_ = o.select(F.col("o_orderkey").alias("run_id"), F.lit(1).alias("step_order"), F.lit(None).cast("bigint").alias("duration_ms"), F.col("o_custkey").alias("rows_out"))
    return catalog.metrics(runs, steps_).withColumn("metric_value", F.round("metric_value", 6))


@query("search_reranked", "SELECT * FROM (VALUES ('plain', 'a'), ('boosted', 'b')) v(how, best)")
def _(spark, d):
    chunks = spark.createDataFrame([(i, "f", f"cats like {w} cats") for i, w in (("a", "other"), ("b", "some"))], "id string, file_id string, content string")
    vectors = spark.createDataFrame([("a", "structure", [1.0, 0.0]), ("b", "structure", [0.9, 0.1])], "chunk_id string, layer string, vector array<double>")
    files = spark.createDataFrame([("f", "/f")], "id string, source_path string")
    log = spark.createDataFrame([("b", "upvote")] * 20, "chunk_id string, action string")
    ask = lambda **how: search.search(chunks, vectors, files, "cats", {"structure": [1.0, 0.0]}, "code", 1, search.index(chunks), None, (2, 4.0), **how).first()["chunk_id"]
    return spark.createDataFrame([("plain", ask()), ("boosted", ask(rerank=search.feedback(log).select("chunk_id", "boost")))], "how string, best string")
