"""Definitions, the compiler, runs, the merge queue, the bus."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusmill import bus, schemas
from corpusmill.plans import builtin, catalog, workflow
from corpusmill.plans.workflow import Step, Workflow
from corpusmill.streaming import queue

PARA = " ".join(["word"] * 60)


@pytest.fixture
def inputs(spark):
    rows = [(f"f{i}", f"/{i}.txt", "text/plain", "pending", f"{PARA} number {i}\n\n{PARA} again {i % 2}") for i in range(4)]
    files = spark.createDataFrame(rows, "id string, source_path string, mime_type string, status string, content string")
    return {"_input": files, "corpus.chunks": spark.createDataFrame([], "id string, hash string"), "corpus.relations": spark.createDataFrame([], schemas.TABLES["chunk_relations"].ddl)}


def test_builtins_are_sound():
    assert len(builtin.WORKFLOWS) == 12
    for w in builtin.WORKFLOWS.values():
        assert w.check() == [], w.id
    assert [len(builtin.WORKFLOWS[f"{k}_chunking_v1"].steps) for k in ("pdf", "docx", "go", "bash", "text")] == [12, 13, 10, 9, 8] and len(builtin.WORKFLOWS["search_v1"].steps) == 10
    assert sum(len(w.steps) for w in builtin.WORKFLOWS.values()) == 120


def test_check_finds_faults():
    w = Workflow("w", "w", (Step("a", "filter", "nowhere", "o"), Step("b", "strange", "o", "o")))
    assert len(w.check()) == 3
    with pytest.raises(ValueError):
        Workflow("w", "w", (Step("a", "filter", "y", "x"), Step("b", "filter", "x", "y"))).order()


@pytest.mark.parametrize("kind", ["pdf", "docx", "go", "python", "javascript", "typescript", "bash", "sql", "html", "markdown", "text"])
def test_every_builtin_runs(spark, inputs, kind):
    w = builtin.WORKFLOWS[f"{kind}_chunking_v1"]
    code = {"go": "func Main() {\n\tx := 12345\n}\n", "python": "def main():\n    return 12345\n", "javascript": "function f() {\n  return 1 + 2\n}\n", "typescript": "function f() {\n  return 1 + 2\n}\n", "bash": "run() {\n  echo hello\n}\n", "sql": "SELECT a, b\nFROM t;\n", "html": "<script>\nlet a = 12345\n</script>\n", "markdown": "# Title\nsome text in here\n"}
    mime = w.steps[0].predicate.split("'")[1]
    src = inputs["_input"].withColumn("mime_type", F.lit(mime))
    if kind in code:
        src = src.withColumn("content", F.concat(F.lit(code[kind]), F.lit("\n")))
    env = workflow.compile_workflow(w, inputs | {"_input": src})
    out = env["_output"]
    assert out.count() >= 1 and "content_hash" in out.columns
    for s in w.steps:
        if s.operation == "vectorize":
            row = env[s.output].first()
            assert row["layer"] == s.config["layer"] and len(row["vector"]) == 256


def test_empty_input_skips_or_fails(spark, inputs):
    w = builtin.WORKFLOWS["text_chunking_v1"]
    none = inputs | {"_input": inputs["_input"].limit(0)}
    env = workflow.compile_workflow(w, none)
    assert env["_output"].count() == 0 and "content" in env["_output"].columns and len(env) < 7
    strict = replace(w, steps=(replace(w.steps[0], on_empty="fail"), *w.steps[1:]))
    with pytest.raises(workflow.Fails):
        workflow.compile_workflow(strict, none)


def test_steps_by_hand(spark, inputs):
    w = Workflow("w", "w", (
        Step("short", "fork", "_input", "a", "id < 'f2'"), Step("long", "fork", "_input", "b", "id >= 'f2'"), Step("again", "merge", "a", "m", None, {"sources": ["b"]}),
        Step("pack", "window", "m", "p", None, {"strategy": "paragraph", "pack": True}), Step("n", "aggregate", "p", "n", None, {"group_by": ["file_id"], "functions": {"n": "count(*)"}}),
        Step("j", "join", "p", "j", None, {"table": "n", "on": ["file_id"]}), Step("d", "diff", "_input", "d", None, {"after": "a"}), Step("out", "project", "j", "_output", "*"),
    ))
    env = workflow.compile_workflow(w, inputs)
    assert env["_output"].count() == 8 and env["d"].first()["rows_lost"] == 2


def test_catalog(spark):
    c = catalog.Catalog()
    assert c.workflows(spark).count() == 12 and c.steps(spark).count() == 120 and c.presets(spark).count() == 3
    assert {r["id"] for r in c.by_tag(spark, "code").collect()} == {f"{k}_chunking_v1" for k in ("go", "python", "javascript", "typescript", "bash", "sql")}
    assert c.clone("text_chunking_v1", "mine", "Mine").status == "draft"
    with pytest.raises(KeyError):
        c.load("mine")
    c.activate("mine")
    assert c.load("mine").steps == c.load("text_chunking_v1").steps and c.deprecate("mine") == 1 and c.delete("mine") == 1
    rows = [r.asDict() for r in c.steps(spark).where("workflow_id = 'go_chunking_v1'").collect()]
    assert catalog.from_rows(rows).steps == c.load("go_chunking_v1").steps
    assert catalog.template("a {{x}}", {"x": "t.b"}) == "a t.b"
    with pytest.raises(ValueError):
        catalog.template("{{x}}", {"x": "a; b"})


def test_run_and_merge(spark, inputs, tmp_path):
    w = builtin.WORKFLOWS["text_chunking_v1"]
    corpus, q = queue.Corpus(spark, f"{tmp_path}/corpus"), f"{tmp_path}/queue"
    corpus.write("raw_files", inputs["_input"])
    for run_id in ("r1", "r2"):
        queue.submit(spark, q, workflow.run(spark, w, inputs, f"{tmp_path}/runs", run_id=run_id))
    bad = Workflow("bad", "bad", (Step("none", "filter", "_input", "_output", "id = 'x'", {}, "fail"),))
    queue.submit(spark, q, workflow.run(spark, bad, inputs, f"{tmp_path}/runs", run_id="r3"))
    log = spark.read.parquet(f"{q}/pending/r1/_step_executions").collect()
    assert {r["step_name"]: r["rows_out"] for r in log}["select_text_files"] == 4
    queue.start(spark, q, corpus, f"{tmp_path}/checkpoint").awaitTermination()
    assert queue.status(spark, q) == {"pending": 0, "done": 2, "failed": 1}
    chunks = corpus.read("chunks")
    assert chunks.count() == 6 and chunks.select("id").distinct().count() == 6  # the repeated paragraphs and the second run add nothing
    assert corpus.read("chunk_vectors").count() == 6 and corpus.read("run_history").count() == 2
    assert queue.corpus_status(corpus)["vectorized"] == 4
    assert queue.merge_one(spark, corpus, f"{q}/done/r1") == "skipped"
    assert queue.retry_failed(spark, q) == 1 and queue.status(spark, q)["pending"] == 1
    assert queue.collect_garbage(spark, q, max_age_days=-1) == 2 and queue.status(spark, q)["done"] == 0


def test_event_streams(spark, tmp_path):
    from corpusmill.streaming import events

    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, "a", 1.0, "{}") for i in range(50)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/e")
    s = events.once(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e"))
    q = s.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from seen").count() == 50
    assert events.counts(df, "10 minutes").count() == 5 and events.sessions(df, "5 minutes").count() == 2


def test_bus(spark):
    b = bus.Bus(spark)
    first, second = b.submit("z", "k", {"a": 1}), b.submit("z", "k")
    assert b.claim("y", "w") is None and b.claim("z", "w")["id"] == first and b.pending("z") == 1
    b.complete(first, "ok")
    b.claim("z", "w")
    b.fail(second, "no")
    with pytest.raises(ValueError):
        b.fail(second, "again")
    assert (b.status(first), b.status(second), b.status("x")) == ("done", "failed", None)
    b.heartbeat("w", "z")
    b.heartbeat("w", "z")
    assert b.heartbeats().count() == 1 and b.mark_dead(-1) == ["w"] and b.heartbeats().first()["status"] == "dead"
    b.log("w", "info", "hello", n=1)
    assert b.logs().count() == 1 and b.tasks().count() == 2
    b.deregister("w")
    assert b.heartbeats().count() == 0
