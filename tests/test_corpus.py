"""The corpus, its merges, runs and numbering."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill import corpus as cp
from corpusmill import schemas
from corpusmill.operators import chunking, steps
from corpusmill.plans import workflow
from corpusmill.plans.workflow import RunConfig, Step, Workflow
from corpusmill.streaming import queue


def _run(spark, at, run_id, chunks, vectors=(), status="completed"):
    path = f"{at}/{run_id}"
    out = spark.createDataFrame(chunks, "id string, file_id string, content string, position bigint").withColumn("chunk_type", F.lit("semantic"))
    schemas.align(out, "_output").write.parquet(f"{path}/_output")
    if vectors:
        v = spark.createDataFrame(vectors, "chunk_id string, vector array<float>").withColumn("layer", F.lit("lexical"))
        schemas.align(v, "chunk_vectors").write.parquet(f"{path}/_output_vectors")
    meta = spark.createDataFrame([(run_id, "w", 1, status)], "run_id string, workflow_id string, workflow_version bigint, status string")
    schemas.align(meta, "_run_meta").write.parquet(f"{path}/_run_meta")
    return path


def test_a_batch_is_one_commit(spark, tmp_path):
    c = queue.Corpus(spark, f"{tmp_path}/c")
    c.write("raw_files", spark.createDataFrame([(f"f{i}", "pending") for i in range(5)], "id string, status string"))
    paths = [_run(spark, f"{tmp_path}/runs", f"r{i}", [(f"c{i}", f"f{i}", f"text {i} of run", i), ("shared", "f0", f"shared by run {i}", 0), (None, "f4", "no id", 0)], [(f"c{i}", [float(i)]), ("shared", [float(i)])]) for i in range(4)]
    before = c.manifest()[0]
    assert set(queue.merge_batch(spark, c, paths).values()) == {"merged"} and c.manifest()[0] == before + 1
    assert all(len(c.parts(t)) == 1 for t in ("chunks", "chunk_vectors", "chunk_postings", "run_history"))  # each written once
    got = {r["id"]: r for r in c.read("chunks").collect()}
    assert set(got) == {"c0", "c1", "c2", "c3", "shared"} and got["shared"]["content"] == "shared by run 0" and got["c2"]["created_by_run"] == "r2"
    assert {r["chunk_id"]: r["vector"][0] for r in c.read("chunk_vectors").collect()}["shared"] == 3.0  # the last counts
    assert {r["run_id"]: r["rows_produced"] for r in c.read("run_history").collect()} == {"r0": 2, "r1": 1, "r2": 1, "r3": 1}
    assert {r["id"] for r in c.read("raw_files").where("status = 'vectorized'").collect()} == {"f0", "f1", "f2", "f3"}
    assert queue.merge_batch(spark, c, paths[:2]) == dict.fromkeys(paths[:2], "skipped") and c.text_stats()[0] == 5
    assert {r["chunk_id"] for r in c.read("chunk_postings", ["shared"]).where("term = 'shared'").collect()} == {"shared"}


def test_a_bad_run_fails_alone(spark, tmp_path):
    c, q = queue.Corpus(spark, f"{tmp_path}/c"), f"{tmp_path}/q"
    for i, status in enumerate(("completed", "failed", "completed")):
        queue.submit(spark, q, _run(spark, f"{tmp_path}/runs", f"r{i}", [(f"c{i}", "f", "t", 0)], status=status))
    assert {n: s.split(":")[0] for n, s in queue.drain(spark, q, c, ["r0", "r1", "r2", "r9"]).items()} == {"r0": "merged", "r1": "failed", "r2": "merged"}
    assert queue.status(spark, q) == {"pending": 0, "done": 2, "failed": 1} and c.read("chunks").count() == 2


def test_other_errors_leave_runs_pending(spark, tmp_path, monkeypatch):
    c, q = queue.Corpus(spark, f"{tmp_path}/c"), f"{tmp_path}/q"
    queue.submit(spark, q, _run(spark, f"{tmp_path}/runs", "r", [("c", "f", "t", 0)]))
    monkeypatch.setattr(queue, "merge_batch", lambda *a: (_ for _ in ()).throw(RuntimeError("an executor is lost")))
    with pytest.raises(RuntimeError):
        queue.drain(spark, q, c, ["r"])
    assert queue.status(spark, q)["pending"] == 1


def test_renames_that_fail_raise(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    with pytest.raises(FileExistsError):
        cp.rename(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    with pytest.raises(Exception, match="none"):
        cp.rename(spark, f"{tmp_path}/none", f"{tmp_path}/c")


def test_replacing_leaves_other_buckets(spark, tmp_path):
    c = cp.Corpus(spark, str(tmp_path))
    c.write("config", spark.createDataFrame([(f"k{i}", "old") for i in range(300)], "key string, value string"))
    c.set_config("k7", "new")
    first, second = c.parts("config")
    assert len(first["buckets"]) + 1 >= len({*first["buckets"], *second["buckets"]}) and len(second["buckets"]) == 1
    assert c.get_config("k7") == "new" and c.read("config").count() == 300
    with pytest.raises(KeyError):
        c.get_config("none")
    c.attach("x", str(tmp_path))
    with pytest.raises(ValueError):
        c.attach("x", str(tmp_path))


def test_numbering(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([None, *range(40)]), f"{rnd.choice('abcé')}{i % 700}", i) for i in range(6000)]
    for some in (data, data[:3], [], [(1, "x", i) for i in range(50)]):
        df = spark.createDataFrame(some, "a int, b string, i int").repartition(3)
        got = [(r["n"], r["a"], r["b"], r["i"]) for r in steps.numbered(df, ["a", "b", "i"], "n").collect()]
        want = sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2]))
        assert sorted(got) == [(k, *r) for k, r in enumerate(want, 1)]


def test_packing_with_overlap(spark):
    units = [f"{c * 39}." for c in "abcdefgh"]  # ten tokens each
    df = spark.createDataFrame([("f", i, u) for i, u in enumerate(units)], "file_id string, position int, content string")
    got = [r["content"].split("\n\n") for r in chunking.declared(df, {"max_tokens": 30, "min_tokens": 1, "overlap_tokens": 10}).orderBy("position").collect()]
    assert got == [units[0:3], units[2:5], units[4:7], units[6:8]]
    marked = chunking.declared(df, {"max_tokens": 1000, "min_tokens": 1, "boundary_markers": ["^d", "^f"]}).orderBy("position").collect()
    assert [r["content"].split("\n\n") for r in marked] == [units[:3], units[3:5], units[5:]]


def test_packed_workflow(spark):
    w = workflow.packed(Workflow("w", "w", (Step("chunk", "window", "_input", "_output", None, {"strategy": "sentence"}),)))
    df = spark.createDataFrame([("f", 0, "One. Two! Three"), ("f", 1, "Four? Five.")], "file_id string, position int, content string")
    assert [r["content"] for r in workflow.compile_workflow(w, {"_input": df})["_output"].orderBy("position").collect()] == ["One.", "Two!", "Three", "Four?", "Five."]


def test_faulty_definitions_and_kept_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", "some text", 1)], "id string, file_id string, content string, position bigint")
    with pytest.raises(ValueError):
        workflow.run(spark, Workflow("w", "w", (Step("s", "strange", "_input", "_output"),)), {"_input": df}, str(tmp_path))
    at = workflow.run(spark, Workflow("w", "w", (Step("s", "filter", "_input", "_output", "id = 'a'"),)), {"_input": df}, str(tmp_path), config=RunConfig(keep_tables=True))
    assert spark.read.parquet(f"{at}/steps/_output").count() == 1 and spark.read.parquet(f"{at}/_run_meta").first()["status"] == "completed"


def test_parameters():
    assert steps.bind("a = :a AND b = ':b' AND c::int > :c", {"a": "x' \\", "c": 1}) == "a = 'x\\' \\\\' AND b = ':b' AND c::int > 1"
    assert steps.bind("a IN (?, ?) AND b = '?'", [None, True]) == "a IN (NULL, true) AND b = '?'"
    with pytest.raises(KeyError):
        steps.bind(":no", {"a": 1})
