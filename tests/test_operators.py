"""Operators over small tables."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.operators import chunking, metrics, relations, search, steps, upsert, vectorize


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_filter_with_order_and_limit(spark):
    df = spark.createDataFrame([(i, i * 0.1) for i in range(10)], "id bigint, blend_score double")
    out = steps.filter_rows(df, "blend_score >= :min_score ORDER BY blend_score DESC LIMIT :top_k", {"min_score": 0.25, "top_k": 3})
    assert [r["id"] for r in out.collect()] == [9, 8, 7]
    assert steps.filter_rows(df, None) is df and steps.filter_rows(df, "1=1") is df


def test_dialect():
    assert steps.to_spark_sql("CAST(length(x) AS REAL) / 2, length(content) / 4") == "CAST(length(x) AS DOUBLE) / 2, length(content) div 4"
    assert steps.to_spark_sql("x LIKE 'a / b AS REAL'") == "x ILIKE 'a / b AS REAL'"


def test_not_in_becomes_an_anti_join(spark):
    df = spark.createDataFrame([("a",), ("b",)], "content_hash string")
    seen = spark.createDataFrame([("a",)], "hash string")
    out = steps.filter_rows(df, "content_hash NOT IN (SELECT hash FROM corpus.chunks)", views={"corpus.chunks": seen})
    assert rows(out, "content_hash") == [("b",)] and "LeftAnti" in out._jdf.queryExecution().toString()


def test_join_suffixes_clashing_names(spark):
    a = spark.createDataFrame([(1, "x")], "id bigint, v string")
    assert steps.join(a, a, ["id"]).columns == ["id", "v", "v_right"]


def test_window_numbers_globally(spark):
    df = spark.createDataFrame([(i, i % 3, f"f{i % 2}", "x" * 4 * n) for i, n in enumerate([49, 50, 512, 513, 60, 70])], "id bigint, position bigint, file_id string, content string")
    out = steps.window(df).orderBy("chunk_position").collect()
    want = sorted([(i % 3, f"f{i % 2}", i) for i in (1, 2, 4, 5)])
    assert [(r["position"], r["file_id"], r["id"]) for r in out] == want and [r["chunk_position"] for r in out] == [1, 2, 3, 4]


def test_hashes(spark):
    df = spark.createDataFrame([("a",)], "content string")
    assert steps.hash_columns(df, ["content"], "fnv").first()["hash"] == "e40c292c"
    assert steps.hash_columns(df, ["content"]).first()["hash"].startswith("ca978112")
    with pytest.raises(ValueError):
        steps.hash_columns(df, ["content"], "md5000")


def test_diff(spark):
    a, b = (spark.createDataFrame([(i,) for i in r], "id bigint") for r in (range(180), range(420)))
    d = steps.diff(a, b).first()
    assert d["delta_type"] == "expansion" and (d["rows_lost"], d["rows_gained"]) == (0, 240) and round(d["jaccard_index"], 2) == 0.43 and d["delta_score"] < 0
    assert steps.diff(a.limit(0), a.limit(0)).first()["jaccard_index"] is None


def test_chunkers(spark):
    t = "# Title\n\nOne two.  Three!\n four\n \t\n five? six"
    df = spark.createDataFrame([("a", t), ("b", ""), ("c", " \n ")], "id string, content string")
    assert rows(chunking.by_paragraph(df), "position", "content") == [(0, "# Title"), (1, "One two.  Three! four"), (2, "five? six")]
    assert [r["content"] for r in chunking.by_sentence(df.where("id='a'")).orderBy("position").collect()] == ["# Title\n\nOne two.", "Three!", "four\n \t\n five?", "six"]


def test_fixed_windows_rebuild_the_words(spark):
    for n in (1, 2, 5, 9, 10, 11, 23):
        words = [f"w{i}" for i in range(n)]
        df = spark.createDataFrame([("a", " ".join(words))], "id string, content string")
        plain = [r["content"] for r in chunking.by_fixed_window(df, size=5, overlap=0).orderBy("position").collect()]
        assert " ".join(plain).split() == words
        over = chunking.by_fixed_window(df, size=5, overlap=2).orderBy("position").collect()
        again = []
        for r in over:
            again += r["content"].split()[r["overlap_prev"] :]
        assert again == words and over[-1]["overlap_next"] == 0 and all(r["overlap_next"] == 2 for r in over[:-1])
    with pytest.raises(ValueError):
        chunking.by_fixed_window(df, size=5, overlap=5)


def test_packing(spark):
    units = ["x" * 40] * 5 + ["# h", "y" * 400, "z" * 40]
    df = spark.createDataFrame([("a", "\n\n".join(units))], "id string, content string")
    out = [r["content"].split("\n\n") for r in chunking.by_packing(df, max_tokens=25, min_tokens=1).orderBy("position").collect()]
    assert out == [units[0:2], units[2:4], units[4:5], ["y" * 400], ["z" * 40]]  # the heading alone is too small


def test_sections(spark):
    lines = ["intro", "# A", "text", "## B", "more", "# C", "end"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_id string, position bigint, content string")
    assert [r["section_path"] for r in chunking.section_paths(df).orderBy("position").collect()] == ["", "A", "A", "A/B", "A/B", "C", "C"]


def test_tfidf_by_hand(spark):
    import math

    from corpusmill.functions import text as tx

    docs = {"a": "red blue blue", "b": "red green", "c": "green blue", "d": "all", "e": "other"}
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    want = {}
    for k, t in docs.items():
        w = t.split()
        for term in set(w):
            n = sum(term in x.split() for x in docs.values())
            if 2 <= n <= 4:
                i = tx.fnv_python(term) % 16
                want[k, i] = want.get((k, i), 0) + w.count(term) / len(w) * math.log(5 / n) * (1 if tx.fnv_python(term, False) % 2 == 0 else -1)
    got = {(r["id"], r["idx"]): r["value"] for r in vectorize.tfidf_sparse(df, dims=16).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    whole = vectorize.tfidf(df, dims=16).collect()
    assert len(whole) == 5 and all(len(r["vector"]) == 16 for r in whole)


def test_search(spark):
    docs = [("c1", "f", "the cat sat on the mat"), ("c2", "f", "a dog chased the cat up a tree"), ("c3", "g", "stocks fell on monday"), ("c4", "g", "cat food and dog food")]
    chunks = spark.createDataFrame(docs, "id string, file_id string, content string")
    files = spark.createDataFrame([("f", "/f.txt"), ("g", "/g.txt")], "id string, source_path string")
    postings = search.index(chunks)
    assert rows(search.match_all(postings, ["cat", "dog"]), "id") == [("c2",), ("c4",)]
    best = [r["id"] for r in search.top_k(search.bm25(postings, ["cat", "dog"], 4, 6.0), 3).collect()]
    assert set(best[:2]) == {"c2", "c4"} and best[2] == "c1"
    layers = vectorize.as_layer(vectorize.structure(chunks, dims=32), "structure", 32, "v").unionByName(vectorize.as_layer(vectorize.tfidf(chunks, dims=32, min_df=1, max_df=1.0), "lexical", 32, "v"))
    vecs = search.query_vectors(chunks, "cat dog", 32, vectorize.idf(postings, 4, 1, 1.0), 4)
    out = search.search(chunks, layers, files, "cat dog", vecs, "default", 10, postings, None, (4, 6.0)).collect()
    assert {r["chunk_id"] for r in out} == {"c2", "c4"} and all(r["source_path"] for r in out) and out[0]["score"] >= out[1]["score"]
    assert search.query_terms("The cat, the DOG") == ["cat", "dog"] and search.expand(["running"], {"running": ["jog"]}) == [["running", "jog", "runn"]]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    new = spark.createDataFrame([(2, "x", 1), (3, "z", 2), (3, "y", 1)], "id bigint, v string, run bigint")
    ignored = upsert.insert_ignore(old, new.drop("run"), ["id"])
    assert rows(ignored, "id", "v") == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(upsert.insert_ignore(ignored, new.drop("run"), ["id"]), "id", "v") == rows(ignored, "id", "v")
    assert rows(upsert.insert_replace(old, new, ["id"], ["run"]), "id", "v") == [(1, "a"), (2, "x"), (3, "z")]


def test_validator(spark):
    files = spark.createDataFrame([("f1", "/a", "text/plain", "c", "pending"), ("f2", "/b", "text/plain", "c", "strange"), ("f3", None, "t", "c", "failed")], "id string, source_path string, mime_type string, checksum string, status string")
    assert [(r["id"], r["faults"]) for r in schemas.validate(files, "raw_files").orderBy("id").collect()] == [("f2", ["status isn't legal"]), ("f3", ["source_path is null"])]
    edges = spark.createDataFrame([("c1", "c2", "follows", 2.0), ("c1", "zz", "follows", 1.0)], "from_chunk_id string, to_chunk_id string, relation_type string, weight double")
    chunks = spark.createDataFrame([("c1",), ("c2",)], "id string")
    assert rows(schemas.validate(edges, "chunk_relations", {"chunks": chunks}), "to_chunk_id") == [("c2",), ("zz",)]


def test_relations(spark):
    c = spark.createDataFrame([("a", "f", 0, None, "def foo(): pass"), ("b", "f", 1, "a", "x = foo(1)"), ("c", "g", 0, "a", "nothing")], "id string, file_id string, position bigint, parent_id string, content string")
    assert rows(relations.follows(c), "from_chunk_id", "to_chunk_id") == [("a", "b")]
    assert rows(relations.parent_of(c), "from_chunk_id", "to_chunk_id") == [("a", "b"), ("a", "c")]
    names = spark.createDataFrame([("a", "foo")], "id string, name string")
    assert rows(relations.calls(c, names), "from_chunk_id") == [("b",)] and rows(relations.references(c, names), "from_chunk_id") == [("b",)]
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.1]), (2, [1.0, 0.01, 0.1]), (3, [-1.0, 2.0, 0.0])], "chunk_id bigint, vector array<double>")
    assert rows(relations.similar_to(v), "from_chunk_id", "to_chunk_id") == [(1, 2)]


def test_stats_and_samples(spark):
    df = spark.createDataFrame([(i, i, "x" * (i + 1) if i != 3 else None) for i in range(10)] + [(99, 50, "y" * 500)], "id bigint, position bigint, content string")
    s = {r["column_name"]: r for r in metrics.stats(df).collect()}
    assert s["content"]["nulls"] == 1 and s["content"]["max"] == 500 and s["id"]["distinct"] == 11
    got = {r["sample_type"]: r["row_id"] for r in metrics.samples(df).collect()}
    assert got["first"] == 0 and got["last"] == 99 and got["outlier"] == 99
    assert metrics.samples(df.limit(0)).collect() == []


def test_run_views(spark):
    e = spark.createDataFrame([("r", 1, "a", 100, 45, 12, "t"), ("r", 2, "b", 45, 180, 523, None), ("r", 3, "c", 180, 420, 89, None), ("r", 4, "d", 420, 420, 1250, None)], "run_id string, step_order bigint, step_name string, rows_in bigint, rows_out bigint, duration_ms bigint, finished_at string")
    s = metrics.run_summary(spark.createDataFrame([("r",)], "run_id string"), e).first()
    assert (s["total_steps"], s["completed_steps"], s["total_duration_ms"], s["final_rows"]) == (4, 1, 1874, 420)
    p = metrics.step_progression(e, spark.createDataFrame([("r", 2, "expansion", 0.1)], "run_id string, step_to bigint, delta_type string, jaccard_index double"))
    assert [r["retention_pct"] for r in p.orderBy("step_order").collect()] == [45.0, 400.0, 233.33, 100.0]


def test_highlight(spark):
    r = spark.range(1).select(search.highlight(F.lit("The cat scattered cats"), ["cat"]).alias("h")).first()
    assert re.findall("<b>", r["h"]) == ["<b>"]
