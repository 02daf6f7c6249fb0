"""Queries over all rows, against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import queries
from corpusmill.operators import relations
from tests.conftest import SF


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_references_to_all_names(spark):
    parts = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    words = {k: set(re.findall(r"[^\W\d]\w*", t)) for k, t in parts.items()}
    names = {k: re.match(r"\w*", t)[0] for k, t in parts.items()}
    want = {(a, b) for a in parts for b in parts if a != b and names[b] in words[a]}
    got = rows(queries.QUERIES["relations_references"](spark, SF), "from_chunk_id", "to_chunk_id")
    assert len(got) == len(want) and set(got) == want and any(b % 20 for _, b in want)


def test_whole_inputs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    vectors = {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    run = lambda name: queries.QUERIES[name](spark, SF)
    marked = {r["doc_id"]: r["marked"] for r in run("highlight").collect()}
    assert marked == {k: t if t is None else hashlib.sha256(re.sub(r"(?i)(?<![^\W_])(the|and)(?![^\W_])", r"<b>\1</b>", t).encode()).hexdigest() for k, t in texts.items()}
    assert {r["chunk_id"]: r["layers"] for r in run("layers_pivot").collect()} == {k: 1 if k % 3 == 0 else 2 for k in vectors}
    blended = {(r["chunk_id"], r["idx"]): r["value"] for r in run("blend_vectors").collect()}
    for k, v in vectors.items():
        b = v if k % 3 == 0 else [x * 0.6 + y * 0.4 for x, y in zip(v, reversed(v))]
        norm = sum(x * x for x in b) ** 0.5
        assert all(abs(blended.get((k, i), 0.0) - x / norm) < 2e-6 for i, x in enumerate(b))
    want = set()
    for k, t in texts.items():
        page, position, held = 1, 0, []
        for line in [*(t or "").split("\n"), ""]:
            u = line.strip(" \t\r")
            mark = re.match(r"(?i)page\s+[0-9]+", u)
            if u and not mark:
                held.append(u)
                continue
            if held:
                want.add((str(k), position, hashlib.sha256(" ".join(held).encode()).hexdigest(), page))
                position, held = position + 1, []
            page += bool(mark)
    got = [(str(r["file_id"]), r["position"], r["hash"], r["page"]) for r in run("extract_pdf_text").collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_similar_pairs_are_recalled(spark, threshold):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(400, 16))
    side = rnd.normal(size=v.shape)
    side -= v * (side * v).sum(1, keepdims=True) / (v * v).sum(1, keepdims=True)
    c = threshold + 0.01
    near = c * v / np.linalg.norm(v, axis=1, keepdims=True) + (1 - c * c) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
    x = np.vstack([v, near])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(unit @ unit.T, 1) >= threshold)}
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "chunk_id bigint, vector array<double>")
    got = rows(relations.similar_to(df, threshold), "from_chunk_id", "to_chunk_id")
    assert len(want) >= 400 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)


def test_similar_to_is_registered(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in e], np.array([r["embedding"] for r in e], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in np.argwhere(np.triu(unit @ unit.T, 1) >= 0.9)}
    got = set(rows(queries.QUERIES["relations_similar_to"](spark, SF), "from_chunk_id", "to_chunk_id"))
    print("recall", len(got & want), len(want))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_similar_copies_stand_under_one_id(spark):
    v = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [0.99, 0.0, 0.11], [0.0, 0.0, 0.0]]
    data = [(i * 10 + j, v[i]) for i in range(4) for j in range(3)]
    got = rows(relations.similar_to(spark.createDataFrame(data, "chunk_id bigint, vector array<double>"), 0.9), "from_chunk_id", "to_chunk_id")
    assert got == [(0, 1), (0, 2), (0, 20), (10, 11), (10, 12), (20, 21), (20, 22)]


def test_xxhash(spark):
    xxhash = pytest.importorskip("xxhash")
    got = {r["doc_id"]: r["hash"] for r in queries.QUERIES["hash_xxhash"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {k: xxhash.xxh64_hexdigest(f"{k}\x1f{t or ''}".encode(), seed=42) for k, t in texts.items()}


def test_html_blocks(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        lines, at, blocks = (r["html"] or "").split("\n"), 0, []
        while at < len(lines):
            kinds = [k for k in ("script", "style", "template") if re.search(f"(?i)<{k}[^>]*>", lines[at])]
            if kinds:
                end = next((j for j in range(at + 1, len(lines)) if f"</{kinds[0]}>" in lines[j].lower()), None)
                if end is None:
                    break
                blocks.append((kinds[0], at + 1, end + 1))
                at = end
            at += 1
        for i, (k, a, b) in enumerate(blocks or [("document", 1, len(lines))]):
            want.add((str(r["page_id"]), i, hashlib.sha256("\n".join(lines[a - 1 : b]).encode()).hexdigest()[:32], k, a, b))
    got = queries.QUERIES["extract_html"](spark, SF).select("file_id", "position", "id", "kind", "line_start", "line_end").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_compaction_where_every_bucket_is_replaced(spark, tmp_path):
    ids = [*range(-2500, 2500), 2**40, 2**40 + 1, None]
    spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["corpus_compact"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("chunk_relations", len(ids), 1, True)]
    got = {(r["from_chunk_id"], r["weight"]) for r in queries.QUERIES["corpus_replace"](spark, str(tmp_path)).collect()}
    assert got == {(None if i is None else str(i), 1.0 if i is not None and i % 5 == 0 else 0.5) for i in ids}


def test_references_are_made_once_and_by_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(relations, "BLOCK", 16, raising=False)
    monkeypatch.setattr(relations, "TASK_PAIRS", 500, raising=False)
    rnd = np.random.default_rng(3)
    some = lambda: " ".join(f"w{i}" for i in rnd.integers(0, 12, 2))
    texts = [(i, some()) for i in range(300)] + [(i, some()) for i in range(40)] + [(None, "w1"), (7, None)]  # ids come again
    names = [(int(i), f"w{n}") for i, n in zip(rnd.integers(0, 250, 350), rnd.integers(0, 9, 350))] + [(None, "w1"), (3, None), (4, ""), (5, "other")]
    want = {(a, b) for a, t in texts for b, n in names if None not in (a, b, t, n) and a != b and n in t.split()}
    df = relations.references(spark.createDataFrame(texts, "id bigint, content string"), spark.createDataFrame(names, "id bigint, name string"))
    got = rows(df, "from_chunk_id", "to_chunk_id")
    assert len(got) == len(want) and set(got) == want and len(want) > 5000
    shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 8 and max(shares) < len(got) / 4
    after = df._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert after.count("Generate") == 2 and "Aggregate" not in after  # pairs aren't shuffled
