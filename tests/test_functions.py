"""Expressions against their published or plain definitions."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vc


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_fnv_vectors(spark):
    words = ["", "a", "foobar", "é", "日本"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(tx.fnv(F.col("w")).alias("a"), tx.fnv(F.col("w"), False).alias("b"))
    assert [(r["a"], r["b"]) for r in df.collect()] == [(tx.fnv_python(w), tx.fnv_python(w, False)) for w in words]
    assert tx.fnv_python("a") == 0xE40C292C and tx.fnv_python("foobar") == 0xBF9CF968 and tx.fnv_python("a", False) == 0x050C5D7E


def test_tokens_and_ngrams(spark):
    r = one(spark, t=tx.tokens(F.lit("The Ärger, x2 — no_way!")), none=tx.ngrams(tx.tokens(F.lit("one")), 2), two=tx.ngrams(tx.tokens(F.lit("a b c")), 2))
    assert r["t"] == ["the", "ärger", "x2", "no", "way"] and r["none"] == [] and r["two"] == ["a_b", "b_c"]


def test_mime(spark):
    cases = {"/a/b.PDF": ("application/pdf", ""), "/a.b/c": ("application/octet-stream", ""), "x.go": ("text/x-go", ""), "noext": ("application/pdf", "25504446"), "arch": ("application/zip", "504B0304")}
    df = spark.createDataFrame([(k, v[1]) for k, v in cases.items()], "p string, h string").select(tx.mime_type(F.col("p"), F.col("h")).alias("m"))
    assert [r["m"] for r in df.collect()] == [v[0] for v in cases.values()]


def test_vector_edge_cases(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ([3, 4], [4, 3], [0, 0]))
    c = F.array(F.lit(1.0))
    r = one(spark, n=vc.norm(a), u=vc.normalize(a), uz=vc.normalize(z), d=vc.dot(a, b), dm=vc.dot(a, c), cs=vc.cosine(a, b), cz=vc.cosine(a, z), cm=vc.cosine(a, c), add=vc.add(a, b), addm=vc.add(a, c), sc=vc.scale(a, 2.0), zero=vc.zero(3))
    assert (r["n"], r["u"], r["uz"], r["d"], r["dm"], r["cz"], r["cm"]) == (5.0, [0.6, 0.8], [0.0, 0.0], 24.0, 0.0, 0.0, 0.0)
    assert math.isclose(r["cs"], 0.96) and r["add"] == [7.0, 7.0] and r["addm"] == [3.0, 4.0] and r["sc"] == [6.0, 8.0] and r["zero"] == [0.0] * 3


def test_blend(spark):
    a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ([1, 0], [0, 1]))
    none = F.lit(None).cast("array<double>")
    r = one(spark, both=vc.blend({"s": a, "l": b}, {"s": 0.5, "l": 0.5}, 2), one=vc.blend({"s": a, "l": none}, {"s": 0.2, "l": 0.8}, 2), no=vc.blend({"s": none, "l": none}, {}, 2))
    assert [round(x, 6) for x in r["both"]] == [0.707107] * 2 and r["one"] == [1.0, 0.0] and r["no"] == [0.0, 0.0]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_cosine_is_symmetric_and_bounded(seed):
    from pyspark.sql import SparkSession

    spark, rnd = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), random.Random(seed)
    rows = [([rnd.gauss(0, 1) for _ in range(8)], [rnd.gauss(0, 1) for _ in range(8)]) for _ in range(10)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").select(vc.cosine(F.col("a"), F.col("b")).alias("x"), vc.cosine(F.col("b"), F.col("a")).alias("y"), vc.norm(vc.normalize(F.col("a"))).alias("n"))
    for r in df.collect():
        assert abs(r["x"] - r["y"]) < 1e-12 and -1 - 1e-9 <= r["x"] <= 1 + 1e-9 and r["n"] <= 1 + 1e-9


def test_feature_traps(spark):
    df = spark.createDataFrame([("if a\nif b 12",)], "content string")
    go, pdf = (df.selectExpr(*[f"{e} as {n}" for n, e in ft.features(k).items()]).first() for k in ("go", "pdf"))
    assert go["complexity"] == 6 and go["line_count"] == 2 and go["has_func"] == 0  # three characters for each 'if '
    assert pdf["uppercase_ratio"] == 0 and round(pdf["digit_ratio"], 4) == round(10 / 12, 4)  # the share of what is no digit
    assert set(ft.features("docx")) == {"token_count", "heading_depth", "section_length", "list_density", "has_code", "formatting_density"}
