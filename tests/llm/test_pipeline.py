"""The stages of the pipeline, each against brute force over what the stage before it kept."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import bpe, mixing, pii, quality
from tests.llm.test_contracts import brute_near, brute_pii


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    extra = [(90_001, None, "en", "src0", None), (90_002, "", "en", None, 0), (90_003, "mail me at x@y.org now " + " ".join(f"some{'abcdefgh'[i % 8]}{'stuvwxyz'[i // 8]}" for i in range(64)) + ".", "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    out = {"start": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = f(spark, docs, "").cache()
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "mask_pii", "mix_sources", "encode"]
    for n, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[n].columns == stages["start"].columns


def test_quality(stages):
    start = rows(stages["start"])
    counts = {}
    for r in start:
        v = quality.votes(quality.measure(r["text"]))
        counts[v] = counts.get(v, 0) + 1
    good = quality.posteriors(counts)
    want = {r["doc_id"] for r in start if not quality.base_failed(m := quality.measure(r["text"])) and good[quality.votes(m)] >= 0.5}
    assert {r["doc_id"] for r in rows(stages["quality_rules"])} == want and 90_003 in want and 90_001 not in want


def test_one_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in rows(stages["quality_rules"])]
    want = {d for d, c, _ in brute_near(before) if d == c}
    assert {r["doc_id"] for r in rows(stages["near_duplicates"])} == want < {d for d, _ in before}


def test_pii_is_masked(stages):
    before = {r["doc_id"]: r for r in rows(stages["near_duplicates"])}
    after = {r["doc_id"]: r for r in rows(stages["mask_pii"])}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not any(brute_pii(r["text"])[i] for i in (0, 2))
        if not any(brute_pii(before[k]["text"])) and "<CONTEXT>" not in r["text"]:
            assert r["text"] == before[k]["text"] and r["n_chars"] == before[k]["n_chars"]
        else:
            assert r["n_chars"] == len(r["text"])
    assert "mail me at <EMAIL> now" in after[90_003]["text"]


def test_redaction_of_overlaps(spark):
    spans = F.array(*[F.struct(F.lit(s).cast("long").alias("start"), F.lit(k).alias("kidx"), F.lit(e).cast("long").alias("end")) for s, k, e in ((2, 2, 6), (4, 3, 8), (9, 0, 10))])
    r = spark.range(1).select(pii.redact(F.lit("é23456789abc"), spans).alias("t")).first()
    assert r["t"] == "é2<CARD>9<EMAIL>bc" and re.sub("<[A-Z]+>", "", r["t"]) == "é29bc"


def test_mix_repeats_documents(stages):
    before, after = stages["mask_pii"], rows(stages["mix_sources"])
    copies = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(before))}
    for k, n in copies.items():
        assert sum(r["doc_id"] == k for r in after) == n
    assert len({r["text"] for r in after if r["doc_id"] == 90_003}) <= 1


def test_encode(stages):
    own = bpe.codec(open(bpe.default_path(), encoding="utf-8").read())
    got = rows(stages["encode"])
    assert len(got) == stages["mix_sources"].count()
    sizes = {r["doc_id"]: len(own.encode(r["text"])) for r in rows(stages["mix_sources"])}
    assert all(r["n_tokens"] == sizes[r["doc_id"]] for r in got)


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{i}_") for k in q) for i in range(1, 11))


def _words(w: str, n: int = 60) -> str:
    return " ".join(f"{w}{'abcdefgh'[i % 8]}{'stuvwxyz'[i // 8]}" for i in range(n)) + "."


@pytest.mark.parametrize("empty", [True, False])
def test_stages_with_clashing_columns_and_repeated_ids(spark, empty):
    clash = "size spans kept quality votes rid hash group target copies source_size n_words _size _text text_crc32 a.b".split()
    data = [] if empty else [(1, _words("some"), "en", "s", 1), (1, _words("other"), "en", "s", 1), (1, _words("other"), "en", "s", 1), (2, _words("other"), "en", None, 1), (None, _words("more"), "en", "t", None), (3, _words("mail") + " me@x.org", "en", "t", 1), (4, None, None, None, None), (5, " ", "en", "t", 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "").cache()
        got = rows(docs)
        if name != "encode":
            assert docs.schema == before.schema or [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
            assert docs.columns == before.columns and all(r[c] == f"own {c}" for r in got for c in clash)
        if empty:
            assert got == []
        elif name == "near_duplicates":
            assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in got) == [(0, "more"), (1, "othe"), (1, "some"), (3, "mail")]
        elif name == "mask_pii":
            assert [r["text"][-7:] for r in got if r["doc_id"] == 3] == ["<EMAIL>"]
