"""The corpus pipeline: quality rules, one of each near-duplicate group, PII masked, sources mixed to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, mixing, neardup, pii, quality
from corpusmill.llm.common import aside, cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and blank texts among them; equal texts stay or go together. Empty: empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; different texts under one id are told apart; null and blank
    texts are in no group and stay. Empty: empty."""
    return neardup.keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows. Null texts stay null; every row stays. Empty: empty."""
    own, name = aside(docs)
    text, n = name["text"], name["n_chars"]
    found = pii.find(own, text, tuple(own.columns))
    masked = found.withColumn(text, F.when(F.col(text).isNotNull(), pii.redact(F.col(text), F.col("spans"))))
    masked = masked.withColumn(n, F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return masked.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets. Texts without words weigh nothing, and are
    repeated as their source is; ties go by the whole row, so that reruns agree. Empty: empty."""
    own, name = aside(docs)
    mixed = mixing.emit(mixing.mix(own, name["doc_id"], name["text"], name["source"]))
    return mixed.select(*[F.col(name[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and digests of what is left; a null text is an empty one. Empty: empty."""
    return bpe.encode(docs, with_ids=False)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mask_pii", mask_pii), ("mix_sources", mix_sources), ("encode", encode)]

#: EM, MinHash clusters and BPE aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
