"""Integrity manifests: SHA-256 of files, a hash of the hashes, and what differs from a stored manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.corpus import Corpus


def scan(spark: SparkSession, path: str, process: str, kind: str = "source", pattern: str = "*") -> DataFrame:
    """(process, path, kind, sha256, at) of the files under a folder, hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.lit(process).alias("process"), "path", F.lit(kind).alias("kind"), F.sha2("content", 256).alias("sha256"), F.unix_timestamp().alias("at"))


def total(manifest: DataFrame) -> DataFrame:
    """(process, total): SHA-256 of the hashes one after the other, sources before databases, by path."""
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "source", 0).otherwise(1).alias("k"), "path", "sha256")))
    return manifest.groupBy("process").agg(order.alias("h")).select("process", F.sha2(F.array_join(F.transform("h", lambda x: x["sha256"]), ""), 256).alias("total"))


def verify(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, fault): files that are missing, new or changed."""
    a, b = stored.select("path", F.col("sha256").alias("was")), found.select("path", F.col("sha256").alias("now"))
    both = a.join(b, "path", "full")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def store(corpus: Corpus, found: DataFrame) -> None:
    """Replace the stored files of each process that is in found."""
    kept = corpus.read("manifests").join(found.select("process").distinct(), "process", "left_anti")
    corpus.write("manifests", kept.unionByName(found, allowMissingColumns=True))


def load(corpus: Corpus, process: str) -> DataFrame:
    return corpus.read("manifests").where(F.col("process") == process)
