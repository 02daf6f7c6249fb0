"""Where queries and their SQL are kept, and what they all read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def contents(spark: SparkSession, d: str) -> DataFrame:
    """documents as (id, content)."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


CONTENTS = "(SELECT doc_id AS id, text AS content FROM documents)"
