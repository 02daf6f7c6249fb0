"""Writing runs into the corpus: insert-or-ignore, insert-or-replace, status updates. Plain Parquet has no MERGE, so these are
anti joins and unions; staged output replaces a table by one rename."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import schemas


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], name: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Old rows stay; of new rows the first of each key that old hasn't. Rows that break the table's row rules are left out."""
    if name:
        new = new.where(F.size(schemas.row_faults(new, name)) == 0)
    rest = [c for c in new.columns if c not in key]
    lead = order or []
    first = new.groupBy(*key).agg(F.min(F.struct(*lead, *[c for c in rest if c not in lead])).alias("_r"))
    fresh = first.select(*key, "_r.*").select(*new.columns).join(old.select(*key), key, "left_anti").select(*new.columns)
    return old.unionByName(fresh, allowMissingColumns=True)


def insert_replace(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes last in order among the new ones, else the old row."""
    rest = [c for c in new.columns if c not in key and c not in order]
    last = new.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*key, "_r.*")
    last = last.select(*[c for c in new.columns if c in old.columns or c in key])
    return old.join(last.select(*key), key, "left_anti").select(*old.columns).unionByName(last.select(*[c for c in old.columns if c in last.columns]), allowMissingColumns=True)


def set_status(files: DataFrame, done: DataFrame, status: str = "vectorized", key: str = "id", by: str = "file_id") -> DataFrame:
    """Files that produced output get a status."""
    hit = done.select(F.col(by).alias(key)).distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit").select(*files.columns)
