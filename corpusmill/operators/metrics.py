"""Run metrics: step log, deltas, statistics, samples, summary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_summary(meta: DataFrame, executions: DataFrame) -> DataFrame:
    """One row a run: steps, steps finished, total duration, rows of the last step."""
    e = executions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count("finished_at").alias("completed_steps"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.max_by("rows_out", "step_order").alias("final_rows"),
    )
    return meta.join(e, "run_id", "left")


def step_progression(executions: DataFrame, deltas: DataFrame) -> DataFrame:
    """Steps with what share of rows they kept (percent, two digits) and the delta that leads to them."""
    kept = F.round(F.lit(100.0).cast("double") * F.col("rows_out") / F.nullif(F.col("rows_in").cast("double"), F.lit(0.0)), 2)
    d = deltas.select("run_id", F.col("step_to").alias("step_order"), "delta_type", "jaccard_index")
    return executions.select("run_id", "step_order", "step_name", "rows_in", "rows_out", kept.alias("retention_pct"), "duration_ms").join(d, ["run_id", "step_order"], "left")


def stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row a column: rows, nulls, distinct values, and of numbers min, max, mean and standard deviation, of texts lengths.
    Distinct values are counted by two hashes of 64 bits, so that no text is carried along; approximate: by a sketch in one pass."""
    aggs, parts = [F.count(F.lit(1)).alias("_n")], []
    for i, (c, kind) in enumerate(df.dtypes):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n{i}"))
        scalar = not kind.startswith(("array", "map", "struct"))
        aggs.append((F.approx_count_distinct(c) if approximate else F.count_distinct(F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))) if kind == "string" else F.col(c))).alias(f"d{i}") if scalar else F.lit(None).cast("bigint").alias(f"d{i}"))
        value = F.length(c) if kind == "string" else F.col(c).cast("double") if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal") else F.lit(None).cast("double")
        aggs += [F.min(value).cast("double").alias(f"lo{i}"), F.max(value).cast("double").alias(f"hi{i}"), F.avg(value).alias(f"av{i}"), F.stddev_samp(value).alias(f"sd{i}")]
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("type"), F.col("_n").alias("row_count"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"av{i}").alias("mean"), F.col(f"sd{i}").alias("std")))
    return df.agg(*aggs).select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def samples(df: DataFrame, key: str = "id", order: str = "position", text: str = "content") -> DataFrame:
    """First, last, a random (smallest SHA-256 of the key) and an outlier row (length furthest from the mean in standard
    deviations), ties by key: four partial aggregates, without a sort."""
    size = F.length(text).cast("double")
    row = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("c"), size.alias("size"))
    m = row.agg(F.avg("size").alias("mean"), F.stddev_samp("size").alias("sd"))
    row = row.join(F.broadcast(m)).withColumn("z", F.coalesce(F.abs(F.col("size") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)))  # m is one row
    one = row.agg(
        F.min_by(F.struct("k", "c"), F.struct("o", "k")).alias("first"),
        F.max_by(F.struct("k", "c"), F.struct("o", "k")).alias("last"),
        F.min_by(F.struct("k", "c"), F.struct(F.sha2(F.col("k").cast("string"), 256), F.col("k"))).alias("random"),
        F.min_by(F.struct("k", "c"), F.struct(-F.round("z", 6), F.col("k"))).alias("outlier"),
    )
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("sample_type"), F.col(n)["k"].alias("row_id"), F.col(n)["c"].alias("content")) for n in ("first", "last", "random", "outlier")])).alias("s"))
    return out.select("s.*").where("row_id is not null")


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as by a heartbeat table: a partial maximum, not a window."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, "_r.*").select(*df.columns)


def fifo(df: DataFrame, zone: str, order: list[str]) -> DataFrame:
    """The oldest row of each zone."""
    rest = [c for c in df.columns if c not in (zone, *order)]
    return df.groupBy(zone).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(zone, "_r.*").select(*df.columns)


def rank_steps(executions: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy(F.desc("duration_ms"), "step_order")
    return executions.withColumn("slowest", F.row_number().over(w).cast("bigint"))
