"""Sessions: what the engine expects of one, for local work. On a cluster the submitter's settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: int | str = "*", name: str = "corpusmill", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution, as many shuffle partitions as cores."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
