"""The corpus: tables as immutable parts, and manifests that say which parts count.

A part is a folder with the rows of one write, by buckets of the table's key. A manifest names, for every table, its parts and
which of their buckets are alive; the newest one holds, and it is put in place by one rename, so that what is committed together
is seen together, whatever the number of tables. Appending adds a part; replacing rewrites only the buckets in which keys are
replaced. Readers of an older manifest keep their parts until vacuum()."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas

BUCKETS = 64


def hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(time, name) of the folders under a path, oldest first."""
    fs, at = hadoop(spark, path)
    return sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename, or raise: file systems also answer with false."""
    fs, at = hadoop(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to):
        raise FileExistsError(target)
    if not fs.rename(at, to):
        raise OSError(f"{source} can't be renamed to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by a rename."""
    fs, at = hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename(spark, at.toString(), path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


class Corpus:
    """Corpus tables under a folder. changes: dicts of table to parts, to be committed together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.attached: dict[str, Corpus] = {}

    # ------------------------------------------------------------------ manifests

    def _manifests(self) -> list[int]:
        fs, at = hadoop(self.spark, f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> tuple[int, dict[str, list[dict]]]:
        """Number and content of the newest manifest: table to parts {part, buckets, docs, words}."""
        found = self._manifests()
        return (found[-1], json.loads(read_text(self.spark, f"{self.path}/_manifests/{found[-1]:012d}.json"))) if found else (0, {})

    def commit(self, changes: dict[str, list[dict]]) -> int:
        """All changed tables at once. FileExistsError if another writer was faster."""
        n, now = self.manifest()
        write_text(self.spark, f"{self.path}/_manifests/{n + 1:012d}.json", json.dumps(now | changes))
        return n + 1

    # ------------------------------------------------------------------ reading

    def attach(self, alias: str, path: str) -> None:
        """Another corpus under an alias: read("alias.table"). An alias that is taken: ValueError."""
        if alias in self.attached:
            raise ValueError(f"{alias} is attached already")
        self.attached[alias] = Corpus(self.spark, path)

    def detach(self, alias: str) -> None:
        del self.attached[alias]

    def exists(self, table: str) -> bool:
        return bool(self.manifest()[1].get(table))

    def _load(self, table: str, parts: list[dict], buckets: list[int] | None = None) -> DataFrame:
        ddl = schemas.TABLES[table].ddl
        paths = [f"{self.path}/{table}/{p['part']}/_b={b}" for p in parts for b in p["buckets"] if buckets is None or b in buckets]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def read(self, table: str, keys: list | None = None) -> DataFrame:
        """A table; with keys (of a table whose key has one column) only the buckets that may hold them."""
        alias, _, name = table.rpartition(".")
        if alias in self.attached:
            return self.attached[alias].read(name, keys)
        return self._load(name, self.manifest()[1].get(name, []), None if keys is None else self._buckets_of(name, keys))

    def _buckets_of(self, table: str, keys: list) -> list[int]:
        c = self._key(table)[0]
        return [r["b"] for r in self.spark.createDataFrame([(k,) for k in keys], f"{c} string").select(bucket([c]).alias("b")).distinct().collect()]

    @staticmethod
    def _key(table: str) -> list[str]:
        key = list(schemas.TABLES[table].key)
        return key[:1] if table == "chunk_postings" else key

    # ------------------------------------------------------------------ writing

    def stage(self, table: str, df: DataFrame) -> dict:
        """Write rows as a part of their own, seen by no one until it is committed."""
        part = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:12]}"
        keyed = schemas.align(df, table).withColumn("_b", bucket(self._key(table)) if self._key(table) else F.lit(0))
        keyed.hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{self.path}/{table}/{part}")
        return {"part": part, "buckets": [int(n[3:]) for _, n in folders(self.spark, f"{self.path}/{table}/{part}") if n.startswith("_b=")]}

    def parts(self, table: str) -> list[dict]:
        return self.manifest()[1].get(table, [])

    def appended(self, table: str, df: DataFrame, **facts) -> list[dict]:
        return [p for p in [*self.parts(table), self.stage(table, df) | facts] if p["buckets"]]

    def replaced(self, table: str, new: DataFrame) -> list[dict]:
        """Parts of the table after rows with the keys of new are replaced by new (whose keys are unique). Buckets without a
        replaced key are left as they are."""
        key, old = self._key(table), self.parts(table)
        new = schemas.align(new, table)
        held = self._load(table, old)
        hit = [r["b"] for r in new.select(*key).join(held.select(*key), key, "left_semi").select(bucket(key).alias("b")).distinct().collect()]  # at most BUCKETS
        if hit:
            stay = self._load(table, old, hit).join(new.select(*key), key, "left_anti").select(*new.columns)
            old = [p | {"buckets": [b for b in p["buckets"] if b not in hit]} for p in old]
            new = new.unionByName(stay)
        return [p for p in [*old, self.stage(table, new)] if p["buckets"]]

    def write(self, table: str, df: DataFrame) -> None:
        """The whole table anew."""
        self.commit({table: [self.stage(table, df)]})

    def append(self, table: str, df: DataFrame) -> None:
        self.commit({table: self.appended(table, df)})

    def replace(self, table: str, df: DataFrame) -> None:
        self.commit({table: self.replaced(table, df)})

    # ------------------------------------------------------------------ settings, maintenance

    def get_config(self, name: str) -> str:
        """A setting, or its default; KeyError if there is neither."""
        row = self.read("config").where(F.col("key") == name).first()
        return row["value"] if row else schemas.CONFIG[name]

    def set_config(self, name: str, value: str) -> None:
        self.replace("config", self.spark.createDataFrame([(name, str(value))], schemas.TABLES["config"].ddl))

    def config(self) -> DataFrame:
        """All settings: those set, and the defaults of the others."""
        defaults = self.spark.createDataFrame(sorted(schemas.CONFIG.items()), "key string, value string")
        own = self.read("config").select("key", "value")
        return own.unionByName(defaults.join(own, "key", "left_anti"))

    def compact(self, table: str) -> None:
        """All parts of a table as one."""
        parts = self.parts(table)
        if len(parts) > 1:
            facts = {k: sum(p.get(k, 0) for p in parts) for k in ("docs", "words") if any(k in p for p in parts)}
            self.commit({table: [self.stage(table, self._load(table, parts)) | facts]})

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the newest ones, and parts that none of those names; how many parts. No writer may be at work."""
        found = self._manifests()
        kept = found[-max(1, keep) :]
        named = {(t, p["part"]) for n in kept for t, ps in json.loads(read_text(self.spark, f"{self.path}/_manifests/{n:012d}.json")).items() for p in ps}
        gone = [(t, p) for _, t in folders(self.spark, self.path) if t in schemas.TABLES for _, p in folders(self.spark, f"{self.path}/{t}") if (t, p) not in named]
        for t, p in gone:
            fs, at = hadoop(self.spark, f"{self.path}/{t}/{p}")
            fs.delete(at, True)
        for n in found[: -len(kept)] if kept else []:
            fs, at = hadoop(self.spark, f"{self.path}/_manifests/{n:012d}.json")
            fs.delete(at, False)
        return len(gone)

    def stats(self) -> DataFrame:
        """(table, rows, parts, bytes) of the tables that have parts."""
        out = []
        for t, ps in sorted(self.manifest()[1].items()):
            size = 0
            for p in ps:
                fs, at = hadoop(self.spark, f"{self.path}/{t}/{p['part']}")
                size += fs.getContentSummary(at).getLength()
            out.append(self._load(t, ps).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows", F.lit(len(ps)).cast("bigint").alias("parts"), F.lit(size).cast("bigint").alias("bytes")))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "table string, rows bigint, parts bigint, bytes bigint")

    def text_stats(self) -> tuple[int, float]:
        """Number of indexed chunks and their mean length in words, from the manifest."""
        ps = self.parts("chunk_postings")
        docs, words = sum(p.get("docs", 0) for p in ps), sum(p.get("words", 0) for p in ps)
        return docs, words / docs if docs else 1.0


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; where it is unset, a local session gets one of
    the machine's own, and another session an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return f"{at.rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"
