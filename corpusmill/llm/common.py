"""What the operators of this subpackage share: shared storage, words, spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch. Texts are long, and a batch is held by the JVM and by Python at once.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH rows in this session from here on; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns renamed by position, so that none can clash with ours, and the new name of each."""
    names = [f"_in{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def whole_key(key: Column, kind: str) -> Column:
    """A key as a long: whole numbers as they are, other texts by their hash; null stays."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return key.cast("long")
    text = key.cast("string")
    return F.coalesce(F.when(text.rlike("^-?[0-9]{1,19}$"), text.try_cast("long")), F.when(text.isNotNull(), F.xxhash64(text)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may lack it, and gets a folder of
    our own (tests); on a cluster, where nothing else is shared, its lack is an error."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusmill.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("corpusmill.shared.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: ends the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    if _OPEN:
        _OPEN[-1].append(back)
    return back


_OPEN: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What cut() writes in this block is deleted at its end, but for the frames that are passed through the function it gives.

    Frames that were made from what is deleted must have been written themselves by then."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _OPEN.append([])
    try:
        yield keep
    finally:
        for df in _OPEN.pop():
            if not any(df is k for k in kept):
                discard(df)
            elif _OPEN:
                _OPEN[-1].append(df)


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it: an expression inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_starts(lens: Column) -> Column:
    """Prefix sums (exclusive) of an array of longs, in blocks of 64 so that long arrays stay far from quadratic cost.

    lens should be bound."""
    step = 64
    n_blocks = F.ceil(F.size(lens) / F.lit(step)).cast("int")
    none = F.array().cast("array<bigint>")

    def block(b: Column) -> Column:
        return F.slice(lens, b * step + 1, step)

    def fold(xs: Column, base: Column) -> Column:
        zero = F.struct(base.alias("p"), none.alias("o"))
        return F.aggregate(xs, zero, lambda s, x: F.struct((s["p"] + x).alias("p"), F.concat(s["o"], F.array(s["p"])).alias("o")), lambda s: s["o"])

    sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda a, x: a + x))
    both = F.arrays_zip(F.sequence(F.lit(0), n_blocks - 1).alias("b"), fold(sums, F.lit(0).cast("long")).alias("base"))
    return F.when(F.size(lens) == 0, none).otherwise(F.flatten(F.transform(both, lambda z: fold(block(z["b"]), z["base"]))))


SPAN = "array<struct<start:bigint,kidx:int,end:bigint,val:string>>"


def match_spans(text: Column, pattern: str, kidx: int, guard: Column, keep) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, kidx, end, val), code points, end exclusive; keep() judges each value.

    guard: a cheap test that is true for every text with a match that keep() passes."""
    pieces = F.split(text, pattern, -1)

    def gaps_of(found: Column) -> Column:
        return F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("val")))

    def placed(gaps: Column) -> Column:
        starts = bind(F.transform(gaps, lambda g: g["gap"] + g["len"]), running_starts)
        return F.zip_with(gaps, starts, lambda g, s: F.struct((s + g["gap"]).alias("start"), F.lit(kidx).alias("kidx"), (s + g["gap"] + g["len"]).alias("end"), g["val"].alias("val")))

    spans = bind(bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps_of), placed)
    return F.when(guard, F.filter(spans, lambda s: keep(s["val"]))).otherwise(F.array().cast(SPAN)).cast(SPAN)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of spans, by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kidx"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kidx: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kidx"] == kidx)).cast("long")


#: What is broadcast: so many rows at most, and so many bytes by the planner's estimate of what is read for them.
MOST_ROWS, MOST_BYTES = 200_000, 128 * 2**20


def small(df: DataFrame, rows: int, limit: int = MOST_ROWS) -> DataFrame:
    """Ask for a broadcast if the counted rows and the estimated bytes stay under limits; else leave the join to the planner."""
    if rows > limit or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > MOST_BYTES:
        return df
    return F.broadcast(df)
