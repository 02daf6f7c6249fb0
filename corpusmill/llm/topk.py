"""Exact top-k search by distributed histogram selection (operator 8).

Queries go in blocks of a bounded size. For each block, every candidate is scored by matrix products; partitions return
histograms of the scores inside the range that still holds the kth value, the counts are added up, and the range shrinks to
one bin until it is one integer wide. A last pass returns what lies above the kth value and, of what equals it, as many of
the smallest ids as are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, table, whole_key

#: Queries of a block, candidates of one matrix product, bins of a histogram; scores end at so much, either way.
BLOCK, CHUNK, BINS, MOST = 4096, 512, 256, 2**61


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.select(whole_key(F.col(key), df.schema[key].dataType.simpleString()).alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)


def _whole(x: Column, scale: float) -> Column:
    """floor(scale * x) as a double; from 2**53 on, every double is whole."""
    y = x.cast("double") * scale
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def _matrix(column: pa.Array, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: their places and their integers."""
    sizes = np.diff(column.offsets.to_numpy())
    values, first = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    out = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        rows = values[first[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        out.append((at, np.floor(scale * rows)))
    return out


class _Block:
    """Queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.q = ids[order], q[order]
        bound = np.minimum(np.floor(np.sqrt((self.q**2).sum(1)) * reach * (1 + 1e-9)), MOST).astype(np.int64) + 1
        self.low, self.width = -bound, np.maximum(1, -(-(2 * bound + 1) // BINS))
        self.span = 2 * bound + 1  # the range is low, ..., low + span - 1
        self.above = np.zeros(len(ids), np.int64)  # candidates above the range
        self.all = np.zeros(len(ids), bool)  # fewer candidates than k


def _scores(block: _Block, ids: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, scores (query by candidate) and where the candidate isn't the query itself. Exact: sums stay under 2**53, or go by integers."""
    exact = (np.abs(block.q).max(initial=0) * np.abs(c).max(initial=0) * max(1, c.shape[1])) < 2**53
    for i in range(0, len(ids), CHUNK):
        part, own = c[i : i + CHUNK], ids[i : i + CHUNK]
        s = (block.q @ part.T).astype(np.int64) if exact else _long_scores(block.q, part)
        yield own, s, block.ids[:, None] != own[None, :]


def _long_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products by Python's integers, within MOST."""
    s = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in c], object).reshape(c.shape).T
    return np.clip(s, -MOST, MOST).astype(np.int64)


def _select(candidates: DataFrame, block: _Block, k: int, scale: float) -> DataFrame:
    spark = candidates.sparkSession
    d = block.q.shape[1]

    def own(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = b.column(0).to_numpy()
        yield from ((ids[at], rows) for at, rows in _matrix(b.column(1), scale) if rows.shape[1] == d)

    while True:
        sent = spark.sparkContext.broadcast(block)

        def histogram(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x = sent.value
            n = len(x.ids)
            counts = np.zeros(n * BINS, np.int64)
            for b in batches:
                for ids, rows in own(b):
                    for _, s, other in _scores(x, ids, rows):
                        bins = (s - x.low[:, None]) // x.width[:, None]
                        ok = other & (bins >= 0) & (s < (x.low + x.span)[:, None])
                        counts += np.bincount((bins + np.arange(n)[:, None] * BINS)[ok], minlength=n * BINS)
            counts = counts.reshape(n, BINS)
            over = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts  # of this partition alone, above each bin
            q, bins = np.nonzero((counts > 0) & (over < k))  # lower bins can't hold the kth
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts[q, bins], pa.int64())], ["q", "bin", "n"])

        told = candidates.mapInArrow(histogram, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        told = told.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        need = spark.createDataFrame([(i, int(k - a)) for i, a in enumerate(block.above)], "q int, need bigint")
        told = told.join(F.broadcast(need), "q").groupBy("q").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("n")).alias("over")))).alias("hit"))  # a block has at most BLOCK queries
        hit = {r["q"]: r["hit"] for r in told.collect() if r["hit"] is not None}
        done = True
        for i in range(len(block.ids)):
            if block.all[i]:
                continue
            if i not in hit:  # fewer candidates than k: take them all
                block.all[i], block.low[i], block.span[i], block.width[i] = True, np.iinfo(np.int64).min // 4, 0, 1
                continue
            block.above[i] += hit[i]["over"]
            block.low[i] += hit[i]["bin"] * block.width[i]
            block.span[i] = block.width[i]
            if block.width[i] > 1:
                block.width[i] = -(-block.width[i] // BINS)
                done = False
        sent.unpersist()
        if done:
            break
    last = spark.sparkContext.broadcast((block, k - block.above))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ties = last.value
        held: list[np.ndarray] = []
        for b in batches:
            for ids, rows in own(b):
                for part, s, other in _scores(x, ids, rows):
                    q, c = np.nonzero(other & (s > x.low[:, None]))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(x.ids[q]), pa.array(part[c]), pa.array(s[q, c])], ["query_id", "vec_id", "score"])
                    q, c = np.nonzero(other & (s == x.low[:, None]))
                    if len(q):
                        held.append(np.stack([q, part[c], s[q, c]], 1))
            if len(held) > 1:
                held = [_fewest(np.concatenate(held), ties)]
        if held:
            rest = _fewest(np.concatenate(held), ties)
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[rest[:, 0]]), pa.array(rest[:, 1]), pa.array(rest[:, 2])], ["query_id", "vec_id", "score"])

    found = candidates.mapInArrow(pick, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fewest(rows: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Of each query, as many of the smallest ids as ties allows."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - first < ties[rows[:, 0]]]


def top_k(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of the highest integer inner product, ties to smaller ids.

    A row isn't a candidate for a query of its own id. Null ids, null vectors and vectors with null or non-finite components
    take no part; vectors are only compared with those of equal length. A query id that several rows have counts once, with
    the smallest vector; as candidates, repeated rows all count. Keys that are no whole numbers count as their hash. Scores
    beyond 2**61 count as that, either way. Other columns are ignored. Empty table: empty result.
    """
    spark = df.sparkSession
    usable = _usable(df, key, vector)
    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    norms = usable.groupBy(F.size("v").alias("d")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + _whole(x, scale) * _whole(x, scale))).alias("m"))
    reach = {r["d"]: r["m"] ** 0.5 for r in norms.collect()}
    n = queries.count()
    parts = -(-n // BLOCK)
    out = []
    for p in range(parts):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).toArrow().combine_chunks()
        ids = own.column(0).to_numpy()
        column = own.column(1).combine_chunks()
        for at, q in _matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, scale):
            found = _select(usable, _Block(ids[at], q, reach[q.shape[1]]), k, scale)
            out.append(cut(found, "topk") if parts > 1 else found)
    if not out:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op8_histogram_top_k": op8}
ORACLES = {
    "op8_histogram_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
