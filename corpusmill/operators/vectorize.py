"""Vectorisers: feature hashing, tf-idf, structure, graph embedding, blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import features as ft
from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vc


def dense(df: DataFrame, key: str, dims: int, index: str = "idx", value: str = "value", normalise: bool = True) -> DataFrame:
    """From (key, index, value) sums to one array a key."""
    sums = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int"), value))).alias("_m"))
    v = vc.bind(F.col("_m"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))
    return sums.select(key, (vc.normalize(v) if normalise else v).alias("vector"))


def zero_layer(df: DataFrame, layer: str, key: str = "id", dims: int = 256, version: str = "v1") -> DataFrame:
    """The vectorize step without a declared algorithm: a zero vector for every row."""
    return as_layer(df.select(F.col(key).alias("chunk_id"), F.array_repeat(F.lit(0.0), dims).alias("vector")), layer, dims, version)


def hash_features(df: DataFrame, names: dict[str, float] | list[str], key: str = "id", dims: int = 256) -> DataFrame:
    """Named numeric columns to one signed, hashed, normalised vector a row. Names are constants, so buckets and signs are too;
    the vector is written directly as an array expression, without a shuffle."""
    scales = names if isinstance(names, dict) else dict.fromkeys(names, 1.0)
    slots: dict[int, Column] = {}
    for n, by in scales.items():
        at, sign = tx.fnv_python(n) % dims, 1.0 if tx.fnv_python(n, first_xor=False) % 2 == 0 else -1.0
        term = F.coalesce(F.col(n).cast("double"), F.lit(0.0)) / by * sign
        slots[at] = slots[at] + term if at in slots else term
    raw, at = [], 0
    for i in sorted(slots):
        if i > at:
            raw.append(F.array_repeat(F.lit(0.0), i - at))
        raw.append(F.array(slots[i]))
        at = i + 1
    if at < dims:
        raw.append(F.array_repeat(F.lit(0.0), dims - at))
    return df.select(F.col(key).alias("chunk_id"), vc.normalize(F.concat(*raw)).alias("vector"))


def structure(df: DataFrame, key: str = "id", text: str = "content", dims: int = 256) -> DataFrame:
    """The structure layer of texts."""
    read = df.select(F.col(key).alias("id"), F.col(text).alias("content")).selectExpr("id", *[f"{e} as {n}" for n, e in ft.structure().items()])
    return hash_features(read, ft.STRUCTURE, "id", dims)


def runs(items: Column) -> Column:
    """From an array, (term, tf) of its distinct items: sorted, then cut where neighbours differ, in linear steps."""

    def cut(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return vc.bind(ends, lambda e: F.transform(e, lambda x, k: F.struct(F.get(s, x - 1).alias("term"), (x - F.when(k == 0, 0).otherwise(F.get(e, k - 1))).cast("bigint").alias("tf"))))

    return F.when(F.size(items) > 0, vc.bind(F.array_sort(items), cut))


def terms(df: DataFrame, key: str = "id", text: str = "content", ngrams: tuple[int, int] = (1, 1), only: list[str] | None = None) -> DataFrame:
    """(id, term, total, tf): counts of tokens and their n-grams, total the number of terms of the text. Each text is one row,
    so it is counted within its row and nothing is shuffled. only: the terms that are wanted; others count in total alone."""
    toks = df.select(F.col(key).alias("id"), tx.tokens(F.col(text)).alias("t"))
    every = F.col("t") if ngrams == (1, 1) else F.concat(*[tx.ngrams(F.col("t"), n) for n in range(ngrams[0], ngrams[1] + 1)])
    wanted = F.col("every") if only is None else F.filter("every", lambda t: t.isin(only))
    each = toks.select("id", every.alias("every")).select("id", F.size("every").cast("bigint").alias("total"), F.explode(runs(wanted)).alias("r"))
    return each.select("id", "r.term", "total", "r.tf")


def idf(counted: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.8) -> DataFrame:
    """(term, df, idf = ln(N / df)) of terms in at least min_df texts and at most max_df of them (whole texts, rounded down)."""
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= min_df) & (F.col("df") <= int(n_docs * max_df))).select("term", "df", F.ln(F.lit(float(n_docs)) / F.col("df")).alias("idf"))


def tfidf_sparse(df: DataFrame, key: str = "id", text: str = "content", dims: int = 256, min_df: int = 2, max_df: float = 0.8, ngrams: tuple[int, int] = (1, 1), n_docs: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(id, idx, value): signed bucket sums of tf * idf, before normalisation.

    The vocabulary is hashed once a term, not once an occurrence; it joins the counts on the term, where a frequent term is a
    hot key that adaptive execution splits; terms beyond max_df are gone by then. counted: what terms() gave, if it was written."""
    counted = terms(df, key, text, ngrams) if counted is None else counted
    n = df.count() if n_docs is None else n_docs
    vocabulary = idf(counted, n, min_df, max_df).withColumn("idx", tx.bucket(F.col("term"), dims)).withColumn("sign", tx.sign(F.col("term")))
    weighed = counted.join(vocabulary, "term").select("id", "idx", (F.col("tf") / F.col("total") * F.col("idf") * F.col("sign")).alias("w"))
    return weighed.groupBy("id", "idx").agg(F.sum("w").alias("value"))


def tfidf(df: DataFrame, key: str = "id", text: str = "content", dims: int = 256, **how) -> DataFrame:
    """The lexical layer: one normalised vector a text; texts without a known term get the zero vector."""
    v = dense(tfidf_sparse(df, key, text, dims, **how), "id", dims)
    return df.select(F.col(key).alias("id")).join(v, "id", "left").select(F.col("id").alias("chunk_id"), F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def graph_embed(vectors: DataFrame, edges: DataFrame, relations: tuple[str, ...] = ("parent_of", "follows"), dims: int = 256) -> DataFrame:
    """The contextual layer: mean of the lexical vectors of a chunk's neighbours in both directions, normalised; without
    neighbours its own vector. One row an edge moves; components are summed before the shuffle, so a hub is one row a task."""
    e = edges.where(F.col("relation_type").isin(*relations)).select(F.col("from_chunk_id").alias("a"), F.col("to_chunk_id").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = both.join(vectors.select(F.col("chunk_id").alias("b"), "vector"), "b")
    means = near.groupBy(F.col("a").alias("chunk_id")).agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"_{i}") for i in range(dims)])
    means = means.select("chunk_id", vc.normalize(F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(dims)])).alias("_near"))
    return vectors.join(means, "chunk_id", "left").select("chunk_id", F.coalesce("_near", F.col("vector")).alias("vector"))


def layers_wide(vectors: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """One row a chunk with a column a layer: one pass instead of a join for each layer."""
    return vectors.groupBy("chunk_id").agg(*[F.max(F.when(F.col("layer") == layer, F.col("vector"))).alias(layer) for layer in layers])


def blend(vectors: DataFrame, weights: dict[str, float], dims: int = 256) -> DataFrame:
    wide = layers_wide(vectors, tuple(weights))
    return wide.select("chunk_id", vc.blend({k: F.col(k) for k in weights}, weights, dims).alias("vector"))


def as_layer(df: DataFrame, layer: str, dims: int, version: str) -> DataFrame:
    return df.select("chunk_id", F.lit(layer).alias("layer"), F.col("vector").cast("array<float>").alias("vector"), F.lit(dims).cast("bigint").alias("dimensions"), F.lit(version).alias("model_version"))
