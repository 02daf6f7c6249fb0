"""Search: inverted index, bm25, layer scores, blending, top-k, enrichment."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vc
from corpusmill.hooks import REGISTRY
from corpusmill.operators import vectorize as vz

#: Presets of layer weights, k and least score.
PRESETS = {
    "default": {"weights": {"structure": 0.45, "lexical": 0.30, "contextual": 0.25}, "top_k": 10, "min_score": 0.1},
    "code": {"weights": {"structure": 0.6, "lexical": 0.4}, "top_k": 20, "min_score": 0.15},
    "semantic": {"weights": {"lexical": 0.3, "contextual": 0.7}, "top_k": 10, "min_score": 0.2},
}
K1, B = 1.2, 0.75
CANDIDATES = 1000


def query_terms(query: str, stopwords: bool = True) -> list[str]:
    words = [w for w in re.findall(r"[^\W_]+", query.lower())]
    kept = [w for w in words if not (stopwords and w in tx.STOPWORDS)] or words
    return list(dict.fromkeys(kept))


def expand(terms: list[str], synonyms: dict[str, list[str]] | None = None, most: int = 3) -> list[list[str]]:
    """Each term with up to `most` alternatives: synonyms and its stem."""
    out = []
    for t in terms:
        stem = re.sub("(ing|edly|ed|ies|es|s|ly)$", "", t) if len(t) > 5 else re.sub("s$", "", t) if len(t) > 3 else t
        out.append(list(dict.fromkeys([t, *(synonyms or {}).get(t, []), stem]))[: most + 1])
    return out


def index(df: DataFrame, key: str = "id", text: str = "content", only: list[str] | None = None) -> DataFrame:
    """Inverted index (term, id, tf, total), or the part of it that one query's terms need. Write it bucketed by term to serve
    many queries."""
    return vz.terms(df, key, text, only=only)


def match_all(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Ids that have every term."""
    return postings.where(F.col("term").isin(terms)).groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select("id")


def bm25(postings: DataFrame, terms: list[str], n_docs: int, mean_length: float, all_terms: bool = False) -> DataFrame:
    """(id, score) of texts with any (or all) of the terms. Document frequencies of a query are a handful of rows."""
    hits = postings.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.ln(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("total") / mean_length))
    out = hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("_n"))  # one row a query term
    return (out.where(F.col("_n") == len(terms)) if all_terms else out).drop("_n")


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "id", min_score: float | None = None) -> DataFrame:
    """The k best, ties to smaller keys, scores compared to six digits."""
    kept = scored if min_score is None else scored.where(F.col(score) >= min_score)
    return kept.orderBy(F.round(score, 6).desc(), F.col(key)).limit(k)


def similar(vectors: DataFrame, query: list[float], k: int = 10, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k vectors of the highest cosine to a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top_k(vectors.select(key, vc.cosine(F.col(vector), q).alias("score")), k, "score", key)


def top_k_by_group(scored: DataFrame, group: str, k: int, score: str = "score", key: str = "id") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.round(score, 6).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_vectors(df: DataFrame, query: str, dims: int, idf: DataFrame, n_docs: int) -> dict[str, list[float]]:
    """Structure and lexical vectors of a query, in the space of a corpus."""
    spark = df.sparkSession
    one = spark.createDataFrame([("q", query)], "id string, content string")
    s = vz.structure(one, "id", "content", dims).first()["vector"]
    counted = vz.terms(one)
    known = counted.join(idf, "term").select("id", tx.bucket(F.col("term"), dims).alias("idx"), (F.col("tf") / F.col("total") * F.col("idf") * tx.sign(F.col("term"))).alias("w"))
    row = vz.dense(known.groupBy("id", "idx").agg(F.sum("w").alias("value")), "id", dims).first()
    lexical = row["vector"] if row else [0.0] * dims
    return {"structure": s, "lexical": lexical, "contextual": lexical}


def with_synonyms(query: DataFrame, most: int = 3, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Alternatives of each word (column expanded_tokens, the word first): its synonyms too, `most` besides the word itself."""
    known = F.from_json(F.lit(json.dumps(synonyms or {})), "map<string,array<string>>")
    none = F.array().cast("array<string>")
    return query.withColumn("expanded_tokens", F.transform("expanded_tokens", lambda ts: F.slice(F.array_distinct(F.concat(F.slice(ts, 1, 1), F.coalesce(F.try_element_at(known, F.get(ts, F.lit(0))), none), ts)), 1, most + 1)))


def full_text(chunks: DataFrame, postings: DataFrame, query: DataFrame, stats: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Chunks that have, for every word of the query, the word or an alternative; the `most` best by bm25 over all of these.

    postings: (term, chunk_id, tf, total); query: one row with expanded_tokens; stats: one row (n_docs, mean_length). A query
    without words: all chunks."""
    words = query.select(F.posexplode("expanded_tokens").alias("word", "ts")).select("word", F.explode("ts").alias("term"))
    asked = query.select(F.size("expanded_tokens").alias("_words"))  # one row, as stats
    hits = postings.join(F.broadcast(words.groupBy("term").agg(F.collect_set("word").alias("words"))), "term")  # terms of one query
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("total") / F.col("mean_length")))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(F.col("chunk_id").alias("id")).agg(F.sum(part).alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("_n"))
    whole = scored.join(F.broadcast(asked)).where(F.col("_n") == F.col("_words"))
    found = chunks.join(top_k(whole, most).select("id"), "id", "left_semi")
    return found.unionByName(chunks.join(F.broadcast(asked.where("_words = 0").select())))


def scored_layer(df: DataFrame, vectors: DataFrame, layer: str, query_vectors: DataFrame) -> DataFrame:
    """Left join with the vectors of a layer; layer_score: cosine to the query's vector of that layer, null without a vector.
    query_vectors: (layer, vector), a row a layer."""
    own = vectors.where(F.col("layer") == layer).select(F.col("chunk_id").alias("id"), F.col("vector").alias("_v"))
    q = query_vectors.where(F.col("layer") == layer).agg(F.first("vector").alias("_q"))
    return df.join(own, "id", "left").join(F.broadcast(q)).withColumn(f"{layer}_score", F.when(F.col("_v").isNotNull() & F.col("_q").isNotNull(), vc.cosine(F.col("_v"), F.col("_q")))).drop("_v", "_q")


def search(chunks: DataFrame, vectors: DataFrame, files: DataFrame, query: str, query_vecs: dict[str, list[float]], preset: str = "default", k: int | None = None, postings: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None, stats: tuple[int, float] | None = None,
           weights: dict[str, float] | None = None, min_score: float | None = None, rerank: DataFrame | None = None, marked: bool = False) -> DataFrame:
    """Hybrid search, as the built-in search workflow has it: full-text candidates, cosine per layer, weighted sum, least score,
    top k, file and snippet.

    postings: (term, chunk_id, tf, total); without them every chunk is a candidate. weights: in place of the preset's. rerank:
    (chunk_id, boost), as by feedback(): the sum is multiplied before the top k. marked: the query's words marked in the snippet."""
    from corpusmill.plans.builtin import WORKFLOWS, reranked
    from corpusmill.plans.workflow import compile_workflow

    spark, conf = chunks.sparkSession, PRESETS[preset]
    weights = weights or conf["weights"]
    if postings is None:
        postings, words = spark.createDataFrame([], "term string, chunk_id string, tf bigint, total bigint"), ""
    else:
        postings, words = postings.withColumnRenamed("id", "chunk_id"), query
    n, mean = stats or (0, 1.0)
    tables = {
        "_query_input": spark.createDataFrame([(words,)], "query_text string"),
        "_query_vectors": spark.createDataFrame([(layer, [float(x) for x in v]) for layer, v in query_vecs.items()], "layer string, vector array<double>"),
        "_text_stats": spark.createDataFrame([(float(n), float(mean or 1.0))], "n_docs double, mean_length double"),
        "corpus.chunks": chunks, "corpus.chunk_vectors": vectors, "corpus.raw_files": files, "corpus.chunk_postings": postings,
        "corpus.feedback": rerank if rerank is not None else spark.createDataFrame([], "chunk_id string, boost double"),
    }
    params = {f"w_{layer}": float(weights.get(layer, 0.0)) for layer in ("structure", "lexical", "contextual")}
    params |= {"top_k": k or conf["top_k"], "min_score": conf["min_score"] if min_score is None else min_score, "synonyms": synonyms}
    wf = WORKFLOWS["search_v1"]
    out = compile_workflow(wf if rerank is None else reranked(wf), tables, params)["_output"]
    if marked:
        out = out.withColumn("snippet", highlight(F.col("snippet"), query_terms(query)))
    REGISTRY.fire("on_search", query=query, preset=preset)
    return out


def highlight(text: Column, terms: list[str], left: str = "<b>", right: str = "</b>") -> Column:
    if not terms:
        return text
    return F.regexp_replace(text, r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, terms)) + r")(?![\p{L}\p{N}])", f"{left}$1{right}")


def feedback(log: DataFrame) -> DataFrame:
    """Per chunk: counts by action and a multiplier for reranking, 1 + (up + clicks / 2 - down - ignores / 4) / (all + 10)."""
    counts = log.groupBy("chunk_id").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("click", "ignore", "upvote", "downvote")], F.count(F.lit(1)).alias("n"))
    boost = 1 + (F.col("n_upvote") + F.col("n_click") / 2 - F.col("n_downvote") - F.col("n_ignore") / 4) / (F.col("n") + 10)
    return counts.withColumn("boost", boost)
