"""One query for each operator over the driver's tables, and the same in DuckDB's SQL.

documents stand for files with their content: the id is doc_id, as equal texts would share a content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.corpus import scratch
from corpusmill.functions import features as ft
from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vc
from corpusmill.operators import chunking, metrics, relations, search, steps, upsert, vectorize
from corpusmill.queries_base import CONTENTS, ORACLES, QUERIES, contents, query, read
from corpusmill.sources import files as fs

# --------------------------------------------------------------------------- steps


@query("filter_pending", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 2000")
def _(spark, d):
    return steps.filter_rows(read(spark, d, "documents"), "lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 2000").select("doc_id", "lang", "n_chars")


@query("filter_top", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000.0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return steps.filter_rows(read(spark, d, "orders"), "o_totalprice >= :least ORDER BY o_totalprice DESC, o_orderkey LIMIT :k", {"least": 1000.0, "k": 25}).select("o_orderkey", "o_totalprice")


@query("project_tokens", "SELECT doc_id, length(text) // 4 AS approx_tokens, source || '/' || doc_id AS source_path FROM documents")
def _(spark, d):
    return steps.project(read(spark, d, "documents"), "doc_id, cast(length(text) / 4 as bigint) as approx_tokens, concat(source, '/', doc_id) as source_path")


@query("join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    o, c, n = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "nation")
    j = steps.join(steps.join(o.withColumnRenamed("o_custkey", "k"), c.withColumnRenamed("c_custkey", "k"), ["k"]).withColumnRenamed("c_nationkey", "n"), n.withColumnRenamed("n_nationkey", "n"), ["n"])
    return steps.aggregate(j, group_by=["n_name"], functions={"n": "count(*)", "total": "round(sum(o_totalprice), 2)"})


@query("join_left", "SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def _(spark, d):
    return steps.join(read(spark, d, "documents"), read(spark, d, "labels").where("quality = 1"), ["doc_id"], "left").select("doc_id", "lang", F.col("quality").cast("bigint").alias("quality"))


@query("join_full", "SELECT coalesce(c.c_custkey, o.k) AS k, count(o.k) AS n FROM customer c FULL JOIN (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') o ON c.c_custkey = o.k GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.lit(1).alias("one"))
    return steps.join(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), o, ["k"], "full").groupBy("k").agg(F.count("one").alias("n"))


@query("join_right", "SELECT s.s_suppkey, n.n_name FROM (SELECT * FROM nation WHERE n_nationkey < 5) n RIGHT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
def _(spark, d):
    n = read(spark, d, "nation").where("n_nationkey < 5").withColumnRenamed("n_nationkey", "k")
    return steps.join(n, read(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), ["k"], "right").select("s_suppkey", "n_name")


@query("join_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return steps.semi(read(spark, d, "documents"), read(spark, d, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id", "source")


@query("join_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return steps.anti(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"]).select("doc_id", "source")


@query("join_cross", "SELECT doc_id, i, doc_id || '-' || i AS segment_id FROM documents, (SELECT unnest([1, 2, 3])::BIGINT AS i) WHERE lang = 'en'")
def _(spark, d):
    n = read(spark, d, "documents").where("lang = 'en'").select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("i"))
    return n.withColumn("segment_id", F.concat_ws("-", "doc_id", "i"))


@query("union_all", "SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels")
def _(spark, d):
    return steps.merge([read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), "n") for t in ("documents", "pages", "labels")])


@query("union_distinct", "SELECT lang AS v FROM documents UNION SELECT source FROM documents")
def _(spark, d):
    x = read(spark, d, "documents")
    return x.select(F.col("lang").alias("v")).union(x.select("source")).distinct()


@query("intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def _(spark, d):
    return read(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(read(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("except", "SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, d):
    x = read(spark, d, "labels")
    return x.select("doc_id").exceptAll(x.where("toxic = 1").select("doc_id")).distinct()


@query("aggregate_groups", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    return steps.aggregate(
        read(spark, d, "lineitem"), group_by=["l_returnflag", "l_linestatus"],
        functions={"n": "count(*)", "qty": "round(sum(l_quantity), 2)", "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 2)", "last_ship": "date_format(max(l_shipdate), 'yyyy-MM-dd')", "suppliers": "count(distinct l_suppkey)"},
    )


@query("aggregate_whole", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(DISTINCT source) AS sources, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english FROM documents")
def _(spark, d):
    return steps.aggregate(read(spark, d, "documents"), "count(*) as n, sum(n_chars) as chars, max(n_chars) as longest, count(distinct source) as sources, sum(case when lang = 'en' then 1 else 0 end) as english")


@query("group_concat", "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS tags, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    j = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("tags"), F.count(F.lit(1)).alias("n"))


@query("window_chunk", """SELECT doc_id AS id, row_number() OVER (ORDER BY source, doc_id) AS chunk_position, length(text) // 4 AS approx_tokens FROM documents WHERE length(text) // 4 BETWEEN 50 AND 512""")
def _(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("position"), F.col("text").alias("content"))
    return steps.window(x, 50, 512, ("position", "id")).select("id", "chunk_position", "approx_tokens")


@query("hash_sha256", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 32) AS segment_id FROM documents")
def _(spark, d):
    x = steps.hash_columns(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")), ["content"], "sha256", "content_hash")
    return x.select("doc_id", "content_hash", F.substring("content_hash", 1, 32).alias("segment_id"))


_BYTES = "list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::BIGINT, 2))::BIGINT)"
_FNV1A = f"list_reduce({_BYTES}, lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)"
_FNV1 = f"list_reduce({_BYTES}, lambda h, b: xor((h * 16777619) & 4294967295, b), 2166136261::BIGINT)"


@query("hash_fnv", f"SELECT t AS term, {_FNV1A} AS fnv1a, {_FNV1} AS fnv1, {_FNV1A} % 256 AS idx, CASE WHEN {_FNV1} % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS sign FROM (SELECT DISTINCT p_name AS t FROM part)")
def _(spark, d):
    t = read(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    return t.select("term", tx.fnv(F.col("term")).alias("fnv1a"), tx.fnv(F.col("term"), False).alias("fnv1"), tx.bucket(F.col("term"), 256).alias("idx"), tx.sign(F.col("term")).cast("bigint").alias("sign"))


@query("hash_xxhash")
def _(spark, d):
    return steps.hash_columns(read(spark, d, "documents").select("doc_id", F.col("text").alias("content")), ["doc_id", "content"], "xxhash").select("doc_id", "hash")


@query("dedupe_batch", "SELECT hash, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS hash, doc_id FROM documents) GROUP BY hash")
def _(spark, d):
    x = read(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return chunking.dedupe(x, None, "hash", ("doc_id",))


@query("dedupe_corpus", "SELECT hash, min(doc_id) AS doc_id FROM (SELECT sha256(text) AS hash, doc_id FROM documents WHERE doc_id % 2 = 0) WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1) GROUP BY hash")
def _(spark, d):
    x = read(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return chunking.dedupe(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"), "hash", ("doc_id",))


@query("fork_merge", "SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS branch FROM documents")
def _(spark, d):
    b = steps.fork(read(spark, d, "documents"), {"short": "n_chars < 1000", "medium": "n_chars >= 1000 AND n_chars < 4000", "long": "n_chars >= 4000"})
    return steps.merge([x.select("doc_id", F.lit(k).alias("branch")) for k, x in b.items()])


@query("diff_steps", """WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 500), b AS (SELECT doc_id FROM documents WHERE lang = 'en'),
c AS (SELECT (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM b) AS rows_after, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) AS rows_lost, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS rows_gained,
(SELECT count(*) FROM a SEMI JOIN b USING (doc_id)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_all)
SELECT rows_before, rows_after, rows_lost, rows_gained, CASE WHEN rows_after < rows_before THEN 'reduction' WHEN rows_after > rows_before THEN 'expansion' ELSE 'transformation' END AS delta_type,
round(1 - rows_after / rows_before, 6) AS delta_score, round(n_both / n_all, 6) AS jaccard_index FROM c""")
def _(spark, d):
    x = read(spark, d, "documents")
    return steps.diff(x.where("n_chars > 500"), x.where("lang = 'en'"), "doc_id").withColumn("delta_score", F.round("delta_score", 6)).withColumn("jaccard_index", F.round("jaccard_index", 6))


# --------------------------------------------------------------------------- features


def _features(kind: str) -> None:
    over = "(SELECT page_id AS id, html AS content, 0::BIGINT AS level, url AS section_path FROM pages)" if kind in ("html", "javascript", "docx") else "(SELECT doc_id AS id, text AS content FROM documents)"
    cols = ", ".join(f"{_rounded(e, n)} AS {n}" for n, e in ft.features(kind, ft.DUCKDB).items())
    sql = f"SELECT id, {cols} FROM {over} WHERE length(content) > {ft.MIN_LENGTH[kind]}"

    @query(f"features_{kind}", sql)
    def run(spark, d):
        if "pages" in over:
            x = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"), F.lit(0).cast("bigint").alias("level"), F.col("url").alias("section_path"))
        else:
            x = contents(spark, d)
        named = ft.features(kind)
        out = steps.add_features(x.where(f"length(content) > {ft.MIN_LENGTH[kind]}"), named)
        return out.selectExpr("id", *[f"{_rounded(n, n)} as {n}" for n in named])


def _rounded(e: str, name: str) -> str:
    return f"round({e}, 6)" if any(x in name for x in ("ratio", "density", "avg_")) and name != "list_density" else e


for _kind in ft.KINDS:
    _features(_kind)

_LONG = ft.features("text", ft.DUCKDB)


@query("features_long", "SELECT id AS chunk_id, name AS feature_name, round(value, 6) AS feature_value FROM (UNPIVOT (SELECT id, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in _LONG.items()) + f" FROM {CONTENTS}) ON " + ", ".join(_LONG) + " INTO NAME name VALUE value)")
def _(spark, d):
    from corpusmill.plans.workflow import Step, long_features

    x = steps.add_features(contents(spark, d), ft.features("text"))
    return long_features(x, Step("f", "aggregate", "_input", "o", None, {"features": "text"})).withColumn("feature_value", F.round("feature_value", 6))


@query("structure_features", "SELECT id, " + ", ".join(f"{_rounded(e, n)} AS {n}" for n, e in ft.structure(ft.DUCKDB).items()) + f" FROM {CONTENTS}")
def _(spark, d):
    named = ft.structure()
    return contents(spark, d).selectExpr("id", *[f"{_rounded(e, n)} as {n}" for n, e in named.items()])


def _structure_rows(relation: str) -> str:
    """SQL for (id, idx, x): the structure vector of each row of a relation of (id, content), without its zeros."""
    slots: dict[int, list[str]] = {}
    for n, by in ft.STRUCTURE.items():
        sign = "" if tx.fnv_python(n, first_xor=False) % 2 == 0 else "-"
        slots.setdefault(tx.fnv_python(n) % 256, []).append(f"{sign}({n}) / {by}")
    pairs = [f"({i}, {' + '.join(v)})" for i, v in sorted(slots.items())]
    lists = ", ".join(f"struct_pack(i := {p[1:].split(',', 1)[0]}, x := ({p.split(',', 1)[1][:-1]})::DOUBLE)" for p in pairs)
    inner = "SELECT id, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in ft.structure(ft.DUCKDB).items()) + f" FROM {relation}"
    return f"SELECT id, s.i::BIGINT AS idx, s.x / nullif(l2, 0) AS x FROM (SELECT id, unnest(v) AS s, sqrt(list_sum(list_transform(v, lambda a: a.x * a.x))) AS l2 FROM (SELECT id, [{lists}] AS v FROM ({inner})))"


def _structure_sql() -> str:
    return f"SELECT id, idx, round(x, 6) AS value FROM ({_structure_rows(CONTENTS)}) WHERE round(x, 6) <> 0"


def _sparse(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("idx", "value")).select(key, F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value")).where("value <> 0")


@query("structure_vector", _structure_sql())
def _(spark, d):
    return _sparse(vectorize.structure(contents(spark, d)).withColumnRenamed("chunk_id", "id"), "id")


# --------------------------------------------------------------------------- text

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query("tokenize", f"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS distinct_n, sha256(array_to_string(t, ' ')) AS tokens_hash FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def _(spark, d):
    x = read(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("distinct_n"), F.sha2(F.array_join("t", " "), 256).alias("tokens_hash"))


@query("ngrams", f"SELECT doc_id, greatest(len(t) - 1, 0)::BIGINT AS n, sha256(array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]), ' ')) AS hash FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def _(spark, d):
    x = read(spark, d, "documents").select("doc_id", tx.ngrams(tx.tokens(F.col("text")), 2).alias("g"))
    return x.select("doc_id", F.size("g").cast("bigint").alias("n"), F.sha2(F.array_join("g", " "), 256).alias("hash"))


_TERMS = f"(SELECT doc_id AS id, unnest(t) AS term, len(t) AS total FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))"
_COUNTED = f"(SELECT id, term, total, count(*) AS tf FROM {_TERMS} GROUP BY ALL)"
_IDF = f"(SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM {_COUNTED} GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor((SELECT count(*) FROM documents) * 0.8))"


@query("terms", f"SELECT id, count(*) AS n, sum(tf)::BIGINT AS tf, max(tf) AS most FROM {_COUNTED} GROUP BY id")
def _(spark, d):
    return vectorize.terms(contents(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"), F.max("tf").alias("most"))


@query("tfidf_idf", f"SELECT term, df, round(idf, 6) AS idf FROM {_IDF}")
def _(spark, d):
    x = contents(spark, d)
    return vectorize.idf(vectorize.terms(x), x.count()).select("term", "df", F.round("idf", 6).alias("idf"))


_SPARSE = f"""(SELECT id, idx, sum(tf / total * idf * sign) AS value FROM {_COUNTED} JOIN (SELECT term, idf, {_FNV1A.replace('(t)', '(term)')} % 256 AS idx, CASE WHEN {_FNV1.replace('(t)', '(term)')} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM {_IDF}) USING (term) GROUP BY id, idx)"""


@query("tfidf_sparse", f"SELECT id, idx, round(value, 6) AS value FROM {_SPARSE}")
def _(spark, d):
    return vectorize.tfidf_sparse(contents(spark, d)).select("id", "idx", F.round("value", 6).alias("value"))


@query("tfidf_vector", f"SELECT id AS chunk_id, idx, round(value / nullif(sqrt(sum(value * value) OVER (PARTITION BY id)), 0), 6) AS value FROM {_SPARSE} QUALIFY value IS NOT NULL AND value <> 0")
def _(spark, d):
    return _sparse(vectorize.tfidf(contents(spark, d)), "chunk_id")


@query("fts_match_all", f"SELECT DISTINCT id FROM {_TERMS} WHERE term = 'the' INTERSECT SELECT id FROM {_TERMS} WHERE term = 'and' INTERSECT SELECT id FROM {_TERMS} WHERE term = 'with'")
def _(spark, d):
    return search.match_all(search.index(contents(spark, d), only=["the", "and", "with"]), ["the", "and", "with"])


_BM25 = f"""(SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * total / mean))) AS score
FROM (SELECT id, term, tf, total, count(*) OVER (PARTITION BY term) AS df FROM {_COUNTED} WHERE term IN ('est', 'which', 'der')),
(SELECT count(*)::DOUBLE AS n, avg(len({_TOKENS})) AS mean FROM documents) GROUP BY id)"""


@query("bm25_topk", f"SELECT id, round(score, 6) AS score FROM {_BM25} ORDER BY round(score, 6) DESC, id LIMIT 20")
def _(spark, d):
    x = contents(spark, d)
    s = x.select(F.size(tx.tokens(F.col("content"))).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    return search.top_k(search.bm25(search.index(x, only=["est", "which", "der"]), ["est", "which", "der"], s["n"], s["mean"]), 20).withColumn("score", F.round("score", 6))


_MARK = "regexp_replace({0}, '(?i)(^|[^\\p{{L}}\\p{{N}}])(the|and)($|[^\\p{{L}}\\p{{N}}])', '\\1ꙮ\\2ꙮ\\3', 'g')"


# Words are marked by a letter, twice over, as neighbours share the character between them.
@query("highlight", f"SELECT doc_id, sha256(regexp_replace({_MARK.format(_MARK.format('text'))}, '(?i)ꙮ(the|and)ꙮ', '<b>\\1</b>', 'g')) AS marked FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(search.highlight(F.col("text"), ["the", "and"]), 256).alias("marked"))


# --------------------------------------------------------------------------- vectors

_E = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query("vector_norms", f"SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM {_E}")
def _(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vc.norm(F.col("embedding")), 6).alias("norm"))


@query("vector_dot_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    j = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(b, "a")
    return j.select("a", "b", F.round(vc.dot(F.col("va"), F.col("vb")), 6).alias("dot"), F.round(vc.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("vector_maths", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * 2 + x)), 6) AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS unit FROM {_E}")
def _(spark, d):
    v = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(vc.add(vc.scale(v, 2.0), v), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(vc.norm(vc.normalize(v)), 6).alias("unit"))


@query("cosine_topk", f"SELECT b.vec_id AS chunk_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM {_E} a, {_E} b WHERE a.vec_id = 0 ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id LIMIT 10")
def _(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = e.where("chunk_id = 0").first()["vector"]
    return search.similar(e, q, 10).withColumn("score", F.round("score", 6))


@query("topk_by_label", f"SELECT label, rank, vec_id, score FROM (SELECT label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY round(x, 6) DESC, vec_id) AS rank, vec_id, round(x, 6) AS score FROM (SELECT e.vec_id, e.label, list_inner_product(a.v, list_transform(e.embedding, lambda x: x::DOUBLE)) AS x FROM embeddings e, (SELECT v FROM {_E} WHERE vec_id = 1) a)) WHERE rank <= 3")
def _(spark, d):
    e = read(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 1").first()["embedding"]])
    s = e.select("vec_id", F.col("label").cast("bigint").alias("label"), vc.dot(F.col("embedding"), q).alias("score"))
    return search.top_k_by_group(s, "label", 3, "score", "vec_id").select("label", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def _layers(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    one = e.select(F.col("vec_id").alias("chunk_id"), F.lit("structure").alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    two = e.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("chunk_id"), F.lit("lexical").alias("layer"), F.transform(F.reverse("embedding"), lambda x: x.cast("double")).alias("vector"))
    return one.unionByName(two)


@query("layers_pivot", "SELECT vec_id AS chunk_id, 2 - (vec_id % 3 = 0)::BIGINT AS layers FROM embeddings")
def _(spark, d):
    w = vectorize.layers_wide(_layers(spark, d), ("structure", "lexical", "contextual"))
    return w.select("chunk_id", (F.col("structure").isNotNull().cast("bigint") + F.col("lexical").isNotNull().cast("bigint") + F.col("contextual").isNotNull().cast("bigint")).alias("layers"))


@query("blend_vectors", f"""SELECT chunk_id, i::BIGINT AS idx, round(b[i + 1] / nullif(sqrt(list_sum(list_transform(b, lambda x: x * x))), 0), 6) AS value FROM (
SELECT vec_id AS chunk_id, unnest(range(0, len(b))) AS i, b FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN v ELSE list_transform(range(1, len(v) + 1), lambda i: (v[i] * 0.6 + v[len(v) + 1 - i] * 0.4)) END AS b FROM {_E})) WHERE round(b[i + 1] / nullif(sqrt(list_sum(list_transform(b, lambda x: x * x))), 0), 6) <> 0""")
def _(spark, d):
    x = _layers(spark, d)
    dims = x.select(F.size("vector").alias("n")).first()["n"]
    return _sparse(vectorize.blend(x, {"structure": 0.6, "lexical": 0.4}, dims), "chunk_id")


# --------------------------------------------------------------------------- chunks and blocks

_PARAGRAPHS = "list_filter(list_transform(regexp_split_to_array(text, '\\n(?:[^\\S\\n]*\\n)+'), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')), lambda b: b <> '')"
_PARA_ROWS = f"(SELECT doc_id AS file_id, generate_subscripts(p, 1) - 1 AS position, unnest(p) AS content FROM (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents))"


@query("chunk_paragraph", f"SELECT file_id, position::BIGINT AS position, sha256(content) AS hash, length(content) // 4 AS token_count FROM {_PARA_ROWS}")
def _(spark, d):
    return chunking.by_paragraph(contents(spark, d)).select("file_id", "position", F.sha2("content", 256).alias("hash"), "token_count")


@query("chunk_sentence", """SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY i) - 1)::BIGINT AS position, sha256(s) AS hash, length(s) // 4 AS token_count FROM (
SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)) WHERE s <> ''""")
def _(spark, d):
    return chunking.by_sentence(contents(spark, d)).select("file_id", "position", F.sha2("content", 256).alias("hash"), "token_count")


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("chunk_fixed_window", f"""SELECT doc_id AS file_id, i::BIGINT AS position, sha256(array_to_string(w[i * 150 + 1 : i * 150 + 200], ' ')) AS hash, CASE WHEN i > 0 THEN 50 ELSE 0 END::BIGINT AS overlap_prev, CASE WHEN i < last THEN 50 ELSE 0 END::BIGINT AS overlap_next
FROM (SELECT doc_id, w, last, unnest(range(0, last + 1)) AS i FROM (SELECT doc_id, w, greatest(ceil((len(w) - 200) / 150), 0)::BIGINT AS last FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0))""")
def _(spark, d):
    return chunking.by_fixed_window(contents(spark, d), size=200, overlap=50).select("file_id", "position", F.sha2("content", 256).alias("hash"), "overlap_prev", "overlap_next")


_LINES = "(SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, unnest(p) AS u FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents))"


@query("chunk_semantic", f"""WITH RECURSIVE u AS MATERIALIZED (SELECT file_id, i, u, length(u) // 4 AS n FROM {_LINES}),
g AS (SELECT file_id, i, n AS t, 0 AS c FROM u WHERE i = 1 UNION ALL SELECT u.file_id, u.i, CASE WHEN g.t + u.n > 200 THEN u.n ELSE g.t + u.n END, g.c + CASE WHEN g.t + u.n > 200 THEN 1 ELSE 0 END FROM g JOIN u ON u.file_id = g.file_id AND u.i = g.i + 1)
SELECT file_id, c::BIGINT AS position, sha256(content) AS hash, length(content) // 4 AS token_count FROM (SELECT g.file_id, c, string_agg(u.u, chr(10) || chr(10) ORDER BY g.i) AS content FROM g JOIN u USING (file_id, i) GROUP BY ALL) WHERE length(content) // 4 >= 20""")
def _(spark, d):
    units = F.filter(F.split("content", "\n", -1), lambda x: x != "")
    return chunking.by_packing(contents(spark, d), max_tokens=200, min_tokens=20, units=units).select("file_id", "position", F.sha2("content", 256).alias("hash"), "token_count")


@query("generic_blocks", """SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY b) - 1)::BIGINT AS position, sha256(string_agg(u || chr(10), '' ORDER BY i)) AS hash FROM (
SELECT *, sum(CASE WHEN trim(u, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS b FROM (SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, unnest(p) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE trim(u, ' ' || chr(9) || chr(13)) <> '' GROUP BY file_id, b""")
def _(spark, d):
    return fs.generic_blocks(contents(spark, d)).select("file_id", "position", F.sha2("content", 256).alias("hash"))


@query("extract_html")
def _(spark, d):
    x = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    return fs.extract(x, "code", {"language": "html"}).select("file_id", "position", "id", "kind", "line_start", "line_end")


@query("extract_markdown", "SELECT doc_id::VARCHAR AS file_id, 0::BIGINT AS position, substr(sha256('# ' || source || chr(10) || text), 1, 32) AS id, 'section' AS kind, 1::BIGINT AS level FROM documents")
def _(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("# "), "source", F.lit("\n"), "text").alias("content"))
    return fs.extract(x, "code", {"language": "markdown"}).select("file_id", "position", "id", "kind", "level")


_PDF = "(SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, trim(unnest(p), ' ' || chr(9) || chr(13)) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query("extract_pdf_text", f"""SELECT file_id::VARCHAR AS file_id, (row_number() OVER (PARTITION BY file_id ORDER BY b) - 1)::BIGINT AS position, sha256(string_agg(u, ' ' ORDER BY i)) AS hash, (max(page) + 1)::BIGINT AS page FROM (
SELECT *, sum(CASE WHEN u = '' OR m THEN 1 ELSE 0 END) OVER w AS b, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER w AS page FROM (SELECT *, regexp_matches(u, '^(?i)page\\s+\\d+') AS m FROM {_PDF}) WINDOW w AS (PARTITION BY file_id ORDER BY i)) WHERE u <> '' AND NOT m GROUP BY file_id, b""")
def _(spark, d):
    return fs.extract(contents(spark, d), "pdf").select("file_id", "position", F.sha2("content", 256).alias("hash"), F.col("page").cast("bigint").alias("page"))


@query("section_paths", """WITH h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 0 END AS level FROM conversations)
SELECT a.conv_id, a.turn, a.level::BIGINT AS level, concat_ws('/', (SELECT 's' || max(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.level = 1),
(SELECT 'u' || max(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND b.level = 2 AND b.turn > coalesce((SELECT max(c.turn) FROM h c WHERE c.conv_id = a.conv_id AND c.turn <= a.turn AND c.level = 1), -1))) AS section_path FROM h a""")
def _(spark, d):
    mark = F.when(F.col("role") == "system", F.concat(F.lit("# s"), "turn")).when(F.col("role") == "user", F.concat(F.lit("## u"), "turn")).otherwise(F.lit("x"))
    x = read(spark, d, "conversations").select("conv_id", "turn", mark.alias("content"))
    return chunking.section_paths(x, "conv_id", "turn").select("conv_id", "turn", "level", "section_path")


@query("parse_rules", """SELECT file_id, i::BIGINT AS position, CASE WHEN regexp_matches(u, '^#{1,6}\\s+') THEN 'heading' WHEN regexp_matches(u, '^\\s*[-*+]\\s+') THEN 'list_item' WHEN regexp_matches(u, '^\\s*\\d+\\.\\s+') THEN 'list_item' WHEN regexp_matches(u, '^>\\s+') THEN 'blockquote' WHEN starts_with(u, '```') THEN 'code_block' ELSE 'paragraph' END AS unit_type FROM """ + _LINES)
def _(spark, d):
    x = contents(spark, d).select(F.col("id").alias("file_id"), F.posexplode(F.filter(F.split("content", "\n", -1), lambda u: u != "")).alias("i", "u"))
    return x.select("file_id", (F.col("i") + 1).cast("bigint").alias("position"), chunking.unit_type(F.col("u")).alias("unit_type"))


# --------------------------------------------------------------------------- corpus, runs, files


@query("merge_ignore", """WITH old AS (SELECT doc_id AS id, source AS v FROM documents WHERE doc_id % 3 = 0), new AS (SELECT doc_id // 2 AS id, lang || doc_id AS v FROM documents)
SELECT * FROM old UNION ALL SELECT id, min(v) AS v FROM new WHERE id NOT IN (SELECT id FROM old) GROUP BY id""")
def _(spark, d):
    x = read(spark, d, "documents")
    return upsert.insert_ignore(x.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("v")), x.select(F.expr("doc_id div 2").alias("id"), F.concat("lang", "doc_id").alias("v")), ["id"])


@query("merge_replace", """WITH old AS (SELECT doc_id AS id, source AS v FROM documents WHERE doc_id % 3 = 0), new AS (SELECT doc_id // 2 AS id, lang || doc_id AS v, doc_id AS run FROM documents)
SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, arg_max(v, run) AS v FROM new GROUP BY id""")
def _(spark, d):
    x = read(spark, d, "documents")
    new = x.select(F.expr("doc_id div 2").alias("id"), F.concat("lang", "doc_id").alias("v"), F.col("doc_id").alias("run"))
    return upsert.insert_replace(x.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("v")), new, ["id"], ["run"])


@query("status_update", "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'vectorized' ELSE 'pending' END AS status FROM documents")
def _(spark, d):
    f = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("pending").alias("status"))
    return upsert.set_status(f, read(spark, d, "labels").select(F.col("doc_id").alias("file_id")))


@query("status_counts", "SELECT lang AS status, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return metrics.status_counts(read(spark, d, "documents").withColumnRenamed("lang", "status"))


_RUNS = "(SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step_order, o_orderkey AS duration_ms, (o_orderkey * 7) % 100 AS rows_in, (o_orderkey * 7) % 100 // 2 AS rows_out, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at, o_orderpriority AS step_name FROM orders)"


def _runs(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = F.expr("(o_orderkey * 7) % 100")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.row_number().over(w).cast("bigint").alias("step_order"), F.col("o_orderkey").alias("duration_ms"), rows.alias("rows_in"), F.expr("((o_orderkey * 7) % 100) div 2").alias("rows_out"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"), F.col("o_orderpriority").alias("step_name"))


@query("run_summary", f"SELECT c_custkey AS run_id, total_steps, completed_steps, total_duration_ms, final_rows FROM customer LEFT JOIN (SELECT run_id, count(*) AS total_steps, count(finished_at) AS completed_steps, sum(duration_ms)::BIGINT AS total_duration_ms, arg_max(rows_out, step_order) AS final_rows FROM {_RUNS} GROUP BY run_id) ON run_id = c_custkey")
def _(spark, d):
    return metrics.run_summary(read(spark, d, "customer").select(F.col("c_custkey").alias("run_id")), _runs(spark, d))


@query("step_progression", f"SELECT run_id, step_order, step_name, rows_in, rows_out, round(100.0::DOUBLE * rows_out / nullif(rows_in, 0), 2) AS retention_pct, duration_ms, CASE WHEN step_order % 2 = 0 THEN 'reduction' END AS delta_type, CASE WHEN step_order % 2 = 0 THEN 0.5::DOUBLE END AS jaccard_index FROM {_RUNS}")
def _(spark, d):
    r = _runs(spark, d)
    deltas = r.where("step_order % 2 = 0").select("run_id", F.col("step_order").alias("step_to"), F.lit("reduction").alias("delta_type"), F.lit(0.5).alias("jaccard_index"))
    return metrics.step_progression(r, deltas)


@query("step_stats", """SELECT 'doc_id' AS column_name, count(*) AS row_count, count(*) - count(doc_id) AS nulls, count(DISTINCT doc_id) AS n_distinct, min(doc_id)::DOUBLE AS min, max(doc_id)::DOUBLE AS max, round(avg(doc_id), 4) AS mean, round(stddev_samp(doc_id), 4) AS std FROM documents
UNION ALL SELECT 'text', count(*), count(*) - count(text), count(DISTINCT text), min(length(text))::DOUBLE, max(length(text))::DOUBLE, round(avg(length(text)), 4), round(stddev_samp(length(text)), 4) FROM documents
UNION ALL SELECT 'lang', count(*), count(*) - count(lang), count(DISTINCT lang), min(length(lang))::DOUBLE, max(length(lang))::DOUBLE, round(avg(length(lang)), 4), round(stddev_samp(length(lang)), 4) FROM documents""")
def _(spark, d):
    s = metrics.stats(read(spark, d, "documents").select("doc_id", "text", "lang"))
    return s.select("column_name", "row_count", "nulls", F.col("distinct").alias("n_distinct"), "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("step_samples", """WITH x AS (SELECT doc_id AS k, source AS o, length(text)::DOUBLE AS n FROM documents), m AS (SELECT avg(n) AS mean, stddev_samp(n) AS sd FROM x)
(SELECT 'first' AS sample_type, k AS row_id FROM x ORDER BY o, k LIMIT 1) UNION ALL (SELECT 'last', k FROM x ORDER BY o DESC, k DESC LIMIT 1) UNION ALL (SELECT 'random', k FROM x ORDER BY sha256(k::VARCHAR), k LIMIT 1) UNION ALL (SELECT 'outlier', k FROM x, m ORDER BY round(abs(n - mean) / sd, 6) DESC, k LIMIT 1)""")
def _(spark, d):
    return metrics.samples(read(spark, d, "documents"), "doc_id", "source", "text").select("sample_type", "row_id")


_MIME_SQL = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{m}'" for e, m in tx.MIME.items()) + " ELSE 'application/octet-stream' END"
_EXT = ("pdf", "DOCX", "go", "py", "md", "txt", "bin", "sql", "html", "ts")


@query("route_mime", "SELECT doc_id, mime_type, CASE mime_type " + " ".join(f"WHEN '{m}' THEN '{w}'" for m, w in tx.ROUTES.items()) + f" END AS workflow_id FROM (SELECT doc_id, {_MIME_SQL} AS mime_type FROM (SELECT doc_id, lower('.' || {list(_EXT)!r}[(doc_id % 10 + 1)::BIGINT]) AS ext FROM documents))")
def _(spark, d):
    path = F.concat(F.lit("/data/f.v1/"), F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*[F.lit(e) for e in _EXT]), F.col("doc_id").cast("int") % 10))
    return fs.route(read(spark, d, "documents").select("doc_id", tx.mime_type(path).alias("mime_type")))


@query("pending_scan", "SELECT doc_id AS id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def _(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.when(F.col("lang") == "en", "pending").otherwise("chunked").alias("status"))
    return fs.pending(x).select("id", "source")


@query("export_rows", "SELECT doc_id AS id, source AS file_id, text AS content, length(text) // 4 AS token_count, 'semantic' AS chunk_type, 'files/' || source AS source_path FROM documents")
def _(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"), F.col("text").alias("content"), F.expr("cast(length(text) div 4 as bigint)").alias("token_count"), F.lit("semantic").alias("chunk_type"), F.col("doc_id").alias("position"))
    return fs.export(x, x.select(F.col("file_id").alias("id"), F.concat(F.lit("files/"), "file_id").alias("source_path")).distinct())


# --------------------------------------------------------------------------- relations, bus, manifest, events


@query("relations_follows", "SELECT conv_id || '-' || turn AS from_chunk_id, conv_id || '-' || nxt AS to_chunk_id, 'follows' AS relation_type, 1.0::DOUBLE AS weight FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def _(spark, d):
    x = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("file_id"), F.col("turn").alias("position"))
    return relations.follows(x)


@query("relations_parent_of", "SELECT DISTINCT a.n_nationkey AS from_chunk_id, b.n_nationkey AS to_chunk_id, 'parent_of' AS relation_type, 1.0::DOUBLE AS weight FROM nation a JOIN nation b ON b.n_regionkey = a.n_nationkey")
def _(spark, d):
    return relations.parent_of(read(spark, d, "nation"), "n_nationkey", "n_regionkey")


@query("relations_references", """SELECT DISTINCT a.p_partkey AS from_chunk_id, b.p_partkey AS to_chunk_id, 'references' AS relation_type, 1.0::DOUBLE AS weight
FROM (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(p_name, '[\\p{L}_][\\p{L}\\p{N}_]*'))) AS w FROM part) a JOIN part b ON a.w = regexp_extract(b.p_name, '^\\w+') WHERE a.p_partkey <> b.p_partkey""")
def _(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    names = p.select("id", F.regexp_extract("content", r"^\w+", 0).alias("name"))
    return relations.references(p, names)


@query("relations_similar_to")
def _(spark, d):
    return relations.similar_to(read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")))


@query("graph_degrees", "SELECT chunk_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT l_partkey AS chunk_id, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_suppkey, 0, 1 FROM lineitem) GROUP BY chunk_id")
def _(spark, d):
    return relations.degrees(read(spark, d, "lineitem").select(F.col("l_partkey").alias("from_chunk_id"), F.col("l_suppkey").alias("to_chunk_id")))


@query("graph_embed", f"""SELECT chunk_id, i::BIGINT AS idx, round(m / nullif(sqrt(sum(m * m) OVER (PARTITION BY chunk_id)), 0), 6) AS value FROM (SELECT a AS chunk_id, i, avg(x) AS m FROM (
SELECT DISTINCT a, b FROM (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings UNION ALL SELECT vec_id + 1, vec_id FROM embeddings)) JOIN (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {_E}) ON vec_id = b WHERE a IN (SELECT vec_id FROM embeddings) GROUP BY a, i) QUALIFY round(value, 6) <> 0""")
def _(spark, d):
    e = read(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    edges = e.select(F.col("vec_id").alias("from_chunk_id"), (F.col("vec_id") + 1).alias("to_chunk_id"), F.lit("follows").alias("relation_type"))
    dims = v.select(F.size("vector").alias("n")).first()["n"]
    return _sparse(vectorize.graph_embed(v, edges, ("follows",), dims), "chunk_id")


@query("task_fifo", "SELECT event_type AS zone, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.fifo(read(spark, d, "events").select(F.col("event_type").alias("zone"), "ts", F.col("event_id").alias("id")), "zone", ["ts", "id"]).select("zone", "id")


@query("heartbeat_latest", "SELECT user_id AS worker, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return metrics.latest(read(spark, d, "events").select(F.col("user_id").alias("worker"), "ts", "event_id"), "worker", "ts").select("worker", "event_id")


@query("pending_by_zone", "SELECT event_type AS zone, count(*) FILTER (user_id % 2 = 0) AS pending FROM events GROUP BY event_type")
def _(spark, d):
    from corpusmill import bus

    return bus.pending_by_zone(read(spark, d, "events").select(F.col("event_type").alias("zone"), F.when(F.col("user_id") % 2 == 0, "pending").otherwise("done").alias("status")))


@query("feedback_boost", "SELECT user_id AS chunk_id, count(*) AS n, round(1 + (count(*) FILTER (event_id % 4 = 2) + count(*) FILTER (event_id % 4 = 0) / 2 - count(*) FILTER (event_id % 4 = 3) - count(*) FILTER (event_id % 4 = 1) / 4) / (count(*) + 10), 6) AS boost FROM events GROUP BY user_id")
def _(spark, d):
    act = F.get(F.array(*[F.lit(x) for x in ("click", "ignore", "upvote", "downvote")]), (F.col("event_id") % 4).cast("int"))
    return search.feedback(read(spark, d, "events").select(F.col("user_id").alias("chunk_id"), act.alias("action"))).select("chunk_id", "n", F.round("boost", 6).alias("boost"))


@query("manifest_total", "SELECT source AS process, sha256(string_agg(h, '' ORDER BY doc_id)) AS total FROM (SELECT source, doc_id, sha256(text) AS h FROM documents) GROUP BY source")
def _(spark, d):
    from corpusmill import manifest

    x = read(spark, d, "documents").select(F.col("source").alias("process"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.lit("source").alias("kind"), F.sha2("text", 256).alias("sha256"))
    return manifest.total(x)


@query("manifest_verify", "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'new' END AS fault FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0")
def _(spark, d):
    from corpusmill import manifest

    x = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    was = x.where("doc_id % 11 <> 0 or doc_id % 7 = 0 or doc_id % 5 = 0")
    now = x.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("path") % 5 == 0, F.lit("other")).otherwise(F.col("sha256")))
    return manifest.verify(was, now)


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from corpusmill.streaming import events

    return events.counts(read(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sessions", """SELECT min(ts) AS session_start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(spark, d):
    from corpusmill.streaming import events

    return events.sessions(read(spark, d, "events")).select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), "user_id", "n")


# --------------------------------------------------------------------------- whole workflows


def _inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Files (the text workflow's input) and a corpus that knows every eleventh text."""
    x = read(spark, d, "documents")
    files = x.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "source", "doc_id").alias("source_path"), F.lit("text/plain").alias("mime_type"), F.lit("pending").alias("status"), F.col("text").alias("content"))
    return files, x.where("doc_id % 11 = 0").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.concat(F.col("text"), F.lit("\n")), 256).alias("hash"))


_BLOCKS = """(SELECT file_id, string_agg(u || chr(10), '' ORDER BY i) AS content, min(i) AS position FROM (
SELECT *, sum(CASE WHEN trim(u, ' ' || chr(9) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS b FROM (SELECT doc_id AS file_id, generate_subscripts(p, 1) AS i, unnest(p) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WHERE trim(u, ' ' || chr(9) || chr(13)) <> '' GROUP BY file_id, b)"""


@query("workflow_text", f"SELECT file_id::VARCHAR AS file_id, substr(sha256(content), 1, 32) AS id, sha256(content) AS content_hash, length(content) // 4 AS token_count FROM {_BLOCKS} WHERE length(content) // 4 BETWEEN 50 AND 512 AND sha256(content) NOT IN (SELECT sha256(text || chr(10)) FROM documents WHERE doc_id % 11 = 0)")
def _(spark, d):
    from corpusmill.plans import builtin, workflow

    files, known = _inputs(spark, d)
    env = workflow.compile_workflow(builtin.WORKFLOWS["text_chunking_v1"], {"_input": files, "corpus.chunks": known})
    return env["_output"].select("file_id", "id", "content_hash", "token_count")


#: The words of the search, none with another stem or among the stop words.
_ASKED = ("ther", "thon")
_PARTS = f"""(SELECT doc_id || '-' || i AS id, doc_id AS file_id, array_to_string(w[i * 150 + 1 : i * 150 + 200], ' ') AS content
FROM (SELECT doc_id, w, unnest(range(0, last + 1)) AS i FROM (SELECT doc_id, w, greatest(ceil((len(w) - 200) / 150), 0)::BIGINT AS last FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0)))"""


def _search_sql() -> str:
    """Every step in SQL: postings, bm25 over chunks with all words, the two layers of chunks and query, their weighted sum."""
    asked = "(" + ", ".join(f"('{w}')" for w in _ASKED) + ")"
    return f"""
WITH ch AS MATERIALIZED {_PARTS},
st AS ({_structure_rows("(SELECT id, content FROM ch UNION ALL SELECT 'q', '" + " ".join(_ASKED) + "')")}),
tk AS (SELECT id, unnest(t) AS term, len(t) AS total FROM (SELECT id, {_TOKENS.replace('text', 'content')} AS t FROM ch)),
ct AS MATERIALIZED (SELECT id, term, total, count(*) AS tf FROM tk GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(len({_TOKENS.replace('text', 'content')})) AS mean FROM ch),
df AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) / count(*)) AS idf FROM ct, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= floor(any_value(n) * 0.8)),
vo AS MATERIALIZED (SELECT term, df, idf, {_FNV1A.replace('(t)', '(term)')} % 256 AS idx, CASE WHEN {_FNV1.replace('(t)', '(term)')} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM df),
hit AS (SELECT id, term, tf, total, count(*) OVER (PARTITION BY term) AS df FROM ct WHERE term IN ({", ".join(f"'{w}'" for w in _ASKED)})),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * total / mean))) AS score FROM hit, n GROUP BY id HAVING count(*) = {len(_ASKED)}),
cand AS MATERIALIZED (SELECT id FROM bm ORDER BY round(score, 6) DESC, id LIMIT 1000),
lx AS (SELECT id, idx, sum(tf / total * idf * sign) AS x FROM ct JOIN cand USING (id) JOIN vo USING (term) GROUP BY id, idx),
lq AS (SELECT idx, sum(idf * sign / {len(_ASKED)}) AS x FROM vo WHERE term IN ({", ".join(f"'{w}'" for w in _ASKED)}) GROUP BY idx),
ln AS (SELECT id, sqrt(sum(x * x)) AS l FROM lx GROUP BY id),
cl AS (SELECT id, sum(lx.x * lq.x) / any_value(l) / (SELECT sqrt(sum(x * x)) FROM lq) AS lexical FROM lx JOIN lq USING (idx) JOIN ln USING (id) GROUP BY id),
cs AS (SELECT a.id, sum(a.x * b.x) AS structure FROM st a JOIN st b ON a.idx = b.idx WHERE b.id = 'q' AND a.id IN (SELECT id FROM cand) GROUP BY a.id),
al AS (SELECT id AS chunk_id, coalesce(structure, 0) AS structure, coalesce(lexical, 0) AS lexical, coalesce(structure, 0) * 0.45 + coalesce(lexical, 0) * 0.30 AS score FROM cand LEFT JOIN cs USING (id) LEFT JOIN cl USING (id))
SELECT chunk_id, round(score, 5) AS score, round(structure, 5) AS structure, round(lexical, 5) AS lexical, substr(content, 1, 200) AS snippet, file_id, 'files/' || file_id AS source_path
FROM al JOIN ch ON ch.id = chunk_id WHERE score >= 0.1 ORDER BY round(score, 6) DESC, chunk_id LIMIT 10"""


@query("search_e2e", _search_sql())
def _(spark, d):
    """The built-in search workflow over all documents, cut into overlapping windows."""
    x = contents(spark, d)
    cut = chunking.by_fixed_window(x, size=200, overlap=50)
    chunks = cut.select(F.concat_ws("-", "file_id", "position").alias("id"), "file_id", "content")
    sizes = chunks.select(F.size(tx.tokens(F.col("content"))).alias("n")).agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    at = scratch(spark, "postings")
    vectorize.terms(chunks).write.parquet(at)
    postings = spark.read.schema("id string, term string, total bigint, tf bigint").parquet(at)
    lexical = vectorize.tfidf(chunks, n_docs=sizes["n"], counted=postings)
    layers = vectorize.structure(chunks).withColumn("layer", F.lit("structure")).unionByName(lexical.withColumn("layer", F.lit("lexical")))
    files = x.select(F.col("id"), F.concat(F.lit("files/"), "id").alias("source_path"))
    q = " ".join(_ASKED)
    vecs = search.query_vectors(chunks, q, 256, vectorize.idf(postings, sizes["n"]), sizes["n"])
    out = search.search(chunks, layers, files, q, vecs, "default", 10, postings, None, (sizes["n"], sizes["mean"] or 1.0))
    each = F.from_json("layer_scores", "structure double, lexical double")
    return out.select("chunk_id", F.round("score", 5).alias("score"), *[F.round(each[n], 5).alias(n) for n in ("structure", "lexical")], "snippet", "file_id", "source_path")


# What the engine writes and keeps adds its own queries.
from corpusmill import queries_engine  # noqa: E402, F401
