"""N-gram Jaccard join by MinHash banding (operator 1).

Texts with the same set of word 5-grams form a class. Classes are sketched by MinHash and cut into bands; classes that share
a band meet in clusters by way of the smallest member of each band bucket. Inside a cluster, full n-gram sets are compared,
in blocks of a bounded size, so every pair of a cluster is verified and none is emitted as a row: blocks return how many
texts each class is linked to, and who hangs together. At the similarity sought, 32 bands of 7 rows find a pair with
probability 0.9995, and two texts of similarity 0.3 meet with less than 0.01.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import aside, cut, discard, small, small_batches, table, temporary, whole_key

N, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 7
#: Classes of a block: BLOCK, for clusters over BLOCK * 64 up to MOST_BLOCK; and n-grams of a block.
BLOCK, MOST_BLOCK, BLOCK_GRAMS = 64, 2048, 1_000_000
_RNG = np.random.Generator(np.random.PCG64(7))
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]
_TURN = (_RNG.integers(0, 2**32, BANDS * ROWS, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ODD = _RNG.integers(0, 2**63, N, np.uint64) | np.uint64(1)


class _Words(dict):
    """Hashes of words, remembered within a bound; a task forgets them at its end."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_WORDS = _Words()


def grams(raw: bytes, n: int = N) -> np.ndarray:
    """Sorted 64-bit hashes of the set of word n-grams; a text of fewer words is one gram, one of none has none."""
    words = raw.split()  # of bytes: splits at ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(words))], np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size, h = len(words) - n + 1, np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ (h >> np.uint64(32))) * _ODD[0] + (w[j : j + size] ^ (w[j : j + size] >> np.uint64(29))) * _ODD[j]
    return np.unique((h ^ (h >> np.uint64(31))) * _ODD[1])


def bands(own: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the MinHash sketch."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, ((x[None, i : i + 4096] ^ _FLIP) * _TURN).min(1))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets, texts, sizes, keys = [], [], [], []
        for t in b.column(1):
            raw = (t.as_py() or "").encode()
            own = grams(raw)
            texts.append(xxhash.xxh3_128_digest(raw))
            sets.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sizes.append(len(own))
            keys.append(bands(own) if len(own) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.binary()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "hash", "grams_id", "text_id", "n_grams", "bands"])
    _WORDS.clear()


def components(pairs: DataFrame) -> DataFrame:
    """From rows (leader, node), each leader also its own node: (node, label), the smallest id that a node hangs together with.

    Labels spread from node to leader to node and then jump to the label of the label, so chains shorten by powers of two."""
    edges = cut(pairs.select("leader", "node").distinct(), "cc-edges")
    label = cut(edges.groupBy("node").agg(F.min("leader").alias("label")), "cc-label")
    total = None
    while True:
        of_leader = edges.join(label, "node").groupBy("leader").agg(F.min("label").alias("label"))
        spread = edges.join(of_leader, "leader").groupBy("node").agg(F.min("label").alias("label"))
        spread = cut(spread, "cc-spread")
        jumped = spread.alias("a").join(spread.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        new = cut(jumped.select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-label")
        discard(label)
        discard(spread)
        label = new
        now = label.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total:  # labels only fall
            return label
        total = now


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, i, j): one group after the other, of at most two blocks."""
    key, held = None, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["leader", "node", "links"])

    ready: list[tuple] = []
    for b in batches:
        at = [b.column(c).to_numpy() for c in range(3)]
        nid, blk, weight, digest = b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy(), b.column(6)
        sets = b.column(7)
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        for r in range(b.num_rows):
            k = (at[0][r], at[1][r], at[2][r])
            if k != key:
                ready += _linked(key, held)
                key, held = k, []
                if len(ready) > 50_000:
                    yield out(ready)
                    ready = []
            held.append((int(nid[r]), digest[r].as_py(), int(blk[r]), int(weight[r]), values[offsets[r] : offsets[r + 1]].copy()))
    ready += _linked(key, held)
    yield out(ready)


def _linked(key: tuple | None, held: list[tuple]) -> list[tuple]:
    """Of one group: (leader, node, links) of the classes with a link, where leader is the smallest id of those that hang together here."""
    rows = list({(n, d): x for x in held for n, d in [x[:2]]}.values())
    if len(rows) < 2:
        return []
    m = len(rows)
    nid, blk, weight = (np.array([x[i] for x in rows], np.int64) for i in (0, 2, 3))
    size = np.array([len(x[4]) for x in rows], np.int64)
    if m <= 6:
        both = np.zeros((m, m), np.int64)
        for a in range(m):
            for b in range(a + 1, m):
                both[a, b] = both[b, a] = len(np.intersect1d(rows[a][4], rows[b][4], assume_unique=True))
    else:
        _, at, times = np.unique(np.concatenate([x[4] for x in rows]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), size)
        everywhere = np.count_nonzero(times == m)
        shared = (times > 1) & (times < m)
        place = np.cumsum(shared) - 1
        keep = shared[at]
        owner, at = owner[keep], place[at[keep]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        both = np.full((m, m), everywhere, np.int64)
        for i in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(at, (i, i + 4096))
            d = np.zeros((m, 4096), np.float32)
            d[owner[lo:hi], at[lo:hi] - i] = 1
            both += (d @ d.T).astype(np.int64)
    near = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    if key[1] != key[2]:
        near &= blk[:, None] != blk[None, :]
    links = near @ weight
    label, big = nid.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(near, label[None, :], big).min(1))
        if (new == label).all():
            break
        label = new
    return [(int(label[i]), int(nid[i]), int(links[i])) for i in np.flatnonzero(near.any(1))]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of candidate rows to n-gram sets; rows whose class differs (an id that several texts have) drop out later."""
    for b in batches:
        i = b.schema.get_field_index("_text")
        own = [grams((t.as_py() or "").encode()) for t in b.column(i)]
        cols = [b.column(j) for j in range(b.num_columns) if j != i]
        names = [n for n in b.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "is_id", "grams"])
    _WORDS.clear()


def _similar(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with rid and _hash (of the text), and of each: rid, hash, group (a node's label, or null for a text without
    n-grams), class_id, copy_of, n_links.

    A node is a class of texts, named by its smallest rid, or by a hash of its n-grams if another class has the same rid."""
    small_batches(df.sparkSession)
    own, name = aside(df)
    text = F.col(name[text]).cast("string")
    kind = df.schema[key].dataType.simpleString()
    docs = own.select("*", F.coalesce(whole_key(F.col(name[key]), kind), F.xxhash64(text)).alias("rid"), F.xxhash64(text).alias("hash"), text.alias("_text"))
    rows = cut(docs.select("rid", "_text", "hash").mapInArrow(_sketch, "rid bigint, hash bigint, grams_id binary, text_id binary, n_grams bigint, bands array<bigint>"), "sketch")

    with temporary() as keep:
        some = rows.where("grams_id is not null")
        texts = some.groupBy("grams_id", "text_id").agg(F.min("rid").alias("rid"))
        classes = cut(texts.groupBy("grams_id").agg(F.min("rid").alias("low"), F.count(F.lit(1)).alias("n_texts")), "classes")
        shared = classes.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low", F.lit(True).alias("shared"))
        shared = small(shared, shared.count())
        classes = cut(classes.join(shared, "low", "left").select("grams_id", "low", "n_texts", F.when(F.col("shared"), F.xxhash64("grams_id")).otherwise(F.col("low")).alias("nid")), "classes")
        first = some.join(classes.withColumnRenamed("low", "rid"), ["grams_id", "rid"]).select("nid", "bands")

        keys = cut(first.select("nid", F.explode("bands").alias("band")).distinct(), "band-keys")
        met = keys.groupBy("band").agg(F.min("nid").alias("leader"), F.max("nid").alias("last")).where("leader < last").select("band", "leader")
        stars = keys.join(met, "band").select("leader", F.col("nid").alias("node"))
        label = components(stars)
        discard(keys)
        n = label.count()

        members = some.select("grams_id", "rid", "n_grams").join(classes.withColumnRenamed("low", "rid"), ["grams_id", "rid"]).distinct()
        members = members.join(small(label.withColumnRenamed("node", "nid"), n), "nid")
        sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("w"))
        block = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.floor(F.col("m") / 64)))
        sizes = sizes.select("label", F.greatest(F.lit(1), F.ceil(F.col("m") / block), F.ceil(F.col("w") / BLOCK_GRAMS)).cast("int").alias("nb"))
        members = cut(members.join(sizes, "label").select("rid", "nid", "grams_id", "n_texts", "label", "nb", F.pmod(F.xxhash64("nid"), F.col("nb")).cast("int").alias("blk")), "members")
        near = docs.select("rid", "_text").join(small(members, n), "rid").select("nid", "grams_id", "n_texts", "label", "nb", "blk", "_text").mapInArrow(_gather, "nid bigint, grams_id binary, n_texts bigint, label bigint, nb int, blk int, is_id binary, grams array<bigint>")
        near = near.where("is_id = grams_id").withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        near = near.select("label", F.least("blk", "_x").cast("long").alias("i"), F.greatest("blk", "_x").cast("long").alias("j"), "nid", "blk", "n_texts", "grams_id", "grams")
        near = near.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
        links = cut(near.mapInArrow(_verify, "leader bigint, node bigint, links bigint"), "links")

        groups = components(links.select("leader", "node"))
        counts = links.groupBy("node").agg(F.sum("links").alias("links")).join(groups, "node").withColumnRenamed("node", "nid")
        told = cut(classes.join(counts, "nid", "left").select("grams_id", "low", "n_texts", F.coalesce("label", "nid").alias("group"), "links"), "told")
        ids = told.where("links is not null").groupBy("group").agg(F.min("low").alias("class_id"))
        told = keep(cut(told.join(ids, "group", "left").select("grams_id", "low", "n_texts", "group", "links", F.coalesce("class_id", "low").alias("class_id")), "told"))
    out = rows.select("rid", "hash", "grams_id").join(told, "grams_id", "left")
    links = (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n_texts") - 1, F.lit(0))).cast("long")
    return docs.drop("_text"), out.select("rid", "hash", "group", F.coalesce("class_id", "rid").alias("class_id"), F.coalesce("low", "rid").alias("copy_of"), links.alias("n_links"))


def join_similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, class_id, copy_of, n_links for every row.

    rid is the key (a key that is no whole number: its hash), or where it is null a hash of the text. class_id: the smallest
    rid of all that the row hangs together with by links of similarity 0.8 or more (itself, without links). copy_of: the
    smallest rid of the texts with the same n-gram set. n_links: other texts, different as texts, of similarity 0.8 or more.
    Null, empty and blank texts have no n-grams and no links. Repeated rows fall into one class; different texts under one
    key go by themselves. Empty table: empty result. Other columns are ignored, whatever their names.
    """
    return _similar(df, key, text)[1].select("rid", "class_id", "copy_of", "n_links")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group that hangs together, the one of the smallest rid, with the columns of the input.

    Rows whose texts have no n-grams all stay. Different texts under one key are told apart; of rows that share key and text,
    the one of the smallest hash stays. Empty table: empty result. Reruns agree."""
    docs, told = _similar(df, key, text)
    told = cut(told, "groups").where("group is not null")
    first = told.groupBy("group").agg(F.min(F.struct("rid", "hash")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = cut(first, "first")
    gone = told.join(small(first, first.count()), "group").where(F.struct("rid", "hash") != F.col("first")).select("rid", "hash").distinct()
    gone = cut(gone, "gone")
    left = docs.join(small(gone, gone.count()), ["rid", "hash"], "left_anti")
    again = told.groupBy("rid", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid", "hash")
    again = cut(again.join(gone, ["rid", "hash"], "left_anti"), "again")
    names = [c for c in docs.columns if c not in ("rid", "hash")]
    if again.head(1):  # rows that share key and text: one of each, by a partial minimum
        marked = left.join(small(again.withColumn("_again", F.lit(True)), again.count()), ["rid", "hash"], "left")
        plain = [c for c in names if not _unordered(docs.schema[c].dataType)]
        one = marked.where("_again").groupBy("rid", "hash").agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("_one")).select("_one.*")
        left = marked.where("_again is null").select(*names).unionByName(one)
    return left.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)])


def _unordered(kind: T.DataType) -> bool:
    """Types that can't be hashed."""
    return any(x in kind.simpleString() for x in ("map<", "variant"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join_similar(table(spark, sf_dir, "documents"))
    return out.select(F.col("rid").alias("doc_id"), "class_id", "copy_of", "n_links")


QUERIES = {"op1_ngram_jaccard": op1}
ORACLES = {
    # Every pair of texts with a 5-gram in common, exactly; what hangs together by a recursive closure.
    "op1_ngram_jaccard": """
WITH RECURSIVE t AS MATERIALIZED (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
g AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
r AS (SELECT id, id AS far FROM t UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.far),
c AS (SELECT id, min(far) AS class_id FROM r GROUP BY id),
m AS (SELECT t.id, count(l.b) AS n_links, least(t.id, coalesce(min(l.b) FILTER (l.same), t.id)) AS copy_of FROM t LEFT JOIN l ON l.a = t.id GROUP BY t.id)
SELECT d.doc_id, CASE WHEN n.id IS NULL THEN d.doc_id ELSE c.class_id END AS class_id, CASE WHEN n.id IS NULL THEN d.doc_id ELSE m.copy_of END AS copy_of, coalesce(m.n_links, 0) AS n_links
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN n ON n.id = t.id LEFT JOIN c ON c.id = t.id LEFT JOIN m ON m.id = t.id"""
}
