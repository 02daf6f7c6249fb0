"""Mixing sources to target weights by systematic sampling (operator 9, native).

Every document of a source expects the same number of copies, target / size of the source. Documents stand in a fixed order
within the source, by size, so the prefix sum of expected copies is that number times the rank; one offset per source is
added, and a document is emitted once for each integer boundary that its stretch crosses. Ranks come from counts of small
ordered cells (source, size class, part) plus a row number inside the cell, so no task holds a source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import aside, cut, n_words, small, table

#: Parts of a size class, so that a source of equal sizes doesn't meet in one task.
PARTS = 64


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> dict[str | None, Fraction]:
    """Words that each source gives: shares by weight, at most cap times its size, the excess shared again by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weigh[s] for s in open_)
        over = [s for s in open_ if left * weigh[s] / whole > cap * sizes[s]]
        if not over:
            return out | {s: left * weigh[s] / whole for s in open_}
        for s in over:
            out[s] = Fraction(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _cells(source: Column, size: Column, key: Column, text: Column) -> list[Column]:
    """Source key, ordered size class (bit length and the four bits below the first) and part."""
    bits = F.length(F.bin(size))
    top = F.when(bits > 4, F.expr("shiftright(_size, length(bin(_size)) - 5) & 15L")).otherwise(size)
    return [
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("_src"),
        (bits * 16 + top).cast("int").alias("_class"),
        (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), size, F.md5(F.coalesce(text, F.lit(""))))), 1, 4), 16, 10).cast("int") % PARTS).alias("_part"),
    ]


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """Add size (words), source_size, target (words, of the source) and copies to every row; a rerun gives the same.

    Null text: size 0. Null source: a source of its own, last in order. A source without words: target 0, no copies.
    Repeated rows and equal or null keys: each row stands for itself, in the order of a hash of the whole row, so that the
    order of the input changes nothing. Empty table: empty result. Columns of these names that the input has are replaced;
    other names can't clash. The number of sources is taken to be small (their totals come to the driver), rows per source
    aren't.
    """
    spark = df.sparkSession
    new = {"size", "source_size", "target", "copies"}
    own, name = aside(df)
    plain = [name[c] for c in df.columns if not any(x in df.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    sized = own.select("*", n_words(F.col(name[text])).alias("_size"), F.xxhash64(*plain).alias("_tie"))
    sized = sized.select("*", *_cells(F.col(name[source]), F.col("_size"), F.col(name[key]), F.col(name[text])))
    cells = cut(sized.groupBy("_src", "_class", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words")), "mix-cells")

    totals = {r["_src"]: r for r in cells.groupBy("_src").agg(F.sum("words").alias("words")).collect()}
    sizes = {None if s == "n" else s[1:]: int(r["words"]) for s, r in totals.items()}
    goal = targets(sizes, weights, cap)
    rows = [("n" if s is None else "s" + s, sizes[s], float(goal[s]), float(goal[s] / sizes[s]) if sizes[s] else 0.0) for s in sizes]
    plan = spark.createDataFrame(rows, "_src string, source_size bigint, target double, _expected double")
    plan = plan.withColumn("_offset", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_src")), 1, 8), 16, 10).cast("double") / 4294967296.0)

    classes = cells.groupBy("_src", "_class").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("_src").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("_src", "_class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_src", "_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("_src", "_class", "_part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_in")).join(classes, ["_src", "_class"])
    base = base.select("_src", "_class", "_part", (F.col("_before") + F.col("_in")).cast("long").alias("_base"))

    order = Window.partitionBy("_src", "_class", "_part").orderBy("_size", F.col(name[key]), "_tie")
    ranked = sized.withColumn("_rank", F.row_number().over(order).cast("long") - 1).join(base, ["_src", "_class", "_part"]).join(small(plan, len(rows)), "_src")
    at = F.col("_base") + F.col("_rank")
    copies = F.floor((at + 1) * F.col("_expected") + F.col("_offset")) - F.floor(at * F.col("_expected") + F.col("_offset"))
    kept = [F.col(name[c]).alias(c) for c in df.columns if c not in new]
    return ranked.select(*kept, F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies."""
    return mixed.withColumn("_copy", F.explode(F.expr("if(copies > 0, sequence(1L, copies), array())"))).drop("_copy")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op9_systematic_mix": op9}
ORACLES = {
    # Shares by weight, capped in the order of how soon a source reaches its cap; ranks by size class, part, size and id.
    "op9_systematic_mix": """
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT source, words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, (sum(words) OVER () - coalesce(sum(3 * words) OVER a, 0))::BIGINT AS rest, sum(w) OVER (ORDER BY 3 * words::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
      FROM w WINDOW a AS (ORDER BY 3 * words::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rest * w > 3 * words * open AS capped FROM o),
f AS (SELECT coalesce(arg_min(rest, 3 * words::DOUBLE / w) FILTER (NOT capped), 0) AS rest, coalesce(max(open) FILTER (NOT capped), 1) AS open FROM c),
t AS (SELECT source, words, CASE WHEN capped THEN 3.0::DOUBLE * words ELSE (f.rest * w)::DOUBLE / f.open END AS target,
      CASE WHEN words = 0 THEN 0 WHEN capped THEN 3 ELSE (f.rest * w)::DOUBLE / (f.open * words) END AS e,
      ('0x' || substr(md5('17:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, f),
k AS (SELECT *, bit_length(bin(size)) // 8 AS bits, ('0x' || substr(md5(doc_id || ':' || size || ':' || digest), 1, 4))::BIGINT % 64 AS part FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bits * 16 + CASE WHEN bits > 4 THEN (size >> (bits - 5)) & 15 ELSE size END, part, size, doc_id) - 1 AS rank FROM k)
SELECT doc_id, size, words AS source_size, target, ((floor((rank + 1) * e + u) - floor(rank * e + u)) * size)::BIGINT AS taken FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source"""
}
