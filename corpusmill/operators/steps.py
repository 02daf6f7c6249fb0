"""The step operations of a workflow, each from DataFrames to a lazy DataFrame."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx

_TAIL = re.compile(r"^(?P<where>.*?)(?:\s+order\s+by\s+(?P<order>.+?))?(?:\s+limit\s+(?P<limit>\d+))?\s*$", re.I | re.S)


_QUOTED = re.compile(r"('(?:[^']|'')*')")


def _call(text: str, name: str, start: str, end: str) -> str:
    """Each call name(...) as start...end, whatever brackets and literals are inside."""
    while m := re.search(rf"\b{name}\s*\(", text, re.I):
        depth, at, quoted = 1, m.end(), False
        while depth and at < len(text):
            quoted ^= text[at] == "'"
            depth += 0 if quoted else (text[at] == "(") - (text[at] == ")")
            at += 1
        if depth:
            raise ValueError(f"{name}( isn't closed")
        text = text[: m.start()] + start + text[m.end() : at - 1] + end + text[at:]
    return text


def to_spark_sql(text: str) -> str:
    """Text in the workflow dialect to Spark SQL: REAL is a double, / of whole numbers truncates, LIKE ignores case,
    json_object(k, v, ...) is the JSON of these, nulls kept, tokenize(t) the words of a text without stop words, and
    expand_tokens(ts) each word with its stem.

    String literals are left alone. Division counts as whole unless an operand is cast to REAL."""
    text = _call(text, "json_object", "to_json(named_struct_(", "), map('ignoreNullFields', 'false'))").replace("named_struct_(", "named_struct(")
    text = _call(text, "tokenize", tx.TOKENIZE_SQL[0], tx.TOKENIZE_SQL[1])
    text = _call(text, "expand_tokens", tx.EXPAND_SQL[0], tx.EXPAND_SQL[1])
    out = []
    for i, part in enumerate(_QUOTED.split(text)):
        if i % 2 == 0:
            part = re.sub(r"\bAS\s+REAL\b", "AS DOUBLE", part, flags=re.I)
            part = re.sub(r"\bLIKE\b", "ILIKE", part, flags=re.I)
            part = re.sub(r"(length\([^()]*\))\s*/\s*(\d+)", r"\1 div \2", part, flags=re.I)
        out.append(part)
    return "".join(out)


def literal(value) -> str:
    """A parameter's value as SQL: null, booleans, numbers, texts, dates and times, lists of these."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value) + ("D" if isinstance(value, float) else "")
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(literal, value)) + ")"
    text = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"timestamp{text}" if isinstance(value, dt.datetime) else f"date{text}" if isinstance(value, dt.date) else text


def bind(text: str, params: dict | list | tuple | None) -> str:
    """:name by the values of a dict, ? by those of a list in order; not inside literals. A missing value: KeyError, IndexError."""
    if not params:
        return text
    out, left = [], list(params) if isinstance(params, (list, tuple)) else []
    for i, part in enumerate(_QUOTED.split(text)):
        if i % 2 == 0 and isinstance(params, dict):
            part = re.sub(r"(?<![:\w]):(\w+)", lambda m: literal(params[m[1]]), part)
        elif i % 2 == 0:
            part = re.sub(r"\?", lambda _: literal(left.pop(0)), part)
        out.append(part)
    return "".join(out)


def filter_rows(df: DataFrame, predicate: str | None, params: dict | list | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows for which the predicate holds; it may end in ORDER BY and LIMIT; none keeps all. :name and ? are parameters.

    `column NOT IN (SELECT hash FROM table)` becomes an anti join, since hashes are never null."""
    if not predicate or predicate.strip() in ("", "1=1"):
        return df
    predicate = bind(to_spark_sql(predicate), params)
    m = re.fullmatch(r"\s*(\w+)\s+NOT\s+IN\s+\(\s*SELECT\s+(\w+)\s+FROM\s+([\w.]+)\s*\)\s*", predicate, re.I)
    if m and views and m[3] in views:
        return anti(df, views[m[3]].select(F.col(m[2]).alias(m[1])), [m[1]])
    part = _TAIL.match(predicate)
    out = df.where(part["where"]) if part["where"].strip() else df
    if part["order"]:
        out = out.orderBy(*[F.expr(re.sub(r"\s+(asc|desc)\s*$", "", o, flags=re.I)).desc() if re.search(r"\sdesc\s*$", o, re.I) else F.expr(re.sub(r"\s+asc\s*$", "", o, flags=re.I)).asc() for o in split_list(part["order"])])
    return out.limit(int(part["limit"])) if part["limit"] else out


def project(df: DataFrame, select: str | None, params: dict | list | None = None) -> DataFrame:
    if not select or select.strip() == "*":
        return df
    return df.selectExpr(*split_list(bind(to_spark_sql(select), params)))


def split_list(text: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(text[at:i].strip())
                at = i + 1
    return [*out, text[at:].strip()]


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equi-join; columns of the right side that the left one has too get a suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    for c in clash:
        right = right.withColumnRenamed(c, c + suffix)
    return left.join(right, on, how)


_CLAUSE = re.compile(r"\s*(?:(inner|left|right|full|cross|left\s+semi|left\s+anti)\s+)?(?:outer\s+)?join\s+([\w.]+)(?:\s+(?:as\s+)?(?!on\b)(\w+))?(?:\s+on\s+(.*?))?(?=\s+(?:(?:inner|left|right|full|cross)\s+)?(?:outer\s+)?(?:semi\s+|anti\s+)?join\s|\s*$)", re.I | re.S)


def join_clauses(left: DataFrame, name: str, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The source (called name) joined as one or more whole JOIN clauses say. Of columns that both sides have, the first keeps
    its name, the others are called alias_column."""
    out, parts, at = left.alias(name), [(name, left.columns)], 0
    text = to_spark_sql(text.strip())
    while at < len(text):
        m = _CLAUSE.match(text, at)
        if not m:
            raise ValueError(f"not a JOIN clause: {text[at : at + 60]}")
        kind, table, alias, on = m[1] or "inner", m[2], m[3] or m[2].rsplit(".", 1)[-1], m[4]
        right, how = tables[table], re.sub(r"\s+", "_", kind.lower())
        out = out.crossJoin(right.alias(alias)) if on is None else out.join(right.alias(alias), F.expr(on), how)
        if how not in ("left_semi", "left_anti"):
            parts.append((alias, right.columns))
        at = m.end()
    seen: set[str] = set()
    cols = []
    for alias, names in parts:
        for c in names:
            cols.append(F.col(f"{alias}.`{c}`").alias(f"{alias}_{c}" if c.lower() in seen else c))
            seen.add(c.lower())
    return out.select(*cols)


def semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def add_features(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Aggregate in feature mode: named expressions per row, all input columns kept."""
    return df.selectExpr("*", *[f"{e} as `{n}`" for n, e in features.items()])


def aggregate(df: DataFrame, select: str | None = None, group_by: list[str] | None = None, functions: dict[str, str] | None = None) -> DataFrame:
    """Aggregate in SQL mode (a select list over the whole table), or declared functions by group."""
    if functions:
        return df.groupBy(*(group_by or [])).agg(*[F.expr(to_spark_sql(e)).alias(n) for n, e in functions.items()])
    return df.selectExpr(*[to_spark_sql(x) for x in split_list(select or "count(*) as n")])


def window(df: DataFrame, min_tokens: int = 50, max_tokens: int = 512, order: tuple[str, ...] = ("position", "file_id", "id")) -> DataFrame:
    """Rows of min to max approximate tokens, numbered in order as chunk_position.

    The number is global, by ranges of the whole order (see numbered), so no task sees all rows, nor all first chunks.
    Approximate tokens are length div 4 where the column is missing."""
    if "approx_tokens" not in df.columns:
        df = df.withColumn("approx_tokens", F.expr("cast(length(content) div 4 as bigint)"))
    kept = df.where(F.col("approx_tokens").between(min_tokens, max_tokens))
    return numbered(kept, [c for c in order if c in df.columns], "chunk_position")


#: Most cells of a global numbering, and rows that their bounds are chosen from.
CELLS, PICKED = 256, 4096


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Global row numbers from 1 in the given order.

    Bounds picked from the rows cut the whole order into at most CELLS ranges of like sizes; ranges are counted, and rows are
    numbered inside their range and shifted by the counts before it. Which bounds are picked changes no number. Picking them
    is one job over the order's columns."""
    key = F.struct(*[F.col(c) for c in order])
    picked = df.select(key.alias("k")).distinct().orderBy(F.xxhash64("k")).limit(PICKED)  # the smallest hashes: kept in each task, no sort of all
    bounds = picked.agg(F.sort_array(F.collect_list("k")).alias("_all")).select(F.expr(f"transform(filter(sequence(1, {CELLS} - 1), i -> size(_all) >= {CELLS} or i < size(_all)), i -> get(_all, if(size(_all) < {CELLS}, i, cast(floor(i * size(_all) / {CELLS}) as int))))").alias("_bounds"))
    bounds = df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)  # one row, at most CELLS bounds
    cell = F.size(F.filter("_bounds", lambda b: b <= key))
    celled = df.join(F.broadcast(bounds)).withColumn("_cell", cell).drop("_bounds")
    counts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # at most CELLS rows
    out = celled.withColumn("_i", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)).cast("bigint")).join(F.broadcast(counts), "_cell")
    return out.withColumn(name, F.col("_i") + F.col("_before")).drop("_cell", "_i", "_before")


def hash_placeholder(df: DataFrame, output: str = "hash") -> DataFrame:
    """The hash step without a declared algorithm: 64 zeros."""
    return df.withColumn(output, F.repeat(F.lit("00"), F.lit(32)))


def hash_columns(df: DataFrame, columns: list[str], algorithm: str = "sha256", output: str = "hash") -> DataFrame:
    """SHA-256 (hex), FNV-1a of 32 bits (8 hex digits) or xxHash64 (16) of the columns, joined by unit separators."""
    whole = F.col(columns[0]) if len(columns) == 1 else F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    made = {"sha256": lambda: F.sha2(whole, 256), "fnv": lambda: F.lpad(F.lower(F.hex(tx.fnv(whole))), 8, "0"), "xxhash": lambda: F.lpad(F.lower(F.hex(F.xxhash64(whole))), 16, "0")}
    if algorithm not in made:
        raise ValueError(f"unknown hash algorithm {algorithm}")
    return df.withColumn(output, made[algorithm]())


def fork(df: DataFrame, branches: dict[str, str]) -> dict[str, DataFrame]:
    """Branches by predicate over one source."""
    return {name: filter_rows(df, p) for name, p in branches.items()}


def merge(frames: list[DataFrame]) -> DataFrame:
    """Union of branches by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows before, after, lost, gained (by distinct key), type, score 1 - after / before, Jaccard of the keys."""
    a = before.groupBy(key).agg(F.count(F.lit(1)).alias("na"))
    b = after.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, key, "full")
    out = both.agg(
        F.coalesce(F.sum("na"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce(F.sum("nb"), F.lit(0)).cast("bigint").alias("rows_after"),
        F.count_if(F.col("nb").isNull()).alias("rows_lost"),
        F.count_if(F.col("na").isNull()).alias("rows_gained"),
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("_both"),
        F.count(F.lit(1)).alias("_all"),
    )
    kind = F.when(F.col("rows_after") < F.col("rows_before"), "reduction").when(F.col("rows_after") > F.col("rows_before"), "expansion").otherwise("transformation")
    return out.select("rows_before", "rows_after", "rows_lost", "rows_gained", kind.alias("delta_type"), delta_score("rows_before", "rows_after").alias("delta_score"), F.when(F.col("_all") > 0, F.col("_both") / F.nullif(F.col("_all"), F.lit(0))).alias("jaccard_index"))


def diff_samples(before: DataFrame, after: DataFrame, key: str = "id", n: int = 5) -> DataFrame:
    """One row: the n smallest keys that were lost and gained, as JSON arrays of texts."""

    def some(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        only = a.select(key).distinct().join(b.select(key), key, "left_anti").orderBy(key).limit(n)
        return only.agg(F.to_json(F.sort_array(F.collect_list(F.col(key).cast("string")))).alias(name))

    return some(before, after, "sample_lost").join(some(after, before, "sample_gained"))


def delta_score(before: str, after: str):
    """1 - after / before; null for an empty source; negative on expansion."""
    return F.when(F.col(before) > 0, 1 - F.col(after).cast("double") / F.nullif(F.col(before), F.lit(0)))


def config_of(text: str | dict | None) -> dict:
    return text if isinstance(text, dict) else json.loads(text) if text else {}
