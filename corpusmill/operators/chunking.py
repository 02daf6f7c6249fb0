"""Chunkers: blocks, sentences, fixed windows, semantic packing. All are row-local array expressions, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import vectors as vc

#: Parse rules: kinds of units by how they begin, first match wins.
RULES = (("heading", r"^#{1,6}\s+"), ("list_item", r"^\s*[-*+]\s+"), ("list_item", r"^\s*\d+\.\s+"), ("blockquote", r"^>\s+"), ("code_block", r"^```"))


def unit_type(text: Column) -> Column:
    out = F.lit("paragraph")
    for kind, pattern in reversed(RULES):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def heading_level(text: Column) -> Column:
    return F.when(text.rlike(r"^#{1,6}\s+"), F.length(F.regexp_extract(text, "^(#+)", 1))).otherwise(0)


def paragraphs(text: Column) -> Column:
    """Runs of lines that aren't blank, each line trimmed, joined by one blank."""
    blocks = F.split(text, r"\n(?:[^\S\n]*\n)+", -1)
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n", -1), lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")), lambda line: line != ""), " "))
    return F.filter(joined, lambda b: b != "")


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def _rows(df: DataFrame, pieces: Column, key: str, kind: str) -> DataFrame:
    out = df.select(F.col(key).alias("file_id"), F.posexplode(pieces).alias("position", "content"))
    return out.select("file_id", F.col("position").cast("bigint").alias("position"), "content", F.expr("cast(length(content) div 4 as bigint)").alias("token_count"), F.lit(kind).alias("chunk_type"))


def by_paragraph(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    return _rows(df, paragraphs(F.col(text)), key, "paragraph")


def by_sentence(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    return _rows(df, sentences(F.col(text)), key, "sentence")


def by_fixed_window(df: DataFrame, key: str = "id", text: str = "content", size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of `size` words that advance by size - overlap; the last one reaches the last word."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    read = df.select(F.col(key).alias("file_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / F.lit(step)), F.lit(0)).cast("int")
    pieces = vc.bind(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ")))
    out = read.withColumn("last", last).select("file_id", "last", F.posexplode(pieces).alias("i", "content"))
    return out.select(
        "file_id",
        F.col("i").cast("bigint").alias("position"),
        "content",
        F.expr("cast(length(content) div 4 as bigint)").alias("token_count"),
        F.lit("fixed_window").alias("chunk_type"),
        F.when(F.col("i") > 0, overlap).otherwise(0).cast("bigint").alias("overlap_prev"),
        F.when(F.col("i") < F.col("last"), overlap).otherwise(0).cast("bigint").alias("overlap_next"),
    )


HEADING = r"^#{1,6}\s+"


def pack(units: Column, max_tokens: int = 512, min_tokens: int = 50, sep: str = "\n\n", markers: tuple[str, ...] = (HEADING,), overlap: int = 0) -> Column:
    """Semantic chunks of an array of units: in order, a new chunk at a unit that starts like a marker or wouldn't fit; too small
    ones dropped. With an overlap, a chunk opened for want of room begins with the last units of the one before that fit it.

    The packing is sequential inside a text: a fold over the text's own units, whose state is the finished chunks and the open one."""
    texts = F.array().cast("array<string>")
    zero = F.struct(texts.alias("done"), texts.alias("open"), F.lit(0).cast("bigint").alias("t"))

    def tokens(x: Column) -> Column:
        return F.floor(F.length(x) / 4).cast("bigint")

    def tail(xs: Column) -> Column:
        if overlap <= 0:
            return texts
        start = F.struct(texts.alias("kept"), F.lit(0).cast("bigint").alias("t"), F.lit(True).alias("go"))

        def back(a: Column, x: Column) -> Column:
            fits = a["go"] & (a["t"] + tokens(x) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(x), a["kept"])).otherwise(a["kept"]).alias("kept"), F.when(fits, a["t"] + tokens(x)).otherwise(a["t"]).alias("t"), fits.alias("go"))

        return F.aggregate(F.reverse(xs), start, back, lambda a: a["kept"])

    def step(s: Column, x: Column) -> Column:
        marked = F.lit(False)
        for m in markers:
            marked = marked | x.rlike(m)
        full = s["t"] + tokens(x) > max_tokens
        new = (F.size(s["open"]) > 0) & (marked | full)
        head = F.when(new & ~marked, tail(s["open"])).when(new, texts).otherwise(s["open"])
        now = F.concat(head, F.array(x))
        size = F.aggregate(now, F.lit(0).cast("bigint"), lambda a, y: a + tokens(y)) if overlap > 0 else F.when(new, tokens(x)).otherwise(s["t"] + tokens(x))
        return F.struct(F.when(new, F.concat(s["done"], F.array(F.array_join(s["open"], sep)))).otherwise(s["done"]).alias("done"), now.alias("open"), size.alias("t"))

    whole = F.aggregate(units, zero, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], sep)))).otherwise(s["done"]))
    return whole


def by_packing(df: DataFrame, key: str = "id", text: str = "content", max_tokens: int = 512, min_tokens: int = 50, units: Column | None = None, sep: str = "\n\n", markers: tuple[str, ...] = (HEADING,), overlap: int = 0) -> DataFrame:
    """The chunks of pack(), numbered within their text before small ones are dropped."""
    u = units if units is not None else paragraphs(F.col(text))
    out = df.select(F.col(key).alias("file_id"), u.alias("u")).select("file_id", F.posexplode(pack(F.col("u"), max_tokens, min_tokens, sep, markers, overlap)).alias("i", "content"))
    out = out.select("file_id", F.col("i").cast("bigint").alias("position"), "content", F.expr("cast(length(content) div 4 as bigint)").alias("token_count")).where(F.col("token_count") >= min_tokens)
    return out.withColumn("chunk_type", F.lit("semantic"))


CHUNKERS = {"paragraph": by_paragraph, "sentence": by_sentence, "fixed_window": by_fixed_window, "semantic": by_packing}


def declared(df: DataFrame, config: dict) -> DataFrame:
    """Chunks of whole files by a declared strategy: semantic, fixed_window, sentence or paragraph, with max_tokens, min_tokens,
    overlap_tokens and boundary_markers (patterns of the first words of a unit).

    A file's segments, in order, are gathered into one row. Other columns of the segments are left out; the id of a chunk is
    the first half of the SHA-256 of its content, its position its number in the file."""
    c = {"max_tokens": 512, "min_tokens": 50, "overlap_tokens": 0} | config
    order = [x for x in ("position", "id") if x in df.columns]
    units = F.transform(F.array_sort(F.collect_list(F.struct(*order, "content"))), lambda s: s["content"])
    key = "file_id" if "file_id" in df.columns else "id"
    texts = df.where("content is not null").groupBy(F.col(key).alias("file_id")).agg(units.alias("u"))
    kind = c.get("strategy", "semantic")
    if kind == "semantic":
        markers = tuple(c.get("boundary_markers") or (HEADING,))
        out = by_packing(texts, "file_id", "u", c["max_tokens"], c["min_tokens"], F.col("u"), "\n\n", markers, c["overlap_tokens"])
    elif kind == "fixed_window":
        out = by_fixed_window(texts.withColumn("content", F.array_join("u", " ")), "file_id", "content", c["max_tokens"], c["overlap_tokens"])
    else:
        cut = {"sentence": sentences, "paragraph": paragraphs}[kind]
        out = _rows(texts, F.flatten(F.transform("u", cut)), "file_id", kind)
    return out.withColumn("id", F.substring(F.sha2("content", 256), 1, 32)).withColumn("approx_tokens", F.col("token_count"))


def dedupe(df: DataFrame, corpus: DataFrame | None = None, hash_column: str = "hash", order: tuple[str, ...] = ("file_id", "position")) -> DataFrame:
    """The first row of each hash within the batch, less the hashes that the corpus has.

    A hot hash doesn't meet in one task: the first row is a partial minimum over a struct, not a window."""
    first = df.groupBy(hash_column).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in (*order, hash_column)])).alias("_r"))
    out = first.select(hash_column, "_r.*").select(*df.columns)
    return out if corpus is None else out.join(corpus.select(hash_column), hash_column, "left_anti").select(*df.columns)


def section_paths(df: DataFrame, key: str = "file_id", order: str = "position", text: str = "content", levels: int = 6) -> DataFrame:
    """Add level, section_path and parent heading: the last heading of each level at or above each row, joined by /.

    A heading of a level ends the headings of deeper levels before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("level", heading_level(F.col(text)).cast("bigint"))
    title = F.regexp_replace(F.col(text), r"^#+\s+", "")
    names = []
    for n in range(1, levels + 1):
        # position of the last heading of this level, and of any shallower one
        at = F.last(F.when(F.col("level") == n, F.struct(F.col(order).alias("p"), title.alias("t"))), ignorenulls=True).over(w)
        cutoff = F.last(F.when((F.col("level") > 0) & (F.col("level") < n), F.col(order)), ignorenulls=True).over(w)
        out = out.withColumn(f"_at{n}", at).withColumn(f"_cut{n}", cutoff)
        names.append(F.when(F.col(f"_at{n}").isNotNull() & (F.col(f"_cut{n}").isNull() | (F.col(f"_at{n}")["p"] > F.col(f"_cut{n}"))), F.col(f"_at{n}")["t"]))
    out = out.withColumn("section_path", F.concat_ws("/", *names))
    return out.drop(*[f"_at{n}" for n in range(1, levels + 1)], *[f"_cut{n}" for n in range(1, levels + 1)])
