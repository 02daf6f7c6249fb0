"""PII by bootstrapped contextual extraction (operator 10, native).

Personal data of known form (the seeds) is found by pattern. The words around the seeds are lexical patterns; patterns and
the instances found in them form a graph. In rounds, a pattern's confidence is the smoothed share of its instances that are
known, and an instance is believed if any of its patterns is right with enough probability; identifier-like tokens that are
believed are new personal data. These then start and support patterns as seeds do, and the rounds go on until none is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import aside, cut, joined, match_spans, of_kind, small, table, temporary

#: The known forms. Groups are possessive where nothing follows them, and runs are only entered at their start
#: (or where the match before ended); this finds the same, needs no stack, and stays linear in long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "context"]
#: Identifier-like tokens: at least four digits, six characters.
TOKEN = r"(?<![A-Za-z0-9._@-])[A-Za-z0-9._@-]*[0-9][A-Za-z0-9._@-]*"
TOKEN_GUARD = r"[0-9](?:[A-Za-z._@-]*[0-9]){3}"
#: Contexts are whole words that lie within so many characters of a span.
REACH = 64
SMOOTHING, MIN_SEEDS, BELIEVE = 2.0, 3, 0.6


def _luhn(v: Column) -> Column:
    """The Luhn sum of the digits of v is a multiple of ten."""
    d = F.split(F.reverse(F.regexp_replace(v, "[^0-9]", "")), "")
    d = F.filter(d, lambda x: x != "")

    def worth(x: Column, i: Column) -> Column:
        n = x.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(d, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", ""))


def _small_parts(v: Column) -> Column:
    """Each number, without leading zeros, has at most three digits and is at most 255."""
    tails = F.transform(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(tails, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def base_spans(text: Column) -> Column:
    email = match_spans(text, EMAIL, 0, text.contains("@"), lambda v: F.lit(True))
    ip = match_spans(text, IP, 1, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), _small_parts)
    card = match_spans(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda v: _digits(v).between(14, 19) & _luhn(v))
    phone = match_spans(text, PHONE, 3, text.rlike(r"\+[0-9]"), lambda v: _digits(v).between(10, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _patterns(text: Column, s: Column) -> Column:
    """Contexts of a span: the two words before it, and the word before with the word after; digits read as 0, in lower case.

    A word that REACH cuts is no context."""
    start = F.greatest(s["start"] - REACH, F.lit(0)).cast("int")
    left = F.substring(text, start + 1, (s["start"] - start).cast("int"))
    left = F.when(start > 0, F.regexp_replace(left, r"^\S+(?=\s|$)", "")).otherwise(left)
    right = F.substring(text, (s["end"] + 1).cast("int"), F.lit(REACH))

    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, "[0-9]", "0"))

    one, two = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    after = F.regexp_extract(right, r"^\W*(\w+)", 1)
    both = F.when((one != "") & (after != ""), F.array(F.concat(F.lit("m\n"), plain(one), F.lit("\n"), plain(after)))).otherwise(F.array().cast("array<string>"))
    before = F.when(two != "", F.array(F.concat(F.lit("l\n"), plain(F.regexp_replace(two, r"\s+", " "))))).otherwise(F.array().cast("array<string>"))
    return F.concat(both, before)


MENTION = "array<struct<start:bigint,end:bigint,seed:boolean,instance:bigint,patterns:array<bigint>>>"


def mentions(text: Column, base: Column) -> Column:
    """Seeds, and identifier-like tokens that touch no seed, with hashed instance and patterns."""
    tokens = match_spans(text, TOKEN, 4, text.rlike(TOKEN_GUARD), lambda v: (_digits(v) >= 4) & (F.length(v) >= 6))
    tokens = F.filter(tokens, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def one(s: Column, seed: bool) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(seed).alias("seed"), F.xxhash64(F.lower(s["val"])).alias("instance"), F.transform(_patterns(text, s), lambda p: F.xxhash64(p)).alias("patterns"))

    return F.concat(F.transform(base, lambda s: one(s, True)), F.transform(tokens, lambda s: one(s, False))).cast(MENTION)


def believed(seen: DataFrame) -> DataFrame:
    """From mentions (instance, seed, pattern): the instances that are believed and are no seeds.

    In each round, a pattern of which MIN_SEEDS instances are known has a confidence, the smoothed share of known ones among
    its instances; an instance is believed if at least one of its patterns is right with probability BELIEVE. Those believed
    are known from then on, and the rounds go on until none is added. What is known only grows, so this ends."""
    edges = cut(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("known")), "pii-edges")
    reached: list[DataFrame] = []
    while True:
        known = F.sum(F.col("known").cast("int"))
        rated = edges.groupBy("pattern").agg(known.alias("k"), F.count(F.lit(1)).alias("n")).where((F.col("k") >= MIN_SEEDS) & (F.col("n") > F.col("k")))
        rated = cut(rated.select("pattern", F.log1p(-F.col("k") / (F.col("n") + SMOOTHING)).alias("doubt")), "pii-rated")
        doubted = edges.where(~F.col("known")).join(small(rated, rated.count()), "pattern").groupBy("instance").agg(F.sum("doubt").alias("doubt"))
        reached.append(cut(doubted.where(1 - F.exp("doubt") >= BELIEVE).select("instance"), "pii-reached"))
        n = reached[-1].count()
        if not n:
            return reduce(DataFrame.union, reached)
        more = small(reached[-1].withColumn("_new", F.lit(True)), n)
        grown = cut(edges.join(more, "instance", "left").select("pattern", "instance", (F.col("known") | F.coalesce("_new", F.lit(False))).alias("known")), "pii-edges")
        edges = grown


def find(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and spans, array<struct<start, kidx, end>> over KINDS in order; base spans always stay.

    Null or empty text: no spans. Very long texts: whole; a span's context is the words within REACH characters. Equal rows
    get equal spans. Empty table: empty result. Input columns other than carry and text are ignored.
    """
    own, name = aside(df)
    t = F.coalesce(F.col(name[text]), F.lit(""))
    read = own.select(*[F.col(name[c]).alias(f"_c{i}") for i, c in enumerate(carry)], t.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    read = read.withColumn("_mentions", mentions(F.col("_text"), F.col("_base")))
    plain = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kidx"].alias("kidx"), s["end"].alias("end")))
    read = cut(read.select(*[f"_c{i}" for i in range(len(carry))], plain.alias("_base"), "_mentions", F.monotonically_increasing_id().alias("_row")), "pii")
    each = read.where(F.size("_mentions") > 0).select("_row", F.explode("_mentions").alias("m")).select("_row", "m.*")
    with temporary() as keep:
        new = believed(each.select("instance", "seed", F.explode("patterns").alias("pattern")))
        found = each.where(~F.col("seed")).join(new, "instance").groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kidx"), "end")).alias("_more"))
        found = keep(cut(found, "pii-found"))
    whole = read.drop("_mentions").join(small(found, found.count(), 50_000), "_row", "left")  # else texts that are carried move by row
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast("array<struct<start:bigint,kidx:int,end:bigint>>"))))
    return whole.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], spans.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or group of spans that overlap, replaced by the kind of its first one, like <EMAIL>."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).cast("long").alias("p"), F.lit("").alias("o"))

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["o"], F.substring(text, (a["p"] + 1).cast("int"), (s["start"] - a["p"]).cast("int")), F.get(names, s["kidx"]))
        return F.struct(F.greatest(a["p"], s["end"]).alias("p"), F.when(s["start"] < a["p"], a["o"]).otherwise(put).alias("o"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["o"], F.substring(text, (a["p"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kidx"] < 4)
    return out.select("doc_id", *[of_kind(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


QUERIES = {"op10_pii_bootstrap": op10}
ORACLES: dict[str, str] = {}
