"""Secret scans by a battery of randomness tests (operator 6, native).

Known forms are found by pattern. Beyond them, long runs of code characters are read in the encoding they fit, and the
symbols are tested for uniformity (chi-squared), runs, and serial correlation at lags 1 and 2; the tests make one probability
that the run is random. A model of ordinary text says how rarely text of that length and encoding looks as random; from that
each run gets a p-value, and the Benjamini-Hochberg rule bounds the share of false finds. The model needs no ordinary runs in
the table, so that long secrets are found where nothing else is as long.
"""

from __future__ import annotations

import math
import random
from functools import cache
from statistics import NormalDist, fmean, stdev

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import aside, bind, cut, joined, match_spans, of_kind, table

#: The known forms.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GUARD = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_LOW, HEX_UP = "0123456789abcdef", "0123456789ABCDEF"
UP, LOW, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings: what a run must look like, and its alphabet in order.
ENCODINGS = (("^[0-9a-f]+$", HEX_LOW), ("^[0-9A-F]+$", HEX_UP), ("^[A-Z2-7]+$", UP + "234567"), ("^[A-Za-z0-9]+$", UP + LOW + DIGITS), ("^[A-Za-z0-9+/]+$", UP + LOW + DIGITS + "+/"), ("^[A-Za-z0-9_-]+$", UP + LOW + DIGITS + "-_"))
#: Bins of the p-value's normal score, their width and lowest end, and the share of false finds allowed.
BINS, WIDTH, LOWEST, FALSE_SHARE = 80, 0.125, -10.0, 0.05
#: The model of ordinary text: letters at these rates (in 1000), or decimal digits in hex.
RATES = dict(zip(LOW, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))
#: Lengths of model texts (between them it is interpolated, longer runs count as the last), and texts drawn of each.
KNOTS, DRAWS = (20, 24, 32, 48, 80, 160), 600


def base_spans(text: Column) -> Column:
    assign = match_spans(text, ASSIGN, 0, text.rlike(ASSIGN_GUARD), lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6)
    access = match_spans(text, ACCESS, 1, text.contains("AKIA"), lambda v: F.length(v) >= 20)
    hexes = match_spans(text, HEX, 2, text.rlike(HEX), lambda v: F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def _alphabet(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for form, letters in reversed(ENCODINGS):
        out = F.when(v.rlike(form), F.lit(letters)).otherwise(out)
    return out


def randomness(z: Column) -> Column:
    """How far the battery finds the symbols from a uniform source: the root of the sum of squares of its four tests.

    z: struct of v (the run), alphabet, and x (places of its symbols in the alphabet, from 0), all bound."""
    v, x, k = z["v"], z["x"], F.length(z["alphabet"]).cast("double")
    n = F.size(x).cast("double")
    counts = F.transform(F.split(z["alphabet"], ""), lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    chi = F.greatest((squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0))
    mean, var = (k - 1) / 2, (k * k - 1) / 12

    def pairs(lag: int, f) -> Column:
        return F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - lag), F.slice(x, lag + 1, F.size(x) - lag), f), F.lit(0.0), lambda a, c: a + c)

    runs = (pairs(1, lambda a, b: F.when((a > mean) != (b > mean), 1.0).otherwise(0.0)) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = [pairs(lag, lambda a, b: (a - mean) * (b - mean)) / (var * F.sqrt(n - lag)) for lag in (1, 2)]
    tests = F.array(chi, runs, *serial)
    return F.sqrt(F.aggregate(tests, F.lit(0.0), lambda a, t: a + t * t))


CANDIDATE = "array<struct<start:bigint,end:bigint,bin:int>>"


def candidates(text: Column, base: Column) -> Column:
    """Runs outside base spans with the bin of their p-value's normal score."""
    runs = match_spans(text, RUN, 3, text.rlike(RUN), lambda v: _alphabet(F.rtrim(v, F.lit("="))).isNotNull())
    runs = F.filter(runs, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def read(s: Column) -> Column:
        v = F.rtrim(s["val"], F.lit("="))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("v"), _alphabet(v).alias("alphabet"))

    def placed(s: Column) -> Column:
        x = F.transform(F.split(s["v"], ""), lambda c: F.instr(s["alphabet"], c).cast("double") - 1)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v"), s["alphabet"].alias("alphabet"), F.filter(x, lambda a: a >= 0).alias("x"))

    means, spreads = model()

    def rated(s: Column) -> Column:
        code = F.array_position(F.array(*[F.lit(letters) for _, letters in ENCODINGS]), s["alphabet"]) - 1
        at = (code * (KNOTS[-1] - KNOTS[0] + 1) + F.greatest(F.lit(0), F.least(F.length(s["v"]), F.lit(KNOTS[-1])) - KNOTS[0])).cast("int")
        score = bind(at, lambda i: (randomness(s) - F.get(F.lit(means), i)) / F.get(F.lit(spreads), i))
        bin = F.greatest(F.lit(0), F.least(F.floor((score - LOWEST) / WIDTH), F.lit(BINS - 1))).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), bin.alias("bin"))

    # Each step is an array of its own, so that no lambda repeats the work of the one before.
    return bind(runs, lambda r: F.when(F.size(r) > 0, F.transform(F.transform(F.transform(r, read), placed), rated)).otherwise(F.array()).cast(CANDIDATE))


def distance(x: list[int], k: int) -> float:
    """The root of the sum of squares of the battery's four tests, as in randomness(); x: places in an alphabet of k."""
    n, mean, var = len(x), (k - 1) / 2, (k * k - 1) / 12
    squares = sum(x.count(c) ** 2 for c in set(x))
    chi = max((squares * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n), 0.0)
    runs = (sum((a > mean) != (b > mean) for a, b in zip(x, x[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = [sum((a - mean) * (b - mean) for a, b in zip(x, x[lag:])) / (var * math.sqrt(n - lag)) for lag in (1, 2)]
    return math.hypot(chi, runs, *serial)


@cache
def model() -> tuple[list[float], list[float]]:
    """Mean and spread of distance() of ordinary text, by encoding and length from the first knot to the last."""
    means, spreads = [], []
    for code, (_, letters) in enumerate(ENCODINGS):
        usual = dict.fromkeys(DIGITS, 1) if len(letters) == 16 else {c if c in letters else c.upper(): n for c, n in RATES.items()}
        places, rnd, at = [letters.index(c) for c in usual], random.Random(code), []
        for n in KNOTS:
            drawn = [distance(rnd.choices(places, list(usual.values()), k=n), len(letters)) for _ in range(DRAWS)]
            at.append((fmean(drawn), stdev(drawn)))
        for i, (a, b) in enumerate(zip(KNOTS, KNOTS[1:])):
            for n in range(a, b + (b == KNOTS[-1])):
                means.append(at[i][0] + (at[i + 1][0] - at[i][0]) * (n - a) / (b - a))
                spreads.append(at[i][1] + (at[i + 1][1] - at[i][1]) * (n - a) / (b - a))
    return means, spreads


def limit(counts: list[tuple[int, int]]) -> int:
    """From (bin, n): the last bin that is reported, -1 for none. A bin counts with its upper end, the last one as sure to be ordinary."""
    m, rank, last = sum(n for _, n in counts), 0, -1
    for b, n in sorted(counts):
        rank += n
        if b < BINS - 1 and NormalDist().cdf(LOWEST + (b + 1) * WIDTH) <= FALSE_SHARE * rank / m:
            last = b
    return last


def scan(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and spans, array<struct<start, kidx, end>> over KINDS in order; base spans always stay.

    Null or empty text: no spans. Very long texts: whole. Equal rows get equal spans. Empty table: empty result. Counts
    of the whole table by bin are gathered, at most 80 rows.
    """
    own, name = aside(df)
    held = [f"_c{i}" for i in range(len(carry))]
    t = F.coalesce(F.col(name[text]), F.lit(""))
    read = own.select(*[F.col(name[c]).alias(h) for c, h in zip(carry, held, strict=True)], t.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    read = read.withColumn("_found", candidates(F.col("_text"), F.col("_base")))
    read = cut(read.select(*held, F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kidx"].alias("kidx"), s["end"].alias("end"))).alias("_base"), "_found"), "secrets")
    counts = read.select(F.explode("_found").alias("f")).groupBy("f.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    last = limit([tuple(r) for r in counts])
    more = F.transform(F.filter("_found", lambda f: f["bin"] <= last), lambda f: F.struct(f["start"].alias("start"), F.lit(3).alias("kidx"), f["end"].alias("end")))
    return read.select(*[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], F.array_sort(F.concat("_base", more)).alias("spans"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kidx"] < 3)
    return out.select("doc_id", *[of_kind(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(base, KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


QUERIES = {"op6_secret_scan": op6}
ORACLES: dict[str, str] = {}
