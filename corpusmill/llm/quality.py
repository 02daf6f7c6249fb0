"""Quality rules as weak supervision (operator 2).

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns, of which there
are at most 3 to the number of rules, estimates how each rule votes on good documents and on those that are bad in some way; a document is kept if its
posterior probability of being good is at least a half. The counts cover all documents; no labels are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import aside, cut, small_batches, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Name, is it bad, is it good; over the measures of measure(). Neither: the rule abstains.
RULES = (
    ("length", lambda m: m["n_words"] < 20, lambda m: m["n_words"] >= 50),
    ("symbols", lambda m: m["symbols"] > 0.1, lambda m: m["symbols"] <= 0.02),
    ("repeats", lambda m: m["repeats"] > 0.3, lambda m: m["n_words"] >= 50 and m["repeats"] < 0.05),
    ("lines", lambda m: m["dup_lines"] > 0.5, lambda m: m["n_lines"] >= 3 and m["dup_lines"] <= 0.1),
    ("letters", lambda m: m["letters"] < 0.7, lambda m: m["letters"] >= 0.9),
    ("shouting", lambda m: m["upper"] > 0.4, lambda m: m["upper"] < 0.15),
    ("word_length", lambda m: not 2.5 <= m["mean"] <= 12, lambda m: 4 <= m["mean"] <= 7),
    ("richness", lambda m: m["n_words"] >= 30 and m["richness"] < 3, lambda m: m["richness"] >= 6),
    ("sentences", lambda m: m["n_lines"] >= 3 and m["ended"] < 0.2, lambda m: m["ended"] >= 0.8),
    ("digits", lambda m: m["digits"] > 0.3, lambda m: m["digits"] < 0.05),
)


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of this width found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = (w ^ (w >> np.uint64(29))) * _MIX[0]
    total = np.zeros(n, np.uint64)
    for j in range(width):
        x = w[j : j + n] * _MIX[j]
        total += x ^ (x >> np.uint64(31 - j))
        total = total * _MIX[2] + _MIX[j]
    ordered = np.sort(total)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(total, twice)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += hit
    edges[width : width + n] -= hit
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str | None) -> dict[str, float]:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at ASCII white space alone
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    m: dict[str, float] = {"n_words": n, "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated(words)}
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    some = max(1, n)
    return m | {
        "n_lines": len(lines),
        "symbols": m["n_symbols"] / some,
        "repeats": m["n_repeat_words"] / some,
        "dup_lines": m["n_dup_lines"] / max(1, len(lines)),
        "letters": 1 - (len(raw.translate(None, _LETTERS)) - len(text) + chars) / max(1, chars),
        "upper": upper / max(1, upper + lower),
        "mean": chars / some,
        "richness": len(set(words)) / math.sqrt(some),
        "ended": sum(x.rstrip(" \t\x0b\x0c\r")[-1] in ".!?…\"'»”)" for x in lines) / max(1, len(lines)),
        "digits": (len(raw) - len(raw.translate(None, _DIGITS))) / max(1, chars),
    }


def votes(m: dict[str, float]) -> str:
    """One letter a rule: g, b or a (abstains). A text without words gets no votes but that on its length."""
    if not m["n_words"]:
        return "b" + "a" * (len(RULES) - 1)
    return "".join("b" if bad(m) else "g" if good(m) else "a" for _, bad, good in RULES)


def base_failed(m: dict[str, float]) -> bool:
    return m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]


def annotate(df: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add the five counts, base_failed and votes to every row; columns of these names that the input has are replaced."""
    small_batches(df.sparkSession)
    new = {*STATS, "base_failed", "votes"}
    df = df.select(*(c for c in df.columns if c not in new))
    kept = [c for c in df.columns if not (drop_text and c == text)]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [measure(t.as_py()) for t in b.column(at)]
            cols = [b.column(df_at) for df_at in places] + [pa.array([m[k] for m in ms], pa.int64()) for k in STATS]
            cols += [pa.array([base_failed(m) for m in ms], pa.bool_()), pa.array([votes(m) for m in ms], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, *STATS, "base_failed", "votes"])

    places = [df.columns.index(c) for c in kept]
    shape = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} bigint" for k in STATS), "base_failed boolean", "votes string"])
    return df.mapInArrow(run, shape)


#: Beliefs before any data: share of good documents, chance that a rule votes bad (where it votes) on good documents, on
#: documents that are bad in its own way, and on those bad in another way; and how many documents each belief is worth.
GOOD_SHARE, ON_GOOD, ON_OWN, ON_OTHER, WORTH = 0.85, 0.02, 0.9, 0.1, 20.0


def _seen(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bad = np.array([[x == "b" for x in p] for p in names], float).reshape(len(names), len(RULES))
    return bad, np.array([[x != "a" for x in p] for p in names], float).reshape(len(names), len(RULES))


def _posterior(bad: np.ndarray, seen: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    log = np.log(share) + bad @ np.log(rate) + (seen - bad) @ np.log(1 - rate)
    like = np.exp(log - log.max(1, keepdims=True))
    return like / like.sum(1, keepdims=True)


def fit(patterns: dict[str, int], rounds: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """By EM over pattern counts: shares of the classes (good first, then bad in the way that each rule looks for, as what is
    bad in one way is often fine in the others), and the chance of a bad vote of each rule in each class."""
    k = len(RULES)
    names = sorted(patterns)
    count = np.array([patterns[p] for p in names], float)[:, None]
    bad, seen = _seen(names)
    start = np.concatenate([np.full((k, 1), ON_GOOD), np.where(np.eye(k) == 1, ON_OWN, ON_OTHER)], 1)
    first = np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / k] * k)
    share, rate = first, start
    for _ in range(rounds):
        w = _posterior(bad, seen, share, rate) * count
        new = (bad.T @ w + WORTH * start) / (seen.T @ w + WORTH)
        new_share = (w.sum(0) + WORTH * first) / (count.sum() + WORTH)
        moved = max(float(np.abs(new_share - share).max()), float(np.abs(new - rate).max()))
        share, rate = new_share, new
        if moved < tolerance:
            break
    return share, rate


def posteriors(patterns: dict[str, int]) -> dict[str, float]:
    """Probability that a document with these votes is good."""
    names = sorted(patterns)
    if not names:
        return {}
    good = _posterior(*_seen(names), *fit(patterns))[:, 0]
    return dict(zip(names, map(float, good), strict=True))


def _learn(voted: DataFrame) -> dict[str, float]:
    return posteriors({r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()})  # at most 3 ** len(RULES)


def judge(voted: DataFrame, known: dict[str, float]) -> DataFrame:
    """Add quality (posterior) and kept to rows with votes."""
    spark = voted.sparkSession
    of = spark.createDataFrame(sorted(known.items()), "votes string, quality double")
    return voted.join(F.broadcast(of), "votes", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= 0.5))  # bounded by the number of patterns


def score(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, votes, quality and kept for every row, without the text.

    Null or blank text: no words, base_failed, not kept. Equal rows get equal verdicts. Empty table: empty result. Columns of
    these names that the input has are replaced; other names can't clash."""
    new = [*STATS, "base_failed", "votes", "quality", "kept"]
    own, name = aside(df)
    voted = cut(annotate(own, name[text], drop_text=True), "quality")
    kept = [F.col(name[c]).alias(c) for c in df.columns if c not in new and c != text]
    return judge(voted, _learn(voted)).select(*kept, *new)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns of the input, whatever their names. Two scans, no shuffle of texts.

    Null and blank texts go. Equal rows stay or go together. Empty table: empty result."""
    own, name = aside(df)
    known = _learn(annotate(own.select(name[text]), name[text], drop_text=True).select("votes"))
    good = judge(annotate(own, name[text]), known).where("kept")
    return good.select(*[F.col(name[c]).alias(c) for c in df.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *STATS, "base_failed", "kept", "quality", "votes")


QUERIES = {"op2_quality_rules": op2}
ORACLES: dict[str, str] = {}
