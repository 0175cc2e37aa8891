"""Quality scores by Bradley-Terry pairwise ranking.

Features of whole texts are plain column expressions. Every labelled row that isn't held out
draws PAIRS_EACH rows of the other label, by hash, and the weights minimise the logistic loss on
the feature differences of these preference pairs (a text of label 1 over one of label 0), so a
document's score is a strength in the Bradley-Terry sense. The strength at the label-0 quantile of
all these rows becomes the threshold, placed at a score of 0.7. Scoring is one projection.

Pairs are joined and summed by Spark: a Newton step brings one row of sums to the driver, whatever
the number of labels, and the quantiles are exact order statistics, found by counting ranges.
Weights are rounded to DIGITS significant digits, so the order of the sums leaves no trace.

Defined results: a null or empty text has the features of an empty text and gets a score; rows
with a null doc_id are scored and not held out; labels other than 0 and 1, and null ones, are
ignored; without both labels every document gets the same score, 1 if nothing has label 0 and
0 if nothing has label 1. Repeated rows get equal scores.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import durable, let, space_words, stored, table

#: Rows that sample() gives at most, for small tables at hand; the query fits on all rows by fit_all().
MAX_LABELLED = 20_000
PAIRS_EACH = 8
#: Blocks in which rows of a label are numbered, and ranges in which strengths are counted at once.
BLOCKS = 1024
RANGES = 1000
STEPS = 25
DIGITS = 9
RIDGE = 1e-3
THRESHOLD = 0.7
#: The threshold lies midway between two quantiles, this share of either side off the label-0 one.
MARGIN = 0.02
FEATURES = ["symbols", "shouting", "capitals", "stutter", "repeats", "line_repeats", "digits", "word_length", "log_words"]


def features(text: Column) -> Column:
    """Array of FEATURES, each finite for any text."""
    text = F.coalesce(text, F.lit(""))

    def share(part: Column, whole: Column) -> Column:
        return F.sqrt(part / F.greatest(whole, F.lit(1)))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        joined = F.array_join(words, "")
        chars = F.length(joined)

        def cut(pattern: str) -> Column:
            return chars - F.length(F.regexp_replace(joined, pattern, ""))

        twice = F.zip_with(F.slice(words, F.lit(2), n), words, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
        lines = F.filter(F.split(text, "\n"), lambda s: F.length(s) > 0)
        return F.array(
            share(cut("[#*$%&|<>]+"), chars),
            share(cut("!!+"), chars),
            share(cut("[A-Z]+"), chars),
            share(F.aggregate(twice, F.lit(0), lambda s, x: s + x), n),
            share(n - F.size(F.array_distinct(words)), n),
            let(lines, lambda s: share(F.size(s) - F.size(F.array_distinct(s)), F.size(s))),
            share(cut("[0-9]+"), chars),
            F.least(chars / F.greatest(n, F.lit(1)), F.lit(20.0)),
            F.log1p(n),
        )

    return let(space_words(text), of_words)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most limit labelled documents that aren't held out."""
    picked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(limit)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # limit rows at most
    rows = rows.select("doc_id", "quality", features(F.col("text")).alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(limit).collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return x, np.array([r["quality"] for r in rows], dtype=int)


def fit(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH) -> tuple[np.ndarray, float]:
    """Weights of the features and the strength of the threshold, by Newton's method."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), -math.inf if len(good) or not len(bad) else math.inf
    scale = x.std(0)
    scale[scale == 0] = 1
    order = np.random.default_rng(0)
    n = pairs_each * len(y)
    diff = (x[order.choice(good, n)] - x[order.choice(bad, n)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-diff @ w))
        slope = diff.T @ (p - 1) / n + RIDGE * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
        w -= (step := np.linalg.solve(curve, slope))
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    q = len(bad) / len(y)
    return w, float(np.quantile(x @ w, [q * (1 - MARGIN), q + (1 - q) * MARGIN]).mean())


def scored(rows: DataFrame, weights: np.ndarray, threshold: float, x: Column | None = None) -> DataFrame:
    """rows with ``score``: THRESHOLD where a row is as strong as the threshold. x: the features, if not the column x."""
    if math.isinf(threshold):
        return rows.withColumn("score", F.lit(1.0 if threshold < 0 else 0.0))
    start = -threshold + math.log(THRESHOLD / (1 - THRESHOLD))
    return rows.withColumn("score", 1 / (1 + F.exp(-strength(F.col("x") if x is None else x, weights, start))))


def score(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """docs with ``score`` by their texts."""
    return scored(docs, weights, threshold, features(F.col("text")))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, x, n, i) of all labelled rows (doc_id, x) that aren't held out.

    Equal ones are one row that counts n times. i numbers the rows of a label from 0, block by
    block of their hash, so no task sees all of them.
    """
    learned = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    joined = rows.join(learned.select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    distinct = joined.groupBy("doc_id", "quality", "x").agg(F.count("*").alias("n"))
    placed = durable(distinct.withColumn("block", F.pmod(F.xxhash64("doc_id", "x"), F.lit(BLOCKS))))
    before = Window.partitionBy("quality").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("quality", "block").agg(F.count("*").alias("size")).withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("quality", "block").orderBy("doc_id", "x"))
    numbered = placed.withColumn("nth", nth).join(F.broadcast(shift), ["quality", "block"])  # a row per label and block
    return durable(numbered.select("doc_id", "quality", "x", "n", (F.col("shift") + F.col("nth") - 1).alias("i")))


def preference_pairs(rows: DataFrame, sizes: dict[int, int], pairs_each: int = PAIRS_EACH) -> DataFrame:
    """(d, n): feature differences, label 1 less label 0, of each row of labelled() and those it draws."""
    other = F.when(F.col("quality") == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[1]))
    draws = rows.select("doc_id", "quality", "x", "n", F.explode(F.sequence(F.lit(1), F.lit(pairs_each))).alias("draw"))
    draws = draws.select((1 - F.col("quality")).alias("quality_b"), "x", "n", F.pmod(F.xxhash64("doc_id", "x", "draw"), other).alias("i_b"))
    drawn = rows.select(F.col("quality").alias("quality_b"), F.col("i").alias("i_b"), F.col("x").alias("y"))
    sign = 2 * F.col("quality_b") - 1  # of the drawn row
    return draws.join(drawn, ["quality_b", "i_b"]).select(F.zip_with("x", "y", lambda x, y: (y - x) * sign).alias("d"), "n")


def minimised(pairs: DataFrame, scale: np.ndarray) -> np.ndarray:
    """The weights of least logistic loss on the pairs, by Newton's method; scale divides the features."""
    k = len(scale)
    d = [F.get("d", F.lit(i)) / float(s) for i, s in enumerate(scale)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    flat = pairs.select("n", *[c.alias(f"d{i}") for i, c in enumerate(d)])
    w = np.zeros(k)
    for _ in range(STEPS):
        strength = sum((F.col(f"d{i}") * float(w[i]) for i in range(1, k)), F.col("d0") * float(w[0]))
        judged = flat.withColumn("p", 1 / (1 + F.exp(-strength))).withColumn("c", F.col("n") * F.col("p") * (1 - F.col("p")))
        slopes = [F.sum(F.col("n") * (F.col("p") - 1) * F.col(f"d{i}")) for i in range(k)]
        curves = [F.sum(F.col("c") * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in cells]
        n, *sums = judged.agg(F.sum("n"), *slopes, *curves).first()
        slope = np.array(sums[:k]) / n + RIDGE * w
        curve = np.zeros((k, k))
        for (i, j), total in zip(cells, sums[k:], strict=True):
            curve[i, j] = curve[j, i] = total / n
        w = w - (step := np.linalg.solve(curve + RIDGE * np.eye(k), slope))
        if np.abs(step).max() < 1e-8:
            break
    return w


def rounded(x: float) -> float:
    return float(f"{x:.{DIGITS}g}")


def order_statistic(counts: DataFrame, rank: int) -> float:
    """The value at a 0-based rank among values (v, n), each counted n times. Exact: the range that
    holds the rank is cut into RANGES until it holds one value."""
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = (high - low) / RANGES
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(RANGES - 1))
        inside = counts.where(F.col("v").between(low, high)).groupBy(at.alias("at"))
        for r in sorted(inside.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["at"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def quantile(counts: DataFrame, total: int, q: float) -> float:
    """The quantile as numpy gives it, between the two nearest values."""
    at = q * (total - 1)
    low, high = (order_statistic(counts, rank) for rank in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def strength(x: Column, weights: np.ndarray, start: float = 0.0) -> Column:
    terms = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(float(start)), lambda s, t: s + t)


def fit_all(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """As fit(), on all labelled rows: rows (doc_id, x) with their features."""
    learned = labelled(rows, labels)
    k = len(FEATURES)
    sums = [F.sum("n"), F.count("*")]
    found = {r[0]: r[1:] for r in learned.groupBy("quality").agg(*sums).collect()}
    if len(found) < 2:
        return np.zeros(k), math.inf if 0 in found else -math.inf
    each = [F.get("x", F.lit(i)) for i in range(k)]
    total = sum(n for n, _ in found.values())
    mean = np.array(learned.agg(*[F.sum(F.col("n") * x) for x in each]).first()) / total
    spread = np.sqrt(np.array(learned.agg(*[F.sum(F.col("n") * F.pow(x - float(m), 2)) for x, m in zip(each, mean)]).first()) / total)
    scale = np.where(spread > 1e-12, spread, 1.0)
    pairs = stored(preference_pairs(learned, {q: size for q, (_, size) in found.items()}))
    weights = np.array([rounded(w) for w in minimised(pairs, scale) / scale])
    counts = durable(learned.groupBy(strength(F.col("x"), weights).alias("v")).agg(F.sum("n").alias("n")))
    q = found[0][0] / total
    return weights, float(np.mean([quantile(counts, total, at) for at in (q * (1 - MARGIN), q + (1 - q) * MARGIN)]))


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(docs.select("doc_id", features(F.col("text")).alias("x")))  # computed once, for the fit and the scores
    out = scored(rows, *fit_all(rows, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
