"""ROUGE-L similarity join and the greedy filter on it.

F = 2 LCS / (m + n) over lower-cased tokens. Candidates come from filters that lose no pair:
lengths must be near enough, and two texts must share one of the rarest tokens of each, as many
of them as the limit leaves out of the shorter possible overlap. The first one that they share has
to have enough tokens behind it in both, and the words that only one of them has must not be too
many. The rest is verified by LCS.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.text import rouge_tokens
from quillwork.operators.lineage import durable

EPSILON = 1e-9


@F.pandas_udf(T.IntegerType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays, a machine word of the table at a time."""

    def one(a, b) -> int:
        if a is None or b is None:
            return 0
        where: dict = {}
        for i, token in enumerate(a):
            where[token] = where.get(token, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for token in b:
            hit = row & where.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    return pd.Series([one(a, b) for a, b in zip(left, right)])


def lcs_native(a: Column, b: Column) -> Column:
    """The same as one row of the table after another, in expressions; for short arrays."""
    zeros = F.transform(a, lambda _: F.lit(0))

    def step(row: Column, token: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("left"), F.lit(0).alias("corner"))
        cells = F.zip_with(a, row, lambda t, up: F.struct(t.alias("t"), up.alias("up")))

        def cell(acc: Column, c: Column) -> Column:
            value = F.when(c["t"] == token, acc["corner"] + 1).otherwise(F.greatest(acc["left"], c["up"]))
            return F.struct(F.concat(acc["out"], F.array(value)).alias("out"), value.alias("left"), c["up"].alias("corner"))

        return F.aggregate(cells, start, cell, lambda acc: acc["out"])

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.aggregate(b, zeros, step, lambda row: F.element_at(row, -1)))


def _check(limit: float) -> None:
    if not 0 < limit <= 1:
        raise ValueError(f"limit: {limit} is not in (0, 1]")


def token_classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, tokens, m) of the first row of each list of tokens, and (id, first) of every row that has tokens."""
    rows = durable(df.select(F.col(key).alias("id"), rouge_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0))
    classes = durable(rows.groupBy("tokens").agg(F.min("id").alias("id")).select("id", "tokens", F.size("tokens").alias("m")))
    return classes, rows.join(classes.select("tokens", F.col("id").alias("first")), "tokens").select("id", "first")


def rouge_l_pairs(df: DataFrame, key: str, text: str, limit: float = 0.7, native: bool = False) -> DataFrame:
    """(a, b, lcs, score) for all rows a < b (by a unique key) of ROUGE-L F limit or more.

    Its size is that of the answer; where texts repeat, rouge_l_links over token_classes says the
    same without expanding the copies.
    """
    _check(limit)
    classes, members = token_classes(df, key, text)
    members = durable(members)
    links = durable(rouge_l_links(classes, limit, native))
    one, other = members.select(F.col("first").alias("a"), F.col("id").alias("one")), members.select(F.col("first").alias("b"), F.col("id").alias("other"))
    between = links.join(one, "a").join(other, "b").select("one", "other", "lcs", "score")
    size = classes.select(F.col("id").alias("a"), F.col("m").alias("lcs"))
    within = one.join(other, F.col("a") == F.col("b")).where("one < other").join(size, "a").select("one", "other", "lcs", F.lit(1.0).alias("score"))
    return between.union(within).select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), "lcs", "score")


def rouge_l_links(docs: DataFrame, limit: float = 0.7, native: bool = False) -> DataFrame:
    """(a, b, lcs, score), a < b, of ROUGE-L F limit or more. docs: (id, tokens, m), m tokens, one at least."""
    _check(limit)
    each = docs.select("id", "m", F.explode("tokens").alias("token"))
    nth = F.row_number().over(Window.partitionBy("id", "token").orderBy("m"))
    each = durable(each.select("id", "m", F.concat_ws("#", "token", nth.cast("string")).alias("token")))
    rarity = each.groupBy("token").agg(F.count("*").alias("n"))
    least = F.ceil(F.col("m") * (limit / (2 - limit)) - EPSILON)
    ranked = each.join(rarity, "token").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("n", "token")))
    first = durable(ranked.where(F.col("rank") <= F.col("m") - least + 1).select("id", "m", "token", "rank"))
    other = first.select(F.col("id").alias("b"), F.col("m").alias("n"), "token", F.col("rank").alias("rank_b"))
    near = F.least("m", "n") >= F.greatest("m", "n") * (limit / (2 - limit)) - EPSILON
    # the rarest token that two texts share leaves enough behind it in both
    needed = (F.col("m") + F.col("n")) * (limit / 2) - EPSILON
    reach = 1 + F.least(F.col("m") - F.col("rank"), F.col("n") - F.col("rank_b")) >= needed
    pairs = first.select(F.col("id").alias("a"), "m", "token", "rank").join(other, "token").where((F.col("a") < F.col("b")) & near & reach).select("a", "b").distinct()
    left = docs.select(F.col("id").alias("a"), F.col("tokens").alias("x"), "m")
    right = docs.select(F.col("id").alias("b"), F.col("tokens").alias("y"), F.col("m").alias("n"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    # each word that only one text has is a token that no common subsequence has
    alone = [F.col(size) - F.size(F.array_distinct(c)) + F.col("shared") for c, size in (("x", "m"), ("y", "n"))]
    both = both.where((F.col("shared") > 0) & (F.least(*alone) >= needed))
    lcs = lcs_native(F.col("x"), F.col("y")) if native else lcs_length("x", "y")
    scored = both.select("a", "b", "m", "n", lcs.alias("lcs")).withColumn("score", 2 * F.col("lcs") / (F.col("m") + F.col("n")))
    return scored.where(F.col("score") >= limit - EPSILON).select("a", "b", "lcs", "score")


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the rows that going through the ids in order would keep: those without an edge from
    a smaller id that was kept.

    Round by round, ids without undecided smaller neighbours are kept and their neighbours go; the
    smallest undecided id is decided in each round at least, and ends the loop at last.
    """
    open_edges = durable(edges.select("a", "b").distinct())
    undecided = durable(open_edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    gone = None
    while not undecided.isEmpty():
        kept = durable(undecided.join(open_edges.select(F.col("b").alias("id")), "id", "left_anti"))
        out = durable(open_edges.join(kept.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct())
        gone = out if gone is None else gone.union(out)
        undecided = durable(undecided.join(kept.union(out), "id", "left_anti"))
        left = open_edges.join(out.withColumnRenamed("id", "a"), "a", "left_anti")
        open_edges = durable(left.join(out.withColumnRenamed("id", "b"), "b", "left_anti").join(kept.withColumnRenamed("id", "a"), "a", "left_anti"))
    return nodes if gone is None else nodes.join(gone, "id", "left_anti")


def rouge_l_filter(df: DataFrame, key: str, text: str, limit: float = 0.7, native: bool = False) -> DataFrame:
    """df without the rows that resemble an earlier row, by key, that was kept.

    Of equal lists of tokens only the first row is compared: whatever drops it drops the others,
    and else it drops them itself. Rows without tokens resemble none.
    """
    classes, members = token_classes(df, key, text)
    kept = greedy_keep(classes.select("id"), durable(rouge_l_links(classes, limit, native).select("a", "b")))
    gone = members.join(kept, "id", "left_anti").select(F.col("id").alias(key))
    return df.join(gone, key, "left_anti")
