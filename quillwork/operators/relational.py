"""Positional joins, routing, scores, chains and samples over tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import strip
from quillwork.operators.lineage import durable
from quillwork.operators.segments import look_back

RULE_CATEGORIES = ["syntax", "input_output", "data_structure", "code_convention"]
JUDGED_CATEGORIES = ["situation", "example", "code_contextual", "non_functional_requirements", "algorithm"]
LEVELS = 6
MAX_ITEMS = 10_000


def with_position(df: DataFrame, order: list[str], by: list[str], name: str = "pos") -> DataFrame:
    """df with a 0-based position inside each group of ``by``, one task per group.

    segments.positions gives the same where groups are larger than a task should hold.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def reindexed(df: DataFrame, order: Column, name: str = "id") -> DataFrame:
    """df numbered from 1 in the order of a unique integer column, without gathering it in one task.

    Rows are dealt out by range; each range is numbered on its own and shifted by the rows of the
    ranges before it, of which there are as many as tasks. The ranges are checkpointed, since
    their bounds come from a sample and two evaluations may draw them differently.
    """
    dealt = durable(df.withColumn("_order", order).repartitionByRange("_order").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_order"))
    numbered = dealt.withColumn("_inside", inside).join(F.broadcast(shifts), "_range")
    return numbered.withColumn(name, F.col("_inside") + F.col("_shift")).drop("_order", "_range", "_inside", "_shift")


def positional_join(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of equal position, by group. Rows beyond the shorter side drop out."""
    return left.join(right, [*(keys or []), "pos"])


def beyond_end(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of left without a partner in positional_join, for those who want to report them."""
    return left.join(right, [*(keys or []), "pos"], "left_anti")


def unseen(new: DataFrame, old: DataFrame, column: str = "code", least: int = 0) -> DataFrame:
    """Rows whose stripped text isn't empty, has ``least`` characters and isn't in old; null counts as empty."""
    key = strip(F.coalesce(F.col(column), F.lit("")))
    seen = old.select(strip(F.coalesce(F.col(column), F.lit(""))).alias("_key")).distinct()
    fresh = new.withColumn("_key", key).where((F.col("_key") != "") & (F.length("_key") >= least))
    return fresh.join(seen, "_key", "left_anti").drop("_key")


def route(name: Column) -> Column:
    """struct(category, method) by the first category that the name starts with; null without one."""
    out = F.lit(None).cast("struct<category:string,method:string>")
    for method, names in (("judge", JUDGED_CATEGORIES[::-1]), ("rule", RULE_CATEGORIES[::-1])):
        for c in names:
            out = F.when(name.startswith(c), F.struct(F.lit(c).alias("category"), F.lit(method).alias("method"))).otherwise(out)
    return out


def score(df: DataFrame, by: list[str], matched: Column, overall: list[str] | None = None) -> DataFrame:
    """total, matched and score of each group, and of ``overall`` (a part of by) with 'overall' for the rest.

    One aggregate with grouping sets, so the rows are read and summed once.
    """
    hit = df.withColumn("_hit", F.coalesce(matched.cast("int"), F.lit(0)))
    rest = [c for c in by if c not in (overall or [])]
    aggs = [F.count("*").alias("total"), F.sum("_hit").alias("matched")]
    if overall is None:
        out = hit.groupBy(*by).agg(*aggs)
    else:
        sets = [[F.col(c) for c in by], [F.col(c) for c in overall]]
        out = hit.groupingSets(sets, *[F.col(c) for c in by]).agg(*aggs, *[F.grouping(c).alias(f"_{c}") for c in rest])
        for c in rest:
            out = out.withColumn(c, F.when(F.col(f"_{c}") == 1, "overall").otherwise(F.col(c))).drop(f"_{c}")
    return out.where("total > 0").withColumn("score", ratio(F.col("matched"), F.col("total")))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def score_dimensions(df: DataFrame, by: list[str], dimensions: dict[str, Column]) -> DataFrame:
    """One row per group with total, matched and score of each dimension, from one pass."""
    aggs = []
    for name, hit in dimensions.items():
        seen = F.count(hit)
        good = F.count_if(hit)
        aggs += [seen.alias(f"{name}_total"), good.alias(f"{name}_matched"), ratio(good, seen).alias(f"{name}_score")]
    return df.groupBy(*by).agg(*aggs)


def chains(df: DataFrame, by: list[str], value: str = "answer", most: int = LEVELS - 1, segmented: bool = False) -> DataFrame:
    """df with ``chain``: the values of the ``level`` rows before each row and its own, oldest first.

    Rows of a level above ``most`` and rows whose position is below their level drop out. With
    ``segmented`` a group is spread over many tasks, for groups that one task shouldn't hold.
    """
    n, link = F.col("level") + 1, F.coalesce(F.col(value), F.lit(""))
    if segmented:
        framed = look_back(df, ["pos"], by, link, most, "_frame")
    else:
        w = Window.partitionBy(*by).orderBy("pos").rowsBetween(-most, Window.currentRow)
        framed = df.withColumn("_frame", F.collect_list(link).over(w))
    return framed.where((F.col("level") <= most) & (F.col("pos") >= F.col("level"))).withColumn("chain", F.slice("_frame", -n, n)).drop("_frame")


def level_scores(checked: DataFrame, by: list[str], checks: str = "checks") -> DataFrame:
    """Per group and level: total, matched (sum of checks), perfect (all pass), SSR and HSR."""
    passed = F.size(F.filter(checks, lambda c: c))
    out = checked.groupBy(*by, "level").agg(
        F.count("*").alias("total"),
        F.sum(passed).alias("matched"),
        F.count_if(F.forall(checks, lambda c: c)).alias("perfect"),
    )
    return _rates(out)


def _rates(out: DataFrame) -> DataFrame:
    soft = ratio(F.col("matched"), F.col("total") * (F.col("level") + 1))
    return out.withColumn("ssr", soft).withColumn("hsr", ratio(F.col("perfect"), F.col("total")))


def all_levels(scores: DataFrame) -> DataFrame:
    """Sums of level_scores over all groups, a row for each level, zero where nothing was seen."""
    spark = scores.sparkSession
    summed = scores.groupBy("level").agg(*[F.sum(c).alias(c) for c in ("total", "matched", "perfect")])
    levels = spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    filled = levels.join(summed.withColumn("level", F.col("level").cast("int")), "level", "left").na.fill(0, ["total", "matched", "perfect"])
    return _rates(filled)


def judged_summary(df: DataFrame, by: list[str], passed: Column, confidence: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(passed).alias("passed"),
        ratio(F.count_if(passed), F.count("*")).alias("pass_rate"),
        F.coalesce(F.avg(confidence), F.lit(0.0)).alias("average_confidence"),
    )


def test_results(results: Column) -> Column:
    """struct(passed, total_tests, failures) of an array of results with a boolean ``passed``."""
    return F.struct(
        F.size(F.filter(results, lambda r: r["passed"])).alias("passed"),
        F.size(results).alias("total_tests"),
        F.filter(results, lambda r: ~r["passed"]).alias("failures"),
    )


def draw_order(key: Column, seed: int) -> Column:
    """A column to sort by at random, repeatably: a digest of the seed and a unique key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_each(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, all of a smaller group."""
    w = Window.partitionBy(*by).orderBy(draw_order(F.col(key), seed), key)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def sample_all(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, or all."""
    return df.orderBy(draw_order(F.col(key), seed), key).limit(n)


def assign_balanced(slots: DataFrame, items: DataFrame, item: str, seed: int = 0) -> DataFrame:
    """slots (with a 0-based ``pos``) with an item each: every item once, in an order drawn anew,
    before any comes again. items is a seed list of at most MAX_ITEMS entries."""
    listed = [r[0] for r in items.select(item).orderBy(item).limit(MAX_ITEMS + 1).collect()]
    if not 0 < len(listed) <= MAX_ITEMS:
        raise ValueError(f"a seed list has 1 to {MAX_ITEMS} items")
    n = len(listed)
    numbered = slots.withColumn("_epoch", F.floor(F.col("pos") / n).cast("long")).withColumn("_slot", (F.col("pos") % n).cast("int"))
    drawn = F.transform(F.array(*[F.lit(x) for x in listed]), lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epoch").cast("string"), x.cast("string"))).alias("draw"), x.alias("item")))
    epochs = numbered.select("_epoch").distinct().select("_epoch", F.posexplode(F.array_sort(drawn)).alias("_slot", "_drawn"))
    return numbered.join(epochs.select("_epoch", "_slot", F.col("_drawn.item").alias(item)), ["_epoch", "_slot"]).drop("_epoch", "_slot")


def sorted_parameters(parameters: Column) -> Column:
    """Structs by position, a null position as 0; equal positions keep their order."""
    keyed = F.transform(parameters, lambda p, i: F.struct(F.coalesce(p["position"], F.lit(0)).alias("at"), i.alias("i"), p.alias("p")))
    by_place = F.array_sort(keyed, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["i"] - b["i"]))
    return F.transform(by_place, lambda x: x["p"])


def first_k(items: Column, k: int) -> Column:
    return F.slice(items, 1, k)


def repaired(details: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Matched rows with their old code and failed rows with their new response, in one table.

    A failed row without a response keeps a null response and says so in ``error``.
    """
    old = details.where("is_matched").select(key, F.col("generated_code").alias("response"), F.lit(None).cast("string").alias("error"))
    failed = details.where("is_matched is null or not is_matched").select(key)
    new = failed.join(responses.select(key, F.col("response").alias("response"), F.lit(True).alias("_got")), key, "left")
    new = new.select(key, "response", F.when(F.col("_got").isNull(), "no response").alias("error"))
    return old.unionByName(new)
