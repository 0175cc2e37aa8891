"""Positions and look-back frames inside groups of any size.

A window per group puts a whole group into one task. Here rows are dealt out by range of (group,
order), so a large group is spread over many tasks, and what one range has to know of those before
it is a single number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators.lineage import durable

#: Rows of a group that one window of look_back holds, beside its halo.
BLOCK = 1 << 16


def dealt(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """df with ``_range``: rows in ranges of (by, order), checkpointed because their bounds come from a sample."""
    return durable(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def positions(df: DataFrame, order: list[str], by: list[str], name: str = "pos") -> DataFrame:
    """df with a 0-based position inside each group of ``by``, as row_number over a window gives it.

    order has to be unique inside a group for a defined result. A null is a group and a place of
    its own, before all others. Only the first group of a range can have begun before it, so one
    number per range is broadcast, of which there are as many as tasks.
    """
    rows, group = dealt(df, order, by), F.struct(*by)
    sizes = rows.groupBy("_range", *by).agg(F.count("*").alias("_n")).withColumn("_group", group)
    whole = Window.partitionBy("_range")
    edges = sizes.withColumn("_low", F.min("_group").over(whole)).withColumn("_high", F.max("_group").over(whole))
    edges = edges.where(F.col("_group").eqNullSafe(F.col("_low")) | F.col("_group").eqNullSafe(F.col("_high")))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_shift", F.sum("_n").over(before)).where("_shift > 0").select("_range", "_group", "_shift")
    inside = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)).cast("long")
    joined = rows.withColumn("_inside", inside).join(F.broadcast(carried), "_range", "left")
    shift = F.when(group.eqNullSafe(F.col("_group")), F.col("_shift")).otherwise(F.lit(0))
    return joined.withColumn(name, F.col("_inside") - 1 + shift).drop("_range", "_inside", "_group", "_shift")


def look_back(df: DataFrame, order: list[str], by: list[str], value: Column, most: int, name: str = "frame", block: int = BLOCK) -> DataFrame:
    """df with the values of up to ``most`` rows before each row of its group and its own, oldest first.

    A group is cut into blocks by position; the last rows of each are copied before the next one.
    Nulls are kept as elements.
    """
    if not 0 <= most <= block:
        raise ValueError("a frame reaches back over one block at most")
    placed = positions(df, order, by, "_at").withColumn("_value", F.struct(value.alias("v")))
    own = F.floor(F.col("_at") / block)
    copies = F.when(F.col("_at") % block >= block - most, F.array(own, own + 1)).otherwise(F.array(own))
    frame = Window.partitionBy(*by, "_block").orderBy("_at").rowsBetween(-most, Window.currentRow)
    framed = placed.withColumn("_block", F.explode(copies)).withColumn(name, F.collect_list("_value").over(frame))
    out = framed.where(F.col("_block") == own).withColumn(name, F.transform(name, lambda x: x["v"]))
    return out.drop("_at", "_value", "_block")
