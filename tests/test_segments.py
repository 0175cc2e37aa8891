import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.operators import segments
from quillwork.operators.relational import chains, with_position


def test_one_group_over_many_tasks(spark):
    n = 3_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).alias("v"))
    shares = [r["count"] for r in segments.dealt(df, ["v"], ["g"]).groupBy("_range").count().collect()]
    assert len(shares) > 1 and max(shares) < 0.7 * n
    out = segments.positions(df, ["v"], ["g"])
    assert out.count() == n and out.where("pos != v").isEmpty()


def groups(spark, n=5000):
    """One large group, many small ones and one of null."""
    group = F.when(F.col("id") % 3 == 0, "large").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 900).cast("string"))
    return spark.range(n).select(group.alias("g"), F.col("id").alias("v"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("w"))


def test_positions_equal_the_window(spark):
    df = groups(spark)
    assert segments.positions(df, ["v"], ["g"]).exceptAll(with_position(df, ["v"], ["g"])).isEmpty()
    assert segments.positions(df, ["v"], ["g"]).count() == 5000
    assert segments.positions(df.limit(0), ["v"], ["g"]).count() == 0


@pytest.mark.parametrize("block", [4, 50, 1 << 16])
def test_frames_equal_the_window(spark, block):
    df = groups(spark)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(-4, 0)
    want = df.withColumn("frame", F.transform(F.collect_list(F.struct("w")).over(w), lambda x: x["w"]))
    got = segments.look_back(df, ["v"], ["g"], F.col("w"), 4, block=block)
    assert got.count() == 5000 and got.exceptAll(want).isEmpty()


def test_chains(spark):
    df = groups(spark).select("g", F.col("v").alias("pos"), (F.col("v") % 7).cast("int").alias("level"), F.col("w").cast("string").alias("answer"))
    got, want = chains(df, ["g"], segmented=True), chains(df, ["g"])
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_frame_longer_than_a_block(spark):
    with pytest.raises(ValueError):
        segments.look_back(groups(spark), ["v"], ["g"], F.col("w"), 9, block=8)
