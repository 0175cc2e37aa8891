"""Expressions and helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word definition; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in, the others a character map."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def space_words(text: Column) -> Column:
    """Words between white space; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, which outlives executors.

    The folder comes from spark.checkpoint.dir; only a session without that setting (tests,
    local runs) gets a folder of its own.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillwork-")
        )
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet beside the checkpoints and read again: for wide rows, such as texts.

    Column-wise and compressed, it takes a fraction of a checkpoint's disk, and later reads
    fetch only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(df: DataFrame) -> None:
    """Let go of the shuffle files of steps that df no longer needs, since it is durable or stored.

    Spark deletes them once the driver's JVM has collected what refers to them, and a driver with
    memory to spare does so late, when several steps' files have piled up on the disks.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges, root being the smallest node of its component.

    Alternates large-star and small-star steps until the edges are stars. Each step only takes
    minima per node, so a hub costs a partial aggregate and a join that may be split, never a
    list. Edges with a null end and loops are ignored; no edges give no rows. With a number of
    rounds it stops there: nodes of one root are then in one component, but not all of them have it.
    """
    x, y = F.col(a), F.col(b)
    stars = durable(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
        .distinct()
    )
    state = (1, 0) if rounds else _fingerprint(stars)
    turn = 0
    while state[0] and turn != rounds:
        turn += 1
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi != lo")
            .distinct()
        )
        stars = durable(small)
        if rounds is None:
            before, state = state, _fingerprint(stars)
            if before == state:
                break
    out = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
    # before the end a node may stand under several others
    return out.groupBy("node").agg(F.min("root").alias("root")) if rounds else out


def _fingerprint(stars: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum, to see that a step changed nothing."""
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
    return row[0], row[1] or 0
