"""Responses of models: from a table, or from a client called inside the partitions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.text import is_error
from quillwork.operators.lineage import durable

Client = Callable[[str], str]


def from_table(prompts: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """prompts with response and error; a prompt without a response has an error instead."""
    got = responses.select(*keys, "response", F.lit(True).alias("_got"))
    joined = prompts.join(got, keys, "left")
    return joined.withColumn("error", F.when(F.col("_got").isNull(), "no response")).drop("_got")


def from_client(prompts: DataFrame, connect: Callable[[], Client], column: str = "prompt", tries: int = 6, wait: float = 1.0, longest: float = 10.0, in_flight: int = 1) -> DataFrame:
    """prompts with response and error from a client made once per task.

    A call is tried again up to ``tries`` times, after a random wait of at most ``wait`` seconds
    that doubles with each try up to ``longest``; the last error is a value, not a failure. Rows stay as they are and in their order. Up to
    ``in_flight`` calls of a task run at a time, so with more than one the client has to stand threads.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()

        def one(prompt: str) -> tuple[str | None, str | None]:
            error = ""
            for k in range(tries):
                try:
                    return client(prompt), None
                except Exception as e:  # whatever the client throws becomes the row's error
                    error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(random.uniform(0, min(longest, wait * 2**k)))
            return None, error

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                both = list(pool.map(one, batch[column]))
                yield batch.assign(response=[r for r, _ in both], error=[e for _, e in both])

    return prompts.mapInPandas(ask, schema)


def logged(prompts: DataFrame, answer: Callable[[DataFrame], DataFrame], log: str, column: str = "prompt", each: int = 10_000) -> DataFrame:
    """prompts with response and error, where every answer is kept in a table at ``log`` and never asked for again.

    The log holds (digest, response) by the digest of a prompt and is only appended to. Prompts
    that aren't in it are asked for once each, in portions of some ``each``; a portion is committed
    before the next begins, so a run that is stopped, or loses its executors for good, has at most
    one portion to ask for anew. Failed calls aren't logged: they give the error and are asked for
    again by the next run. A null prompt isn't asked and has an error.
    """
    spark = prompts.sparkSession
    known = _log(spark, log)
    digest = F.sha2(F.col(column), 256)
    open_ = durable(prompts.where(F.col(column).isNotNull()).select(F.col(column).alias("prompt"), digest.alias("digest")).distinct().join(known, "digest", "left_anti"))
    portions = -(-open_.count() // each)
    errors = None
    for k in range(portions):
        # the digest is even already, and the same prompts fall together in every run
        part = open_.where(F.pmod(F.xxhash64("digest"), F.lit(portions)) == k)
        out = durable(answer(part).select("digest", "response", "error"))
        bad = failed(F.col("error"), F.col("response"))
        out.where(~bad).select("digest", "response").write.mode("append").parquet(log)
        lost = out.where(bad).select("digest", F.coalesce("error", F.lit("no response")).alias("error"))
        errors = lost if errors is None else errors.union(lost)
    answers = _log(spark, log).groupBy("digest").agg(F.min("response").alias("response"))
    joined = prompts.withColumn("_digest", digest).join(answers.withColumnRenamed("digest", "_digest"), "_digest", "left")
    if errors is None:
        joined = joined.withColumn("_error", F.lit(None).cast("string"))
    else:
        joined = joined.join(errors.select(F.col("digest").alias("_digest"), F.col("error").alias("_error")), "_digest", "left")
    error = F.when(F.col("response").isNull(), F.coalesce("_error", F.lit("no prompt")))
    return joined.withColumn("error", error).drop("_digest", "_error")


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The log's (digest, response), or no rows before its first portion."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "digest string, response string"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def retried(prompts: DataFrame, answer: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """answer(prompts), with the failed rows asked again for up to ``rounds`` rounds in all."""
    done, left = None, prompts
    for turn in range(rounds):
        out = durable(answer(left))
        failed = F.col("error").isNotNull() | F.coalesce(is_error(F.col("response")), F.lit(True))
        last = turn + 1 == rounds
        good = out if last else out.where(~failed)
        done = good if done is None else done.unionByName(good)
        left = out.where(failed).select(*prompts.columns)
        if last or left.isEmpty():
            break
    return done


def evolved(seeds: DataFrame, step: Callable[[DataFrame, int], DataFrame], levels: int = 3) -> DataFrame:
    """Rows of every level: level 0 are the seeds, each further level is made of the one before."""
    current = seeds.withColumn("level", F.lit(0))
    out = current
    for level in range(1, levels + 1):
        current = durable(step(current.drop("level"), level).withColumn("level", F.lit(level)))
        out = out.unionByName(current)
    return out


def failed(error: Column, response: Column) -> Column:
    return error.isNotNull() | response.isNull()
