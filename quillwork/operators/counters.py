"""Counts of skipped, bad and failed rows, taken while the rows are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTS = "source string, metric string, value bigint"


class Counters:
    """Named counts of several sources; ``table`` gives them once the rows have been written or counted."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, source: str, **metrics: Column) -> DataFrame:
        """df, whose next action also counts all rows and those for which each metric is true.

        The counts are of the first action on df that runs to its end. A limit or a join that needs
        no more rows above it would stop them early, so watch what is written.
        """
        if source in self.seen:
            raise ValueError(f"{source} is watched already")
        self.seen[source] = Observation(source)
        wanted = [F.coalesce(F.sum(F.coalesce(m, F.lit(False)).cast("long")), F.lit(0)).alias(name) for name, m in metrics.items()]
        return df.observe(self.seen[source], F.count(F.lit(1)).alias("rows"), *wanted)

    def table(self, spark: SparkSession) -> DataFrame:
        """(source, metric, value). Waits for sources whose rows haven't been used yet."""
        rows = [(source, metric, value) for source, o in self.seen.items() for metric, value in o.get.items()]
        return spark.createDataFrame(rows, COUNTS)
