"""Sources and sinks: JSON arrays with positions, one file per model and constraint, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSTRUCTION = "struct<id:bigint,category:string,constraint:string,prompt:string,answer:string>"
LEVEL_INSTRUCTION = "struct<id:bigint,category:string,level:int,result:array<array<string>>,prompt:string,answer:string>"
GENERATION = "struct<id:bigint,response:array<array<string>>,error:string>"
DETAIL = "struct<id:bigint,category:string,constraint:string,prompt:string,answer:string,generated_code:string,is_matched:boolean,error_message:string>"
TEST_ROW = "struct<id:bigint,constraint:string,tests:array<struct<name:string,input:string,expected_output:string>>>"
#: Fields of the seed lists that templates draw on.
SEEDS = {
    "advanced_syntax": "struct<language:string,advanced_syntax:string,features:string,example:string>",
    "library": "struct<id:bigint,name:string,category:string,description:string,example:string,language:string>",
    "input_order": "struct<id:bigint,parameter_list:array<struct<position:int,data_structure:string,description:string>>,feature:string>",
    "input_range": "struct<id:bigint,data_structure:string,range:string,feature:string>",
    "output_range": "struct<id:bigint,data_structure:string,range:array<string>,feature:string>",
    "data_structure_operation": "struct<id:bigint,language:string,data_structure:string,operations:array<string>>",
}


def json_arrays(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The records of files that hold one JSON array each, with ``file`` and their 0-based ``pos``.

    A file that isn't such an array gives no rows; see bad_files.
    """
    items = F.posexplode(F.from_json("value", f"array<{row}>"))
    return _files(spark, path).select("file", items.alias("pos", "item")).select("file", "pos", "item.*")


def bad_files(spark: SparkSession, path: str, row: str) -> DataFrame:
    """(file) for each file that json_arrays gives no rows of because it can't be read."""
    return _files(spark, path).where(F.from_json("value", f"array<{row}>").isNull()).select("file")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def model_and_constraint(file: Column) -> Column:
    """struct(model, constraint) from .../<model>/<constraint>_<model>[_<time>].json.

    Where the file doesn't name the whole model, it is cut at the first part of the model's name.
    """
    model = F.regexp_extract(file, "([^/]+)/[^/]+$", 1)
    name = F.regexp_replace(F.regexp_extract(file, "([^/]+)$", 1), r"\.json$", "")
    prefix = F.concat(F.split(model, "-")[0], F.lit("-"))
    cut = F.when(F.contains(name, model), F.expr("1")).otherwise(0)
    head = F.when(cut == 1, F.split_part(name, model, F.lit(1))).otherwise(F.split_part(name, prefix, F.lit(1)))
    return F.struct(model.alias("model"), F.regexp_replace(head, "^_+|_+$", "").alias("constraint"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object per line; bad lines are skipped, or fail the read if strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def checked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, item, bad) for every line that isn't blank: its object, and whether it is no such object.

    One pass for both: the good lines are ``where("not bad").select("file", "item.*")``, and
    counters.Counters counts the bad ones while these are used.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    item = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    parsed = lines.select("file", item.alias("item"))
    bad = F.col("item").isNull() | F.col("item._bad").isNotNull()
    return parsed.select("file", F.col("item").dropFields("_bad").alias("item"), bad.alias("bad"))


def line_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, good, bad): how many lines of each file are objects of the schema and how many aren't."""
    each = checked_lines(spark, path, schema)
    return each.groupBy("file").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """json_lines of a path that need not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    if there is None or len(there) == 0:
        return spark.createDataFrame([], schema)
    return json_lines(spark, path, schema)


def with_tests(prompts: DataFrame, tests: DataFrame) -> DataFrame:
    """prompts with their test cases; an empty list where there are none."""
    joined = prompts.join(tests.select("constraint", "pos", "tests"), ["constraint", "pos"], "left")
    return joined.withColumn("tests", F.coalesce("tests", F.from_json(F.lit("[]"), "array<struct<name:string,input:string,expected_output:string>>")))


def with_prompt_file(groups: DataFrame, prompts: DataFrame) -> DataFrame:
    """groups (constraint, ...) with ``prompt_file``, the constraint of prompts that belongs to each:
    of the same name or, without one, of that with "-" for "_". Groups without any drop out."""
    names = prompts.select(F.col("constraint").alias("prompt_file")).distinct()
    same = names.select(F.col("prompt_file").alias("constraint"), F.col("prompt_file").alias("_same"))
    dashed = names.select(F.col("prompt_file").alias("_dashed"))
    joined = groups.join(same, "constraint", "left").join(dashed, F.translate("constraint", "_", "-") == F.col("_dashed"), "left")
    joined = joined.withColumn("prompt_file", F.coalesce("_same", "_dashed")).drop("_same", "_dashed")
    return joined.where("prompt_file is not null")


def write_records(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in a folder per value of ``by``."""
    df.write.partitionBy(*by).json(path)


def score_map(scores: DataFrame) -> DataFrame:
    """(model, scores): each model's scores as JSON by constraint, of a long table (model, constraint, ...)."""
    value = F.struct(*[F.col(f"`{c}`") for c in scores.columns if c not in ("model", "constraint")])
    entries = F.array_sort(F.collect_list(F.struct("constraint", value.alias("score"))))
    return scores.groupBy("model").agg(F.to_json(F.map_from_entries(entries)).alias("scores"))


def export_array(df: DataFrame) -> DataFrame:
    """(file, body): one JSON array per file in order of pos, for exports in the interchange layout.

    A file is a group, so this is for tables that were such files before.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("file", "pos")])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"])
    return df.groupBy("file").agg(F.to_json(ordered).alias("body"))


def summary_export(details: DataFrame, model: str, matched: str, confidence: str, threshold: float) -> DataFrame:
    """(model, body): per model one JSON object of ``summary`` and ``results``, for exports in the interchange layout."""
    hit = F.coalesce(F.col(matched), F.lit(False)).cast("int")
    summary = F.struct(
        F.count("*").alias("total"), F.sum(hit).alias("matched"), F.avg(hit).alias("pass_rate"), F.lit(threshold).alias("confidence_threshold"), F.avg(F.coalesce(confidence, F.lit(0.0))).alias("average_confidence")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in details.columns if c != model])
    out = details.groupBy(model).agg(summary.alias("summary"), F.sort_array(F.collect_list(row)).alias("results"))
    named = F.struct("summary.total", "summary.matched", "summary.pass_rate", F.col(model).alias("model_name"), "summary.confidence_threshold", "summary.average_confidence")
    return out.select(F.col(model).alias("model"), F.to_json(F.struct(named.alias("summary"), "results")).alias("body"))


def metadata_export(summaries: DataFrame, eval_model: str, threshold: float, with_tests: bool) -> DataFrame:
    """One JSON object of ``metadata`` and ``results``, the results of each model (model, ...) by its name.

    One row per model, so the object is small.
    """
    value = F.struct(*[F.col(f"`{c}`") for c in summaries.columns if c != "model"])
    results = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", value.alias("v")))))
    about = F.struct(F.lit(eval_model).alias("eval_model"), F.lit(threshold).alias("confidence_threshold"), F.lit(with_tests).alias("testcase_provided"))
    return summaries.agg(results.alias("results")).select(F.to_json(F.struct(about.alias("metadata"), "results")).alias("body"))


def stamped(prefix: Column) -> Column:
    """A file name with the time of the query."""
    return F.concat(prefix, F.lit("_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.lit(".json"))
