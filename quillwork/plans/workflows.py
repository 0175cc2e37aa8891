"""The whole workflows: construct instructions, evaluate responses, score levels, repair.

``respond`` is a function from a DataFrame with ``prompt`` to the same with ``response`` and
``error``; external.from_table and external.from_client make such functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.functions.lexer import lexed
from quillwork.operators import relational as R
from quillwork.operators import templates
from quillwork.operators.code_checks import check_rows, level_passes, parsed
from quillwork.operators.code_facts import python_facts, type_names
from quillwork.operators.external import evolved, failed
from quillwork.operators.lineage import durable
from quillwork.operators.similarity import rouge_l_filter

Respond = Callable[[DataFrame], DataFrame]
#: Constraints of the rule categories that a judge decides all the same.
JUDGED_CONSTRAINTS = ["declaration_style", "framework", "input_range", "output_range"]


def construct(slots: DataFrame, seeds: DataFrame, constraint: str, respond: Respond, seed_key: str, limit: float = 0.7) -> DataFrame:
    """New instructions of a constraint, without near-duplicates: (id, constraint, prompt, answer).

    slots has a 0-based ``pos`` for each instruction wanted. Explicit constraints ask for a prompt
    and an answer between tags; of implicit ones the whole response is the prompt.
    """
    dealt = R.assign_balanced(slots.select("pos"), seeds, seed_key)
    asked = templates.prompts(dealt.join(seeds, seed_key), constraint).select("pos", "prompt")
    got = durable(respond(asked)).where(~failed(F.col("error"), F.col("response")))
    pair = T.tagged_pair(F.col("response"))
    if constraint in templates.EXPLICIT:
        rows = got.select("pos", pair["prompt"].alias("prompt"), pair["answer"].alias("answer")).where("prompt != ''")
    else:
        rows = got.select("pos", T.strip(F.col("response")).alias("prompt"), F.lit("").alias("answer"))
    kept = rouge_l_filter(rows, "pos", "prompt", limit)
    return R.reindexed(kept, F.col("pos")).select("id", F.lit(constraint).alias("constraint"), "prompt", "answer")


def evolve(instructions: DataFrame, respond: Respond, levels: int = 3) -> DataFrame:
    """Each instruction and its further levels, every level asked for from the one before."""

    def step(current: DataFrame, level: int) -> DataFrame:
        ask = current.withColumn("old", F.col("prompt")).withColumn("prompt", F.concat(F.lit("Add one more constraint on the data structure.\nPrompt: "), "prompt", F.lit("\nAnswer: "), "answer"))
        new = T.tagged_pair(F.col("response"), "new_prompt", "new_answer")
        out = respond(ask).where(~failed(F.col("error"), F.col("response")))
        return out.select("id", new["prompt"].alias("prompt"), new["answer"].alias("answer")).where("prompt != ''")

    return evolved(instructions.select("id", "prompt", "answer"), step, levels)


def evaluate(generations: DataFrame, instructions: DataFrame, respond: Respond | None = None) -> DataFrame:
    """Detail rows: each response joined with its instruction by position and checked.

    generations: (model, constraint_file, pos, response); instructions: (constraint_file, pos, id,
    category, constraint, prompt, answer). Rows for the judge get is_matched from ``respond``, or
    stay null without one.
    """
    rows = R.positional_join(generations, instructions, ["constraint_file"])
    judged = ~F.col("category").isin(R.RULE_CATEGORIES) | F.col("constraint").isin(JUDGED_CONSTRAINTS)
    columns = ["model", "constraint_file", "pos", "id", "category", "constraint", "prompt", "answer", "generated_code", "is_matched", "error_message"]
    ruled = check_rows(rows.where(~judged)).select(*columns)
    left = rows.where(judged).withColumn("generated_code", T.extract_code(F.col("response")))
    if respond is None:
        return ruled.unionByName(left.withColumn("is_matched", F.lit(None).cast("boolean")).withColumn("error_message", F.lit("not judged")).select(*columns))
    ask = left.drop("response").withColumn("requirement", F.col("prompt")).withColumn("prompt", templates.judge_question(F.col("category"), F.col("constraint"), F.col("prompt"), F.col("generated_code"), F.col("answer")))
    said = respond(ask).withColumn("prompt", F.col("requirement")).withColumn("is_matched", F.coalesce(T.says_yes(F.col("response")), F.lit(False)))
    return ruled.unionByName(said.withColumnRenamed("error", "error_message").select(*columns))


def scores(details: DataFrame) -> DataFrame:
    """Per model and constraint file, and over all files of a model."""
    return R.score(details, ["model", "constraint_file"], F.col("is_matched"), overall=["model"])


def evaluate_levels(generations: DataFrame, instructions: DataFrame) -> DataFrame:
    """SSR and HSR per model, constraint file and level; each response is checked against the
    answers of its own and all lower levels of its chain."""
    chained = R.chains(instructions, ["constraint_file"]).select("constraint_file", "pos", "level", "chain")
    rows = R.positional_join(generations, chained, ["constraint_file"]).withColumn("code", T.extract_code(F.col("response")))
    rows = rows.withColumn("facts", python_facts(F.col("code"), F.lit(None).cast("string")))
    each = rows.select("model", "constraint_file", "pos", "level", "code", "facts", F.explode("chain").alias("link"))
    each = each.withColumn("answer", parsed(F.regexp_replace("link", "^;+|;+$", "")))
    each = each.withColumn("lexed", lexed(F.col("code"), F.col("answer.first")))
    each = each.withColumn("types", type_names(F.col("lexed.blank"), F.col("answer.language")))
    passed = each.select("model", "constraint_file", "pos", "level", level_passes(F.col("lexed.bare"), F.col("facts"), F.col("answer"), F.col("types")).alias("ok"))
    checks = passed.groupBy("model", "constraint_file", "pos", "level").agg(F.collect_list("ok").alias("checks"))
    return R.level_scores(checks, ["model", "constraint_file"])


def judge_functions(instructions: DataFrame, generations: DataFrame, respond: Respond, threshold: float = 0.7) -> DataFrame:
    """Functional verdicts: language, function, verdict and whether it passes, per response."""
    rows = R.positional_join(generations, instructions, ["constraint_file"]).withColumn("generated_code", T.extract_code(F.col("response")))
    both = T.language_and_function(F.col("answer"))
    ask = rows.drop("response").withColumn("prompt", templates.judge_prompt(F.col("prompt"), F.col("generated_code"), F.col("tests") if "tests" in rows.columns else None))
    said = respond(ask.withColumn("language", both["language"]).withColumn("function_name", both["function_name"]))
    verdict = T.parse_verdict(F.coalesce("response", F.lit("")))
    out = said.withColumn("verdict", verdict)
    return out.withColumn("is_matched", T.passes(F.col("verdict"), threshold)).withColumn("raw", F.substring("response", 1, 500))


def generate_tests(instructions: DataFrame, respond: Respond, cases: int = 10) -> DataFrame:
    """instructions with ``tests``, empty where the response holds none."""
    asked = instructions.withColumn("requirement", F.col("prompt")).withColumn("prompt", F.concat(F.lit(f"Write {cases} test cases as JSON with the key tests.\nTask: "), "prompt", F.lit("\nAnswer: "), "answer"))
    got = respond(asked).withColumn("prompt", F.col("requirement"))
    return got.withColumn("tests", T.parse_tests(F.coalesce("response", F.lit("")))).drop("requirement", "response", "error")


def concepts(snippets: DataFrame, respond: Respond) -> DataFrame:
    """snippets (code) with ``concepts``; those whose call failed are left out."""
    got = respond(snippets.withColumn("prompt", F.concat(F.lit("List the concepts of this code: "), "code")))
    good = ~failed(F.col("error"), F.col("response"))
    return got.where(good & ~T.is_error(F.col("response"))).withColumn("concepts", T.strip(F.col("response"))).drop("prompt", "response", "error")


def repair_turn(details: DataFrame, respond: Respond) -> DataFrame:
    """The next turn's generations: matched rows keep their code, the others are asked for anew."""
    failed_rows = details.where("is_matched is null or not is_matched")
    asked = failed_rows.select("id", templates.repair_prompt(F.col("prompt"), F.col("generated_code")).alias("prompt"))
    answered = durable(respond(asked)).where("error is null")
    return R.repaired(details, answered)
