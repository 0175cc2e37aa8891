"""Prompt templates: a registry of constraints, each a text over the fields of a seed."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.relational import sorted_parameters

#: Constraint to lines of text with {fields} of its seed; {lang} is a language of its own.
TEMPLATES = {
    "advanced_syntax": ["Use the {language} feature {advanced_syntax}.", "Feature: {features}", "Example: {example}"],
    "algorithm_type": ["Write in {lang}.", "Use an algorithm of the type {Name}."],
    "algorithm_time_complexity": ["Write in {lang}.", "Use an algorithm of the type {Name}.", "State the time complexity in Big O notation."],
    "algorithm_space_complexity": ["Write in {lang}.", "Use an algorithm of the type {Name}.", "State the space complexity in Big O notation."],
    "brace_block_formatting": ["Write in {lang} with braces in the style {name}.", "Style: {description}", "Example: {example}"],
    "comment_formatting": ["Write in {lang} with comments of the form {name} only.", "Form: {feature}", "Example: {example}"],
    "data_structure_type": ["Write in {language} and use the structure {data_structure}.", "Structure: {description}"],
    "data_structure_size": ["Write in {language} and use the structure {data_structure}.", "Limit the number of its elements."],
    "data_structure_operation": ["Write in {language} and use the structure {data_structure}.", "Call these operations on it: {operations}."],
    "declaration_style": ["Write in {lang} with declarations in the style {type}.", "Style: {description}", "Example: {example}"],
    "framework": ["Use the framework {framework} for {language}.", "Features: {features}"],
    "function": ["Call the {language} function {name} ({category}).", "What it does: {description}", "Example: {example}"],
    "indentation_spacing": ["Write in {lang} with this layout: {name}.", "Layout: {feature}", "Example: {example}"],
    "input_order": ["Write in {lang}.", "Take the parameters in this order ({feature}): {parameters}"],
    "input_range": ["Write in {lang}.", "Take a {data_structure} with values in this range: {range}.", "Range: {feature}"],
    "input_type": ["Write in {lang}.", "Take a {name} as input.", "Type: {description}"],
    "library": ["Use the {language} library {name} ({category}).", "Library: {description}", "Example: {example}"],
    "output_order": ["Write in {lang}.", "Return the values in this order ({feature}): {parameters}"],
    "output_range": ["Write in {lang}.", "Return a {data_structure} in this range: {range}.", "Range: {feature}"],
    "output_type": ["Write in {lang}.", "Return a {name}.", "Type: {description}"],
    "naming_convention": ["Write in {lang} with names in {naming_convention}."],
    "situation": ["Situation: {en}", "Description: {description_en}", "Task: {task_en}"],
    "example": ["Write in {lang}.", "Follow this example of input and output: {example}"],
    "code_contextual": ["Complete this code so that it fits its surroundings: {code}", "Concepts: {concepts}"],
    "language_version": ["Write for {language} {version}.", "Use what is new in it: {features}"],
}
#: Comment forms that belong to one language.
COMMENT_LANGUAGES = {"python docstring": "Python", "javadoc": "Java", "rustdoc": "Rust", "godoc": "Go", "kotlindoc": "Kotlin"}
EXPLICIT = {c for c in TEMPLATES if c not in {"situation", "example", "code_contextual"}}
GENERATORS: dict[str, Callable[[dict[str, Column]], Column]] = {}


def register(name: str, build: Callable[[dict[str, Column]], Column]) -> None:
    if name in GENERATORS:
        raise ValueError(f"{name} is there already")
    GENERATORS[name] = build


def generator(name: str) -> Callable[[dict[str, Column]], Column]:
    if name not in GENERATORS:
        raise KeyError(f"no template for {name}")
    return GENERATORS[name]


def fill(lines: list[str], fields: dict[str, Column]) -> Column:
    """The lines with {fields} put in; a null field is empty."""
    out: list[Column] = []
    for line in lines:
        pieces: list[Column] = []
        rest = line
        while "{" in rest:
            before, _, rest = rest.partition("{")
            field, _, rest = rest.partition("}")
            pieces += [F.lit(before), F.coalesce(fields[field].cast("string"), F.lit(""))]
        out.append(F.concat(*pieces, F.lit(rest)))
    return F.concat_ws("\n", *out)


def listed(items: Column) -> Column:
    return F.array_join(items, ", ")


def described(parameters: Column) -> Column:
    """Parameters by position: type and description of each."""
    one = lambda p: F.concat(F.coalesce(p["position"].cast("string"), F.lit("?")), F.lit(": "), F.coalesce(p["data_structure"], F.lit("unknown")), F.when(F.coalesce(p["description"], F.lit("")) != "", F.concat(F.lit(", "), p["description"])).otherwise(""))
    return F.array_join(F.transform(sorted_parameters(parameters), one), "; ")


for _name, _lines in TEMPLATES.items():
    register(_name, lambda fields, lines=_lines: fill(lines, fields))


def comment_language(name: Column, drawn: Column) -> Column:
    """The language that a comment form belongs to, or the drawn one."""
    pairs = [F.lit(x) for kv in COMMENT_LANGUAGES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(name)], drawn)


def prompts(seeds: DataFrame, constraint: str, lang: Column | None = None) -> DataFrame:
    """seeds with ``prompt``, the text of the constraint; fields of list type are joined."""
    fields = {c: (listed(F.col(c)) if kind == "array<string>" else F.col(c)) for c, kind in seeds.dtypes}
    if "parameter_list" in seeds.columns:
        fields["parameters"] = described(F.col("parameter_list"))
    fields["lang"] = lang if lang is not None else F.lit("any language")
    return seeds.withColumn("prompt", generator(constraint)(fields))


def judge_prompt(requirement: Column, code: Column, tests: Column | None = None) -> Column:
    """What a judge is asked about a piece of code; of the test cases the first five are shown."""
    parts = [F.lit("Does the code meet the requirement? Answer YES or NO.\nRequirement: "), requirement, F.lit("\nCode:\n"), code]
    if tests is not None:
        parts += [F.lit("\nTests: "), F.to_json(F.slice(tests, 1, 5))]
    return F.concat(*parts)


#: What a judge is told of each kind: how many parts the answer has, and the wording with their numbers.
JUDGED = {
    "framework": (3, "It has to be written in {0} with the framework {1} and show what is typical of it: {2}"),
    "input_range": (4, "It is in {0}. The function {1} takes a {2} and has to handle these values: {3}"),
    "output_range": (3, "It is in {0} and returns a {1} within this range or format: {2}"),
    "declaration_style": (2, "It has to be written in {0} with declarations in this style: {1}"),
    "type": (1, "It has to use this kind of algorithm: {0}"),
    "time_complexity": (1, "Its running time may not exceed: {0}"),
    "space_complexity": (1, "Its extra memory may not exceed: {0}"),
}
#: What the categories judged against a reference solution ask for.
AGAINST_REFERENCE = {
    "situation": "It has to fit the situation that the task describes.",
    "example": "It has to behave as the examples of the task show.",
    "code_contextual": "It has to fit into the code that the task gives.",
    "non_functional_requirements": "It has to meet the requirements of the task beyond what it computes.",
}


def _limited(answer: Column, parts: int) -> list[Column]:
    """Parts between semicolons, the last one with the rest."""
    split = F.split(answer, ";", parts)
    return [F.coalesce(F.trim(F.get(split, F.lit(i))), F.lit("")) for i in range(parts)]


def judge_question(category: Column, constraint: Column, requirement: Column, code: Column, answer: Column) -> Column:
    """What a judge is asked, by the kind of constraint: with the parts of its answer, or with the
    answer as a reference solution. Other kinds get judge_prompt with the answer."""
    asked = F.concat(F.lit("The answer asked for: "), F.coalesce(answer, F.lit("")))
    for name, text in AGAINST_REFERENCE.items():
        asked = F.when(category == name, F.concat(F.lit(text + "\nReference solution:\n"), F.coalesce(answer, F.lit("")))).otherwise(asked)
    for name, (parts, text) in JUDGED.items():
        given, pieces = _limited(F.coalesce(answer, F.lit("")), parts), re.split(r"\{(\d)\}", text)
        worded = F.concat(*[given[int(x)] if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
        algorithm = name in ("type", "time_complexity", "space_complexity")
        asked = F.when((constraint == name) & ((category == "algorithm") if algorithm else F.lit(True)), worded).otherwise(asked)
    return F.concat(judge_prompt(requirement, code), F.lit("\nConstraint: "), asked)


def repair_prompt(requirement: Column, code: Column) -> Column:
    return F.concat(F.lit("The code doesn't meet the requirement. Write it anew.\nRequirement: "), requirement, F.lit("\nCode:\n"), code)
