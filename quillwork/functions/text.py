"""Scalar text functions: code, tags, answers and model responses. All are column expressions, native but for the lexer's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions import lexer

#: All white space, that beyond ASCII included.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
FENCE = r"(?s)```(?:\w+)?(.*?)```"
JSON_FENCE = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```$"
VERDICT = "struct<meets_requirements:boolean,confidence:double,reasoning:string,issues:array<string>>"
TESTS = "struct<tests:array<struct<name:string,input:string,expected_output:string>>>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE}+$", "")


def extract_code(response: Column) -> Column:
    """The first fenced block without the word after the fence, else the whole response; stripped."""
    fenced = response.rlike(FENCE)
    return strip(F.when(fenced, F.regexp_extract(response, FENCE, 1)).otherwise(response))


def tagged_pair(response: Column, prompt_tag: str = "prompt", answer_tag: str = "answer") -> Column:
    """struct(prompt, answer) between tags; both are empty unless both tags are there."""
    first, second = (f"(?s)<{t}>(.*?)</{t}>" for t in (prompt_tag, answer_tag))
    both = response.rlike(first) & response.rlike(second)
    take = lambda p: F.when(both, strip(F.regexp_extract(response, p, 1))).otherwise("")
    return F.struct(take(first).alias("prompt"), take(second).alias("answer"))


def clean_json(response: Column) -> Column:
    """A response without the fence around the whole of it."""
    s = strip(response)
    return F.when(s.rlike(JSON_FENCE), strip(F.regexp_extract(s, JSON_FENCE, 1))).otherwise(s)


def parse_tests(response: Column) -> Column:
    """The ``tests`` array of a JSON object; empty on any failure. Inputs and outputs stay JSON text."""
    tests = F.from_json(clean_json(response), TESTS)["tests"]
    return F.coalesce(tests, F.from_json(F.lit("[]"), TESTS[len("struct<tests:") : -1]))


def parse_verdict(response: Column) -> Column:
    """A judge's verdict with defaults for absent fields; confidence 0.0 where nothing can be read."""
    body = F.regexp_extract(strip(response), r"(?s)\{.*\}", 0)
    read = F.from_json(body, VERDICT, {"mode": "PERMISSIVE"})
    ok = (body != "") & F.try_parse_json(body).isNotNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, F.coalesce(read["meets_requirements"], F.lit(False))).otherwise(False).alias("meets_requirements"),
        F.when(ok, F.coalesce(read["confidence"], F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.when(ok, F.coalesce(read["reasoning"], F.lit("No reasoning provided"))).otherwise("Invalid JSON").alias("reasoning"),
        F.when(ok, F.coalesce(read["issues"], none)).otherwise(F.array(F.lit("Invalid JSON response"))).alias("issues"),
    )


def passes(verdict: Column, threshold: float = 0.7) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold: {threshold} is not in [0, 1]")
    return verdict["meets_requirements"] & (verdict["confidence"] >= threshold)


def says_yes(response: Column) -> Column:
    """Whether the word yes is anywhere in the response, in any case."""
    return F.contains(F.lower(response), F.lit("yes"))


def is_error(response: Column) -> Column:
    return F.contains(F.lower(response), F.lit("exception"))


def answer_language(answer: Column) -> Column:
    """What stands before the first semicolon, or the whole answer; null if empty."""
    return F.nullif(strip(F.split(answer, ";", 2)[0]), F.lit(""))


def language_and_function(answer: Column, default: str | None = "Python") -> Column:
    parts = F.split(answer, ";")
    language = F.nullif(strip(parts[0]), F.lit(""))
    name = F.nullif(strip(F.try_element_at(parts, F.lit(2))), F.lit(""))
    return F.struct((F.coalesce(language, F.lit(default)) if default else language).alias("language"), name.alias("function_name"))


def split_answer(answer: Column, splits: int) -> Column:
    """Parts between semicolons, at most ``splits`` of which are cut at; the rest stays whole."""
    return F.split(answer, ";", splits + 1)


def bracket_list(text: Column) -> Column:
    """[a,b] as an array; items keep their spaces."""
    return F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ",")


def quoted_list(text: Column) -> Column:
    """['a', 'b'] as an array; null unless it is a list of strings."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def naming_map(text: Column) -> Column:
    """class:A,function:b as a map."""
    return F.str_to_map(text, F.lit(","), F.lit(":"))


def partition(text: Column, mark: str = ":") -> Column:
    parts = F.split(text, mark, 2)
    return F.struct(parts[0].alias("head"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("tail"))


def level_check(answer: Column) -> Column:
    """Which check a multi-level answer asks for: type, size or operation."""
    cut = F.regexp_replace(answer, "^;+|;+$", "")
    marks = F.length(cut) - F.length(F.replace(cut, F.lit(";"), F.lit("")))
    listed = F.contains(cut, F.lit("[")) & F.contains(cut, F.lit("]"))
    return F.when((marks > 1) & listed, "operation").when(marks > 1, "size").otherwise("type")


def code_lines(code: Column) -> Column:
    """Lines that aren't blank, without white space at their ends."""
    return F.transform(F.filter(F.split(code, r"\r\n|\n|\r"), lambda s: strip(s) != ""), rstrip)


def last_segment(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ".", -1), "::", -1)


def rouge_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def contains_number(code: Column, number: Column) -> Column:
    """Whether the number's digits stand anywhere in the code, inside a longer number too."""
    return F.contains(code, number.cast("string"))


def percent(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 2), F.lit("%"))


def same_json(a: Column, b: Column) -> Column:
    """Equality of two JSON texts whatever their white space."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))


def strip_comments(code: Column, language: Column) -> Column:
    """code without comments, as the language's lexer finds them."""
    return lexer.strip_comments(code, language)


def strip_common_comments(code: Column, language: Column) -> Column:
    """code without comments by a pattern per family of languages: native, so that it may stand under
    higher-order functions, but unaware of nested comments and of literals over several lines."""
    strings = r"\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'"  # possessive, so that long literals need no recursion
    hashed = F.regexp_replace(code, rf"({strings})|#[^\n]*", "$1")
    slashed = F.regexp_replace(code, rf"(?s)({strings})|//[^\n]*|/\*.*?\*/", "$1")
    dashed = F.regexp_replace(code, rf"(?s)({strings})|\{{-.*?-\}}|--[^\n]*", "$1")
    kind = F.lower(language)
    return F.when(kind.isin("python", "ruby", "shell", "julia"), hashed).when(kind.isin("haskell", "lua", "sql"), dashed).otherwise(slashed)


def strip_strings(code: Column, language: Column | None = None) -> Column:
    """code without literals: by the language's lexer, or without a language by a pattern of common ones."""
    if language is not None:
        return lexer.strip_strings(code, language)
    return F.regexp_replace(code, r"(?s)\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|`[^`]*`", "")
