"""Constraint checks on code: (code, facts, answer) to a boolean, never null, false for what is unknown.

Python checks take the facts of python_facts; the others take code without comments. The answer
is a struct as ``parsed`` gives it; how its text is written depends on the constraint and is
given in each docstring.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.lexer import lexed
from quillwork.functions.text import bracket_list, contains_number, extract_code, last_segment, level_check, quoted_list, strip, strip_strings
from quillwork.operators import code_facts, layout_checks

#: Spellings of each type, by language.
SPELLINGS = {
    "python": {
        "List": ["List", "list"], "Set": ["Set", "set"], "Map": ["Dict", "dict", "Map"], "Tuple": ["Tuple", "tuple"], "String": ["str", "String"],
        "JSONObject": ["dict", "Dict"], "Boolean": ["bool"], "Integer": ["int"], "Float": ["float"],
    },
    "java": {
        "List": ["List", "ArrayList", "LinkedList"], "Set": ["Set", "HashSet", "TreeSet", "LinkedHashSet"], "Map": ["Map", "HashMap", "TreeMap", "LinkedHashMap"],
        "Tuple": ["Pair", "Triple", "AbstractMap.SimpleEntry"], "String": ["String"], "JSONObject": ["JSONObject", "org.json.JSONObject", "com.google.gson.JsonObject", "com.fasterxml.jackson.databind.node.ObjectNode"],
        "Boolean": ["boolean", "Boolean"], "Integer": ["int", "Integer", "long", "Long", "short", "Short"], "Float": ["float", "Float", "double", "Double"],
    },
    "cpp": {
        "List": ["std::vector", "vector", "std::list", "list"], "Set": ["std::set", "std::unordered_set", "set", "unordered_set"], "Map": ["std::map", "std::unordered_map", "map", "unordered_map"],
        "Tuple": ["std::pair", "std::tuple", "pair", "tuple"], "String": ["std::string", "string"],
        "JSONObject": ["nlohmann::json", "Json::Value", "json"], "Boolean": ["bool"], "Integer": ["int", "long", "short", "size_t", "uint32_t", "int64_t", "int32_t"], "Float": ["float", "double"],
    },
    "rust": {
        "List": ["Vec", "vec", "LinkedList"], "Set": ["HashSet", "BTreeSet"], "Map": ["HashMap", "BTreeMap"], "Tuple": ["(", "tuple"], "String": ["String", "&str", "str"],
        "JSONObject": ["serde_json::Value", "serde_json::Map"], "Boolean": ["bool"],
        "Integer": ["i32", "i64", "u32", "u64", "usize", "isize", "i16", "u16", "i8", "u8"], "Float": ["f32", "f64"],
    },
}
#: The language versions that are known; others never pass.
VERSIONS = {
    "rust": ["1.87.0", "1.86.0", "1.85.0", "1.78.0", "1.74.0", "1.70.0", "1.60.0"],
    "python": ["3.13", "3.10", "3.8"],
    "java": ["jdk11", "jdk17", "jdk21"],
}
PYTHON_KINDS = {"generator and yield": ["Yield", "YieldFrom"], "list comprehension": ["ListComp"], "dictionary comprehension": ["DictComp"], "set comprehension": ["SetComp"]}
#: Patterns that all have to be there, over code without comments and strings.
OTHER_SYNTAX = {
    ("javascript", "async/await"): [r"\basync\b", r"\bawait\b"],
    ("javascript", "arrow functions"): ["=>"],
    ("javascript", "spread operator"): [r"\.\.\."],
    ("go", "goroutine and channel"): [r"\bgo\s+[\w(]", r"\bchan\b", "<-"],
    ("go", "defer statement"): [r"\bdefer\b"],
    ("kotlin", "lambda expression"): [r"\{[^{}]*->|[\w)]\s*\{\s*(?:it\b|\w+\s*->)"],
    ("kotlin", "when expression"): [r"\bwhen\s*[({]"],
    ("rust", "match expression"): [r"\bmatch\s+[^{;]+\{"],
    ("rust", "if let syntax sugar"): [r"\bif\s+let\b"],
    ("rust", "closures"): [r"(?:[=(,]|\bmove\b|\breturn\b)\s*\|[^|\n]*\|"],
}


def _spellings(lower: bool) -> Column:
    def cased(x: str) -> str:
        return x.lower() if lower else x

    rows = [(f"{language}:{cased(kind)}", [cased(s) for s in names]) for language, kinds in SPELLINGS.items() for kind, names in kinds.items()]
    return F.from_json(F.lit(json.dumps(dict(rows))), "map<string,array<string>>")


def sure(check: Column) -> Column:
    return F.coalesce(check, F.lit(False))


def part(answer: Column, i: int) -> Column:
    return F.try_element_at(F.split(answer, ";"), F.lit(i))


def parsed(answer: Column) -> Column:
    """An answer's parts as a struct: language in one spelling, first as written, second, third."""
    name = F.lower(strip(part(answer, 1)))
    language = F.when(name.isin("c++", "cpp"), "cpp").when(name.isin("c#", "csharp"), "csharp").when(name.isin("js", "javascript"), "javascript").otherwise(name)
    return F.struct(language.alias("language"), part(answer, 1).alias("first"), part(answer, 2).alias("second"), part(answer, 3).alias("third"), answer.alias("whole"))


def _any(names: Column, wanted: Column) -> Column:
    return F.array_contains(names, wanted)


def calls_function(code: Column, facts: Column, answer: Column) -> Column:
    """language;name: the code calls it. Of a qualified name the last segment counts."""
    name = last_segment(answer["second"])
    return sure(F.when(answer["language"] == "python", _any(facts["calls"], name)).otherwise(_any(code_facts.calls(code), name)))


def uses_library(code: Column, facts: Column, answer: Column) -> Column:
    """language;library. Python: ``import a.b`` has to be equal, of ``from a.b`` the head counts.
    Elsewhere the library stands anywhere in an import's path."""
    name, language = answer["second"], answer["language"]
    python = _any(facts["imports"], name) | _any(facts["heads"], name)
    other = F.exists(code_facts.import_paths(code, language), lambda p: F.contains(p, name))
    known = language.isin("javascript", "typescript", "go", "rust")
    return sure(F.when(language == "python", python).otherwise(known & other))


def uses_syntax(code: Column, facts: Column, answer: Column) -> Column:
    """language;feature, of a closed list."""
    language, feature = answer["language"], F.lower(answer["second"])
    out = F.lit(False)
    for name, kinds in PYTHON_KINDS.items():
        out = F.when((language == "python") & (feature == name), F.arrays_overlap(facts["kinds"], F.array(*[F.lit(k) for k in kinds]))).otherwise(out)
    for (tongue, name), patterns in OTHER_SYNTAX.items():
        there = F.lit(True)
        for p in patterns:
            there = there & code.rlike(p)
        out = F.when((language == tongue) & (feature == name), there).otherwise(out)
    return sure(out)


def _type_fits(written: Column, wanted: Column, language: Column) -> Column:
    """Whether a type as written is of the wanted kind. Python looks at its start, the others anywhere."""
    low = F.lower(written)
    deep = F.length(written) - F.length(F.translate(written, "<", ""))
    square = F.length(written) - F.length(F.translate(written, "[", ""))
    matrix = (
        F.when(language == "python", F.contains(low, F.lit("list")) & (square >= 2))
        .when(language == "java", (written.rlike("List|Array") & (deep >= 2)) | F.contains(written, F.lit("[][]")))
        .when(language == "cpp", (F.contains(written, F.lit("vector")) & (deep >= 2)) | F.contains(written, F.lit("[")))
        .otherwise(F.contains(written, F.lit("Vec")) & (deep >= 2))
    )
    spelled = _spellings(False)[F.concat_ws(":", language, wanted)]
    named = F.exists(spelled, lambda x: F.when(language == "python", F.startswith(written, x)).otherwise(F.contains(written, x)))
    named = named | ((language == "cpp") & (wanted == "List") & F.contains(written, F.lit("[")))
    return (
        F.when(wanted == "Matrix", matrix)
        .when(wanted == "Tree", F.contains(low, F.lit("tree")))
        .when(wanted == "Graph", low.rlike("graph|adj"))
        .when(wanted.startswith("Struct:"), F.contains(written, F.split(wanted, ":", 2)[1]))
        .otherwise(named)
    )


def _signatures(facts: Column, name: Column) -> Column:
    return F.filter(facts["signatures"], lambda s: s["name"] == name)


def input_type(code: Column, facts: Column, answer: Column) -> Column:
    """language;function;type: a parameter of the function has the type."""
    language, name, wanted = answer["language"], answer["second"], answer["third"]
    python = F.exists(F.flatten(F.transform(_signatures(facts, name), lambda s: s["parameters"])), lambda p: (p != "None") & _type_fits(p, wanted, language))
    other = F.exists(code_facts.parameters(code, language, name), lambda p: _type_fits(p, wanted, language))
    return sure(F.when(language == "python", python).when(language.isin("java", "cpp", "rust"), other))


def output_type(code: Column, facts: Column, answer: Column) -> Column:
    """language;function;type: the function returns the type."""
    language, name, wanted = answer["language"], answer["second"], answer["third"]
    python = F.exists(_signatures(facts, name), lambda s: _type_fits(s["returns"], wanted, language))
    other = _type_fits(code_facts.returned(code, language, name), wanted, language)
    return sure(F.when(language == "python", python).when(language.isin("java", "cpp", "rust"), other))


def _place_fits(written: Column, wanted: Column, language: Column) -> Column:
    """Whether a parameter fits its place. Two oddities are kept: in Java an array of arrays is no
    matrix, and an adjacency list no graph."""
    low, want = F.lower(written), F.lower(wanted)
    square = F.length(written) - F.length(F.translate(written, "[", ""))
    python = (
        F.when(F.contains(want, F.lit("map")), low.rlike("^(?:dict|map)"))
        .when(F.contains(want, F.lit("matrix")), low.startswith("list") & (square >= 2))
        .when(F.contains(want, F.lit("graph")), low.rlike("graph|adj"))
        .otherwise(low.startswith(want))
    )
    deep = F.length(written) - F.length(F.translate(written, "<", ""))
    listed = written.rlike("List|Array|vector|Vec") & (deep >= 2)
    spelled = F.exists(_spellings(True)[F.concat_ws(":", language, want)], lambda x: F.contains(low, x))
    other = (
        F.when(F.contains(want, F.lit("matrix")), F.when(language == "java", listed & ~F.contains(written, F.lit("[][]"))).otherwise(listed | F.contains(written, F.lit("["))))
        .when(F.contains(want, F.lit("graph")), F.when(language == "java", F.contains(low, F.lit("graph")) & ~F.contains(low, F.lit("adj"))).otherwise(low.rlike("graph|adj")))
        .when(want == "tree", low.rlike("tree|node"))
        .otherwise(spelled)
    )
    return F.when(language == "python", python).otherwise(other)


def input_order(code: Column, facts: Column, answer: Column) -> Column:
    """language;function;[A,B]: as many parameters, each of its place's type."""
    language, name, wanted = answer["language"], answer["second"], bracket_list(answer["third"])
    python = F.element_at(F.transform(_signatures(facts, name), lambda s: s["parameters"]), 1)
    python = F.when(F.size(_signatures(facts, name)) > 0, python)
    found = F.when(language == "python", python).otherwise(code_facts.parameters(code, language, name))
    fits = F.forall(F.zip_with(found, wanted, lambda p, w: F.coalesce(_place_fits(p, w, language), F.lit(False))), lambda x: x)
    return sure((F.size(found) == F.size(wanted)) & fits)


def same_outputs(found: Column, wanted: Column) -> Column:
    """As many outputs, each part of the other's text, in either direction."""
    pairs = F.zip_with(found, wanted, lambda a, b: F.contains(b, a) | F.contains(a, b))
    return sure((F.size(found) == F.size(wanted)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False))))


def output_order(code: Column, facts: Column, answer: Column) -> Column:
    """language;function;[A,B]. Python looks into the first brackets of the annotation, up to the
    first closing one."""
    language, name, wanted = answer["language"], answer["second"], bracket_list(answer["third"])
    written = F.when(F.size(_signatures(facts, name)) > 0, F.element_at(F.transform(_signatures(facts, name), lambda s: s["returns"]), 1))
    python = F.when(written.rlike(r"\[.*?\]"), F.transform(F.split(F.regexp_extract(written, r"\[(.*?)\]", 1), ","), strip))
    other = F.transform(F.split(F.regexp_replace(code_facts.returned(code, language, name), r"^\(+|\)+$", ""), ","), strip)
    found = F.when(language == "python", python).when(language.isin("rust", "go"), F.filter(other, lambda x: x != ""))
    return same_outputs(found, wanted)


def structure_type(code: Column, facts: Column, answer: Column, types: Column | None = None) -> Column:
    """language;structure. Python: structures that are called or imported; elsewhere names in the
    position of a type. types: these names, where they are at hand."""
    language, name = answer["language"], F.lower(answer["second"])
    python = F.array_contains(F.transform(facts["structures"], F.lower), name)
    base = F.regexp_replace(F.substring_index(name, "::", -1), "<.*$", "")
    other = F.array_contains(F.transform(code_facts.type_names(strip_strings(code), language) if types is None else types, F.lower), base)
    return sure(F.when(language == "python", python).when(language.isin("java", "cpp", "rust", "go"), other))


def structure_size(code: Column, facts: Column, answer: Column, types: Column | None = None) -> Column:
    """language;structure;n. The digits of n stand anywhere in the code. In Rust and Go a structure
    with capitals in its name never passes."""
    language, name, n = answer["language"], answer["second"], strip(answer["third"]).try_cast("int")
    odd = language.isin("rust", "go") & (name != F.lower(name))
    return sure(structure_type(code, facts, answer, types) & contains_number(code, n) & ~odd)


def structure_operation(code: Column, facts: Column, answer: Column, types: Column | None = None) -> Column:
    """language;structure;['f','g']: the structure is there and every operation is called."""
    called = F.when(answer["language"] == "python", facts["calls"]).otherwise(code_facts.calls(code))
    return sure(structure_type(code, facts, answer, types) & F.forall(quoted_list(answer["third"]), lambda o: F.array_contains(called, last_segment(o))))


def level_passes(code: Column, facts: Column, answer: Column, types: Column | None = None) -> Column:
    """The check of a multi-level answer: type, size or operation by its form."""
    kind = level_check(answer["whole"])
    return (
        F.when(kind == "operation", structure_operation(code, facts, answer, types))
        .when(kind == "size", structure_size(code, facts, answer, types))
        .otherwise(structure_type(code, facts, answer, types))
    )


def naming_convention(code: Column, facts: Column, answer: Column) -> Column:
    """language;class:A,function:B,variable:C."""
    python = answer["language"] == "python"
    classes = F.regexp_extract_all(code, F.lit(r"\b(?:class|struct|interface|enum|trait|object|type)\s+(\w+)"), F.lit(1))
    functions = F.regexp_extract_all(code, F.lit(r"\b(?:fn|func|fun|function)\s+(\w+)|[\w>\]]\s+(\w+)\s*\([^()]*\)\s*\{"), F.lit(1))
    functions = F.array_remove(F.concat(functions, F.regexp_extract_all(code, F.lit(r"[\w>\]]\s+(\w+)\s*\([^()]*\)\s*\{"), F.lit(1))), "")
    pick = lambda field, other: F.when(python, facts[field]).otherwise(other)
    return sure(layout_checks.naming(pick("classes", classes), pick("functions", functions), pick("words", code_facts.words(code)), answer["second"]))


def syntax_tree(code: Column, facts: Column, answer: Column) -> Column:
    """Whether the code parses. Known for Python alone; other languages give false."""
    return sure((answer["language"] == "python") & facts["parsed"])


def written_in(code: Column, facts: Column, answer: Column) -> Column:
    """language: the guess by keywords is that language. An approximation."""
    guess = code_facts.guess_language(code)
    return sure(F.lower(strip(answer["first"])) == guess)


def version_known(answer: Column) -> Column:
    """language;version: whether the version is one of the known ones, as it is written."""
    out = F.lit(False)
    for name, versions in VERSIONS.items():
        out = F.when(answer["language"] == name, answer["second"].isin(versions)).otherwise(out)
    return sure(out)


def language_version(code: Column, facts: Column, answer: Column) -> Column:
    """language;version: the code compiles in a known version. Python parses by that version's
    grammar; the others need a compiler (``toolchain.check_compilation``) and are false without."""
    return sure(version_known(answer) & (answer["language"] == "python") & facts["in_version"])


Check = Callable[..., Column]
CHECKS: dict[str, Check] = {
    "language_type": written_in,
    "advanced_syntax": uses_syntax,
    "function": calls_function,
    "library": uses_library,
    "input_type": input_type,
    "output_type": output_type,
    "input_order": input_order,
    "output_order": output_order,
    "type": structure_type,
    "size": structure_size,
    "operation": structure_operation,
    "naming_convention": naming_convention,
    "indentation_spacing": lambda code, facts, answer: layout_checks.check_indentation(code, answer["whole"], code),
    "brace_block_formatting": lambda code, facts, answer: layout_checks.check_braces(code, answer["whole"], code),
    "comment_formatting": lambda code, facts, answer: sure(layout_checks.comment_style(code, answer["first"], answer["second"], facts["documented"])),
    "level": level_passes,
    "ast_syntax": syntax_tree,
    "language_version": language_version,
}
#: Checks on the code as it is; the others take it without comments.
RAW = {"language_type", "library", "comment_formatting", "ast_syntax", "language_version"}
#: Checks that take the code without its literals, and those that take the names of types too.
BLANK = {"advanced_syntax", "function", "input_type", "output_type", "input_order", "output_order", "naming_convention", "indentation_spacing"}
TYPED = {"type", "size", "operation", "level"}
#: Checks that look into parsed Python; only for these is code parsed.
PARSED = set(CHECKS) - {"language_type", "indentation_spacing", "brace_block_formatting"}
#: Tasks for each core when rows are dealt out to be parsed.
TASKS_EACH = 4


def _trimmed(answer: str) -> Column:
    return F.regexp_replace(F.col(f"`{answer}`"), "^;+|;+$", "")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores: to parse a row takes far longer than to read it, and millions of short rows are one small file."""
    return df.repartition(TASKS_EACH * df.sparkSession.sparkContext.defaultParallelism)


def with_facts(df: DataFrame, response: str = "response", answer: str | None = "answer", constraint: str | None = "constraint") -> DataFrame:
    """df with ``_facts`` of the Python code in its responses.

    Without an answer, each response is parsed as Python, and ``_python`` is that code as the lexer leaves it.
    """
    df = spread(df)
    code, version = extract_code(F.col(f"`{response}`")), F.lit(None).cast("string")
    if answer:
        parts = parsed(_trimmed(answer))
        named = F.col(f"`{constraint}`")
        code = F.when((parts["language"] == "python") & named.isin(list(PARSED)), code)
        version = F.when(named == "language_version", parts["second"])
    else:
        df = df.withColumn("_python", lexed(code, F.lit("python")))
    return df.withColumn("_facts", code_facts.python_facts(code, version))


def check_rows(df: DataFrame, response: str = "response", answer: str = "answer", constraint: str = "constraint") -> DataFrame:
    """df with generated_code, is_matched and error_message by the constraint of each row.

    Code of other languages isn't parsed; an unknown constraint is false and says so. The checks
    stand in one CASE over the constraint, so each row runs its own only. The columns ``_facts`` and
    ``_python`` (``with_facts``) are taken where rows of one response stand under several constraints.
    """
    out = df if "_facts" in df.columns else with_facts(df, response, answer, constraint)
    out = out.withColumn("generated_code", extract_code(F.col(f"`{response}`"))).withColumn("_answer", parsed(_trimmed(answer)))
    python = F.col("_answer.language") == "python"
    if "_python" in df.columns:
        other = lexed(F.when(python, F.lit(None)).otherwise(F.col("generated_code")), F.col("_answer.first"))
        out = out.withColumn("_lexed", F.when(python, F.col("_python")).otherwise(other))
    else:
        out = out.withColumn("_lexed", lexed(F.col("generated_code"), F.col("_answer.first")))
    typed = F.col(f"`{constraint}`").isin(list(TYPED)) & ~python
    out = out.withColumn("_types", F.when(typed, code_facts.type_names(F.col("_lexed.blank"), F.col("_answer.language"))))
    matched = F.lit(False)
    for name, check in CHECKS.items():
        code = F.col("generated_code") if name in RAW else F.col("_lexed.blank") if name in BLANK else F.col("_lexed.bare")
        more = [F.col("_types")] if name in TYPED else []
        matched = F.when(F.col(f"`{constraint}`") == name, check(code, F.col("_facts"), F.col("_answer"), *more)).otherwise(matched)
    known = F.col(f"`{constraint}`").isin(list(CHECKS))
    error = F.when(~sure(known), "unknown constraint").when((F.col(f"`{constraint}`") == "language_version") & ~python & version_known(F.col("_answer")), "needs a compiler").when(python, F.col("_facts.error"))
    return out.withColumn("is_matched", sure(matched)).withColumn("error_message", error).drop("_facts", "_python", "_answer", "_lexed", "_types")
