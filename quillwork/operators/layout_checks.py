"""Checks of layout, naming and comments, as expressions over the code's text and lines.

Each gives a boolean. Unknown styles give false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.text import code_lines, naming_map, partition, strip, strip_common_comments, strip_strings

#: A name fits a convention if it matches.
CONVENTIONS = {
    "snake_case": "^[a-z]+[a-z0-9_]*$",
    "PascalCase": "^[A-Z][A-Za-z0-9]*$",
    "camelCase": "^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)*$",
    "kebab-case": "^[a-z]+(-[a-z]+)*$",
}
OPERATORS = ["=", r"\+", "-", r"\*", "/", "%", "==", "!=", "<", ">", "<=", ">=", "&&", r"\|\|"]
#: White space and word characters beyond ASCII count too.
UNICODE = "(?U)"
AFTER_BRACE = r"(\)|\w)\s*$"
FOLLOWERS = "^(else|catch|finally)"


def _none(lines: Column, bad) -> Column:
    return ~F.exists(lines, bad)


def brace_style(code: Column, style: Column) -> Column:
    """K&R, Allman or 1TBS. Code without braces passes all of them. code: without comments."""
    lines = F.transform(code_lines(code), strip)
    numbered = F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i")))

    def opens_badly(s: Column) -> Column:
        before = strip(F.split(s, r"\{", 2)[0])
        return (s == "{") | (F.contains(s, F.lit("{")) & ~before.rlike(UNICODE + AFTER_BRACE))

    def allman_bad(x: Column) -> Column:
        s, i = x["s"], x["i"]
        alone = (i == 0) | ~F.coalesce(F.get(lines, i - 1), F.lit("")).rlike(UNICODE + AFTER_BRACE)
        return F.when(s == "{", alone).otherwise(F.contains(s, F.lit("{")))

    def splits_clause(x: Column) -> Column:
        s, i = x["s"], x["i"]
        after = strip(F.element_at(F.split(s, r"\}", 2), -1))
        return F.contains(s, F.lit("}")) & ~after.rlike(FOLLOWERS) & F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(FOLLOWERS)

    kr = _none(lines, opens_badly)
    return F.when(style == "K&R", kr).when(style == "Allman", _none(numbered, allman_bad)).when(style == "1TBS", kr & _none(numbered, splits_clause)).otherwise(False)


def indentation(code: Column, standard: Column, spacing: Column) -> Column:
    """standard: spaces:n or tabs; spacing: ``spacing`` for blanks around operators and after commas.

    code: without comments and strings.
    """
    kind, width = partition(standard)["head"], F.expr("1")
    width = partition(standard)["tail"].try_cast("int")
    lines = F.filter(F.split(F.replace(code, F.lit("\r\n"), F.lit("\n")), "\n"), lambda s: strip(s) != "")
    leads = F.transform(lines, lambda s: F.regexp_extract(s, UNICODE + r"^\s*", 0))
    spaces = _none(leads, lambda w: F.contains(w, F.lit("\t")) | (F.try_mod(F.length(w), width) != 0))
    tabs = _none(leads, lambda w: F.contains(w, F.lit(" ")))
    lead = F.when((kind == "spaces") & (width > 0), spaces).when(kind == "tabs", tabs).otherwise(False)

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | code.rlike(UNICODE + p)
        return out

    tight = any_of([rf"\b\w+{op}\w+\b" for op in OPERATORS] + [r",\S"])
    loose = any_of([rf"\b\w+\s+{op}\s+\w+\b" for op in OPERATORS] + [r",\s+\S"])
    return lead & F.when(spacing == "spacing", ~tight).otherwise(~loose)


def fits_convention(name: Column, convention: Column) -> Column:
    out = F.lit(False)
    for kind, pattern in CONVENTIONS.items():
        out = F.when(convention == kind, name.rlike(pattern)).otherwise(out)
    return out


def variables(words: Column, classes: Column, functions: Column) -> Column:
    """Names that count as variables: of five letters or more, no constants, no leading underscore."""
    free = F.array_except(F.array_distinct(words), F.concat(classes, functions))
    return F.filter(free, lambda w: ~w.startswith("_") & ~w.rlike("^[A-Z0-9_]+$") & (F.length(w) >= 5))


def naming(classes: Column, functions: Column, words: Column, standard: Column) -> Column:
    """standard: class:A,function:B,variable:C; a kind that it leaves out passes."""
    wanted = naming_map(standard)

    def kind(name: str, found: Column) -> Column:
        rule = wanted[name]
        return F.when(F.coalesce(rule, F.lit("")) == "", True).otherwise(F.forall(found, lambda w: fits_convention(w, rule)))

    return kind("class", classes) & kind("function", functions) & kind("variable", variables(words, classes, functions))


def block_comment(code: Column) -> Column:
    """Whether a comment on lines of its own stands directly above a line of code."""
    above = r"(?m)^[ \t]*(?:(?>/\*[\s\S]*?\*/)[^\n]*|(?://|#)[^\n]*)\n[ \t]*(?:[^\s/#]|/(?:[^/*\n]|$))"
    return code.rlike(above)


def godoc(code: Column) -> Column:
    """Every top-level func, type, var and const has a // comment above that begins with its name."""
    lines = F.transform(F.split(code, "\n"), strip)

    def bad(x: Column) -> Column:
        name = F.regexp_extract(x["s"], r"^(?:func|type|var|const)\s+(\w+)", 1)
        before = F.coalesce(F.get(lines, x["i"] - 1), F.lit(""))
        said = strip(F.regexp_replace(before, "^/+", ""))
        return (name != "") & ~(before.startswith("//") & said.startswith(name))

    return _none(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), bad)


def _blocks(code: Column) -> Column:
    return F.regexp_extract_all(strip_strings(code), F.lit(r"(?s)/\*.*?\*/"), F.lit(0))


def javadoc(code: Column) -> Column:
    """Java and Kotlin: there is a doc comment, and none has @return without @param."""
    docs = F.filter(_blocks(code), lambda b: b.startswith("/**"))
    return (F.size(docs) > 0) & _none(docs, lambda d: F.contains(d, F.lit("@return")) & ~F.contains(d, F.lit("@param")))


def rustdoc(code: Column) -> Column:
    """There is a /// comment and no comment of another kind."""
    bare = strip_strings(code)
    other = bare.rlike(r"(?m)(^|[^/:])//($|[^/!])") | bare.rlike(r"/\*")
    return bare.rlike(r"(?m)^\s*///") & ~other


def _comment_kinds(code: Column, language: Column) -> tuple[Column, Column]:
    bare = strip_strings(code)
    hashed = F.lower(language).isin("python", "ruby", "shell", "julia")
    single = F.when(hashed, bare.rlike(r"#")).otherwise(F.regexp_replace(bare, r"(?s)/\*.*?\*/", "").rlike("//"))
    return single, F.when(hashed, F.lit(False)).otherwise(bare.rlike(r"/\*"))


def comment_style(code: Column, language: Column, style: Column, documented: Column) -> Column:
    """Nine styles. documented: whether each Python definition has a docstring (see code_facts)."""
    single, multi = _comment_kinds(code, language)
    mark = F.when(F.lower(language).isin("python", "ruby", "shell", "julia"), "#").otherwise("//")
    lines = F.transform(F.split(strip_strings(code), "\n"), strip)
    inline = _none(lines, lambda s: s.startswith(mark) | s.startswith("/*"))
    kind = F.lower(style)
    return (
        F.when(kind == "single-line comment", single & ~multi)
        .when(kind == "multi-line comment", multi & ~single)
        .when(kind == "inline comment", inline)
        .when(kind == "block comment", block_comment(code))
        .when(kind == "python docstring", documented)
        .when(kind.isin("javadoc", "kotlindoc"), javadoc(code))
        .when(kind == "godoc", godoc(code))
        .when(kind == "rustdoc", rustdoc(code))
        .otherwise(False)
    )


def check_braces(code: Column, answer: Column, bare: Column | None = None) -> Column:
    """answer: language;style. bare: the code without comments, where the lexer has found it."""
    parts = F.split(answer, ";")
    bare = strip_common_comments(code, parts[0]) if bare is None else bare
    return F.coalesce(brace_style(bare, F.try_element_at(parts, F.lit(2))), F.lit(False))


def check_indentation(code: Column, answer: Column, blank: Column | None = None) -> Column:
    """answer: language;spaces:n or tabs;spacing. blank: the code without comments and literals, where the lexer has found it."""
    parts = F.split(answer, ";")
    blank = strip_strings(strip_common_comments(code, parts[0])) if blank is None else blank
    return F.coalesce(indentation(blank, F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))), F.lit(False))
