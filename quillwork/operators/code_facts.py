"""Facts about code, from which the constraint checks are built as expressions.

Python is read by its own parser in one Arrow UDF; it gives one struct per text, and the checks
above it stay in the JVM. Other languages are read by patterns over text without comments, which
is an approximation: nested generics in signatures and calls in macros can escape them.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LISTS = ["calls", "imports", "heads", "structures", "kinds", "classes", "functions", "words"]
_SIGNATURE = T.StructType([T.StructField("name", T.StringType()), T.StructField("parameters", T.ArrayType(T.StringType())), T.StructField("returns", T.StringType())])
FACTS = T.StructType(
    [T.StructField("parsed", T.BooleanType()), T.StructField("error", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
    + [T.StructField("documented", T.BooleanType()), T.StructField("in_version", T.BooleanType()), T.StructField("signatures", T.ArrayType(_SIGNATURE))]
)
#: Calls that make a structure.
BUILT_IN = {"list", "dict", "set", "tuple", "heapq"}
LIBRARY = {"collections.deque", "collections.defaultdict", "collections.OrderedDict", "collections.Counter", "queue.Queue"}
NOT_CALLS = ["if", "for", "while", "switch", "return", "catch", "match", "fn", "func", "function", "def", "new"]


def _structures(nodes: list[ast.AST]) -> set[str]:
    names = {a.asname or a.name: a.name for n in nodes if isinstance(n, ast.Import) for a in n.names if a.name == "collections"}
    out = {f"collections.{a.name}" for n in nodes if isinstance(n, ast.ImportFrom) and n.module == "collections" for a in n.names}
    for call in (n.func for n in nodes if isinstance(n, ast.Call)):
        if isinstance(call, ast.Name) and call.id in BUILT_IN:
            out.add(call.id)
        elif isinstance(call, ast.Attribute) and isinstance(call.value, ast.Name):
            whole = f"{names.get(call.value.id, call.value.id)}.{call.attr}"
            out |= {whole} & LIBRARY
    return out


def _in_version(code: str | None, version: str | None) -> bool | None:
    """Whether the code fits the grammar of a Python version; null if none is asked for or it has none."""
    minor = re.fullmatch(r"3\.(\d+)", version or "")
    if not minor:
        return None
    try:
        ast.parse(code or "", feature_version=(3, int(minor[1])))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _facts(code: str | None) -> dict:
    try:
        nodes = list(ast.walk(ast.parse(code or "")))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return {"parsed": False, "error": str(error), "documented": False}
    defined = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    called = [n.func for n in nodes if isinstance(n, ast.Call)]
    return {
        "parsed": True,
        "calls": sorted({f.id if isinstance(f, ast.Name) else f.attr for f in called if isinstance(f, (ast.Name, ast.Attribute))}),
        "imports": sorted({a.name for n in nodes if isinstance(n, ast.Import) for a in n.names}),
        "heads": sorted({n.module.split(".")[0] for n in nodes if isinstance(n, ast.ImportFrom) and n.module}),
        "structures": sorted(_structures(nodes)),
        "kinds": sorted({type(n).__name__ for n in nodes}),
        "classes": sorted({n.name for n in classes}),
        "functions": sorted({n.name for n in defined}),
        "words": sorted({n.id for n in nodes if isinstance(n, ast.Name)} | {n.arg for n in nodes if isinstance(n, ast.arg)}),
        "documented": all(ast.get_docstring(n) for n in [*defined, *classes]),
        "signatures": [
            {
                "name": n.name,
                "parameters": [ast.unparse(a.annotation) if a.annotation else "None" for a in n.args.args],
                "returns": ast.unparse(n.returns) if n.returns else None,
            }
            for n in defined
            if isinstance(n, ast.FunctionDef)
        ],
    }


_STRINGS = pa.list_(pa.string())
_ARROW = pa.struct(
    [("parsed", pa.bool_()), ("error", pa.string()), *[(c, _STRINGS) for c in _LISTS], ("documented", pa.bool_()), ("in_version", pa.bool_())]
    + [("signatures", pa.list_(pa.struct([("name", pa.string()), ("parameters", _STRINGS), ("returns", pa.string())])))]
)


@F.arrow_udf(FACTS)
def python_facts(code: pa.Array, version: pa.Array) -> pa.Array:
    """Facts of Python code, null without code; in_version is for the version asked for, if any."""
    both = zip(code.to_pylist(), version.to_pylist(), strict=True)
    return pa.array([None if c is None else _facts(c) | {"in_version": _in_version(c, v)} for c, v in both], _ARROW)


def calls(code: Column) -> Column:
    """Names before an opening parenthesis that aren't being defined there."""
    found = F.regexp_extract_all(code, F.lit(r"(?<!\bfn )(?<!\bfunc )(?<!\bfunction )(?<![\w\]] )(?<!(?<![=-])> )\b(\w+)\s*(?:::<[^>()]*>\s*)?\("), F.lit(1))
    after_keyword = F.regexp_extract_all(code, F.lit(r"\b(?:return|await|else|throw|yield|new|in|case|go|defer)\s+(?:\w+(?:\.|::)){0,32}(\w+)\s*\("), F.lit(1))
    return F.filter(F.array_union(found, after_keyword), lambda n: ~n.isin(NOT_CALLS))


def words(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))


#: Words before a name that make it no type there.
NOT_TYPED = ["return", "else", "case", "throw", "goto", "delete", "in", "is", "as", "if", "let", "mut", "var", "val", "package", "import", "using", "namespace", "yield", "await", "go", "defer", "range", "move"]


def type_names(blank: Column, language: Column) -> Column:
    """Names in the position of a type, in code without comments and literals: before a variable or
    parameter of that type, before or inside of type arguments, after new, in a definition, and,
    by language, after a colon, an arrow or a parameter's name. By patterns, so an approximation."""

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(blank, F.lit(pattern), F.lit(1))

    declared = r"\b([A-Za-z_]\w*)(?:<[^;{}()=]*?>)?(?:\[\w*\])*(?:\s*[&*]+\s*|\s+)[A-Za-z_]\w*(?:\[\w*\])*\s*(?=[=;,){(:]|$)"
    generic = r"\b([A-Za-z_]\w*)<(?![=<])"
    argument = r"(?<=[\w>\]]<|,|, |<)(?:const\s+)?(?:\w+::)*([A-Za-z_]\w*)(?=\s*[*&]*\s*(?:>|<|,[^;(){}=]*>))"
    defined = r"\b(?:class|struct|enum|interface|record|union|trait|type|impl|typename|new|extends|implements|throws|instanceof)\s+(?:\w+(?:::|\.))*([A-Za-z_]\w*)"
    colon = r"(?::(?!:)|->|\b(?:for|as|dyn|impl))\s*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+|dyn\s+|impl\s+)*(?:\w+::)*([A-Za-z_]\w*)"
    go = r"(?:\]|\*|&|\bchan\s+|\bmake\(|\bnew\()\s*(?:\w+\.)?([A-Za-z_]\w*)"
    go_named = r"\b[A-Za-z_]\w*\s+\*?(?:\w+\.)?([A-Za-z_]\w*)\s*(?=[,)=\n]|$)"
    go_literal = r"(?:=|return|,|\()\s*&?(?:\w+\.)?([A-Za-z_]\w*)\{"
    common = F.concat(found(generic), found(argument), found(defined))
    written = F.concat(common, F.filter(found(declared), lambda n: ~n.isin(NOT_TYPED)))
    kind = F.lower(language)
    names = F.when(kind == "rust", F.concat(common, found(colon))).when(kind == "go", F.concat(found(defined), found(go), found(go_named), found(go_literal))).otherwise(written)
    return F.array_distinct(names)


def import_paths(code: Column, language: Column) -> Column:
    """Text of each import: the quoted path, or a whole use declaration in Rust. What follows an
    import word is read up to the next one at most, so repeated words cost no more than others."""
    quoted = r"(?:\bimport\b(?:(?!\bimport\b)[^;'\"`])*+|\brequire\s*\(\s*+)['\"]([^'\"\n]+)['\"]"
    blocks = F.array_join(F.regexp_extract_all(code, F.lit(r"\bimport\s*+(?:\w++\s*+)?(?:\((?:(?!\bimport\b)[^)])*+\)|\"[^\"\n]*+\")"), F.lit(0)), "\n")
    go = F.regexp_extract_all(blocks, F.lit("\"([^\"]*)\""), F.lit(1))
    rust = F.regexp_extract_all(code, F.lit(r"\b(?:use|extern\s+crate)\s(?:(?!\b(?:use|extern)\b)[^;])*+;"), F.lit(0))
    kind = F.lower(language)
    return F.when(kind == "go", go).when(kind == "rust", rust).otherwise(F.regexp_extract_all(code, F.lit(quoted), F.lit(1)))


def _top_level(text: Column) -> Column:
    """Parts between commas that no bracket encloses."""
    inner = text
    for _ in range(3):  # commas up to three brackets deep are put aside
        inner = F.regexp_replace(inner, r"([<(\[][^<>()\[\],]*),", "$1\u0001")
    return F.transform(F.split(inner, ","), lambda s: F.trim(F.translate(s, "\u0001", ",")))


#: Patterns that speak for a language; the one with most of them in the code is the guess.
SIGNS = {
    "python": [r"(?m)^\s*def \w+\(.*\)[^{;]*:", r"(?m)^\s*(?:from \S+ )?import \w[\w., ]*$", r"\bself\b", r"(?m)^\s*(?:elif|except|with|class) ?.*:\s*$", r"\bNone\b|\bTrue\b"],
    "java": [r"\bpublic (?:static |final )*+(?:class|void|int|String)\b", r"\bSystem\.out\.", r"\bimport java", r"\bnew \w+(?:<.*>)?\(", r"\bString\b"],
    "javascript": [r"\b(?:const|let|var) \w+ =", r"=>", r"\bconsole\.log\(", r"\bfunction\b", r"===|\brequire\("],
    "typescript": [r"\b(?:const|let) \w+: \w+", r"\binterface \w+ \{", r": (?:string|number|boolean)\b", r"=>", r"\bexport\b"],
    "rust": [r"\bfn \w+", r"\blet mut\b", r"\bimpl\b", r"\buse \w+::", r"\bprintln!|->"],
    "go": [r"(?m)^package \w+", r"\bfunc \w*", r":=", r"\bfmt\.", r"(?m)^import [(\"]"],
    "c++": [r"#include <(?:iostream|vector|string|map)>", r"\bstd::", r"\bcout\b", r"\btemplate\s*<", r"\bnamespace\b"],
    "c": [r"#include <std\w+\.h>", r"\bprintf\(", r"\bint main\(", r"\bmalloc\(", r"\bstruct \w+ \*?\w"],
    "c#": [r"\busing System", r"\bnamespace \w+", r"\bConsole\.Write", r"\bpublic (?:static )?\w+ \w+\(", r"\bstring\b"],
    "kotlin": [r"\bfun \w+\(", r"\bval \w+", r"\bprintln\(", r"\bdata class\b", r"\bwhen\b"],
}


def guess_language(code: Column) -> Column:
    """A guess by keywords, an approximation; null where nothing speaks for any language."""
    scores = [F.struct(sum((code.rlike(p).cast("int") for p in patterns), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, patterns) in enumerate(SIGNS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"])


def _first(text: Column, pattern: Column) -> Column:
    """The first group of a pattern that is put together from columns."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def parameters(code: Column, language: Column, name: Column) -> Column:
    """Types of the parameters of the named function in Java, C++, Rust or Go; null if it isn't there."""
    body = F.lit(r"\s*(?:<[^>]*>)?\s*\(((?:[^()]++|\([^()]*+\))*+)\)")
    head = F.when(F.lower(language) == "rust", r"\bfn\s+").when(F.lower(language) == "go", r"\bfunc\s+(?:\([^)]*\)\s*)?").otherwise(r"(?<![.\w])(?:[\w:<>\[\],&*]+\s+){1,12}[*&]?")
    pattern = F.concat(F.lit("(?s)"), head, name, body)
    found = F.regexp_like(code, pattern)
    inside = _first(code, pattern)
    named = F.filter(_top_level(inside), lambda p: (p != "") & ~p.rlike(r"^(?:&\s*)?(?:mut\s+)?self$"))
    rust = F.transform(named, lambda p: F.trim(F.regexp_replace(p, r"^[^:]*:", "")))
    go = F.transform(named, lambda p: F.trim(F.regexp_replace(p, r"^\w+\s+", "")))
    other = F.transform(named, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\b(?:final|const)\s+", ""), r"\b\w+\s*((?:\[\s*\w*\s*\])*+)$", "$1")))
    return F.when(found, F.when(F.lower(language) == "rust", rust).when(F.lower(language) == "go", go).otherwise(other))


def returned(code: Column, language: Column, name: Column) -> Column:
    """The return type of the named function in Java, C++, Rust or Go, as it is written."""
    inside = r"\s*(?:<[^>]*>)?\s*\((?:[^()]++|\([^()]*+\))*+\)\s*"
    rust = _first(code, F.concat(F.lit(r"(?s)\bfn\s+"), name, F.lit(inside + r"->\s*([^{;]*?)\s*(?:where\b[^{]*)?\{")))
    go = _first(code, F.concat(F.lit(r"(?s)\bfunc\s+(?:\([^)]*\)\s*)?"), name, F.lit(inside + r"([^{]*?)\s*\{")))
    other = _first(code, F.concat(F.lit(r"(?s)([\w:.]+(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\]){0,8})\s*[*&]?\s+[*&]?"), name, F.lit(r"\s*\(")))
    return F.when(F.lower(language) == "rust", rust).when(F.lower(language) == "go", go).otherwise(other)
