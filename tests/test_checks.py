import time

import pytest
from pyspark.sql import functions as F

from quillwork.operators import layout_checks as L
from quillwork.operators.code_checks import check_rows, with_facts

KR = "class A {\n  int f() {\n    return 1;\n  }\n}"
ALLMAN = "class A\n{\n  int f()\n  {\n    return 1;\n  }\n}"
CLAUSES = "if (x) {\n  y();\n}\nelse {\n  z();\n}"


@pytest.mark.parametrize(
    "code, answer, want",
    [
        (KR, "java;K&R", True), (ALLMAN, "java;K&R", False), (ALLMAN, "java;Allman", True), (KR, "java;Allman", False), (CLAUSES, "java;1TBS", False), (CLAUSES, "java;K&R", True),
        (KR, "java;1TBS", True), ("x = 1", "java;Allman", True), (KR, "java;Other", False), (KR, "java", False), ("int[] a = {1};", "java;K&R", False), ("// {\nint a;", "java;Allman", True),
    ],
)
def test_braces(spark, code, answer, want):
    assert spark.range(1).select(L.check_braces(F.lit(code), F.lit(answer))).first()[0] is want


@pytest.mark.parametrize(
    "code, answer, want",
    [
        ("a = 1\n    b = 2\n", "python;spaces:4;spacing", True), ("  a = 1\n", "python;spaces:4;spacing", False), ("\ta = 1\n", "python;tabs;spacing", True), ("\t a = 1\n", "python;tabs;spacing", False),
        ("a=1", "python;spaces:4;spacing", False), ("a=1", "python;spaces:4;none", True), ("f(a, b)", "python;spaces:4;none", False), ("f(a,b)", "python;spaces:4;spacing", False),
        ("f('a,b') # c=d", "python;spaces:4;spacing", True), ("a", "python;dots;spacing", False), ("a", "python;spaces:0;spacing", False), ("a", "python;spaces:x;none", False),
    ],
)
def test_indentation(spark, code, answer, want):
    assert spark.range(1).select(L.check_indentation(F.lit(code), F.lit(answer))).first()[0] is want


def test_conventions(spark):
    cases = {"snake_case": ["a_b1", "A_b"], "PascalCase": ["AbC", "abC"], "camelCase": ["abC", "Ab"], "kebab-case": ["a-b", "a_b"], "none": [None, "a"]}
    for convention, (good, bad) in cases.items():
        fits = spark.range(1).select(L.fits_convention(F.lit(good), F.lit(convention)), L.fits_convention(F.lit(bad), F.lit(convention))).first()
        assert (fits[0] if good else True, fits[1]) == (True, False)


def test_comments(spark):
    block = [("// a\nint x;", True), ("// a\n\nint x;", False), ("/* a\n b */\nint x;", True), ("int x; // a\n", False), ("// a\n// b\nx", True), ("/* a */ x */\n// c\n", False)]
    for code, want in block:
        assert spark.range(1).select(L.block_comment(F.lit(code))).first()[0] is want, code
    go = [("// Run does.\nfunc Run() {}", True), ("func Run() {}", False), ("// other\ntype T struct{}", False), ("x := 1", True)]
    for code, want in go:
        assert spark.range(1).select(L.godoc(F.lit(code))).first()[0] is want, code
    docs = [("/** @param a\n @return b */ int f(){}", True), ("/** @return b */ int f(){}", False), ("int f(){}", False)]
    for code, want in docs:
        assert spark.range(1).select(L.javadoc(F.lit(code))).first()[0] is want, code


PY = 'from collections import deque\nimport os.path\nclass Box:\n    """D."""\n    def get_item(self, names: list[list[int]], key: str) -> tuple[int, dict[str, int]]:\n        """D."""\n        return self.make(deque(names), len(key))\n'


@pytest.mark.parametrize(
    "constraint, answer, want",
    [
        ("function", "python;os.make", True), ("function", "python;get_item", False), ("library", "python;os.path", True), ("library", "python;os", False), ("library", "python;collections", True),
        ("type", "python;collections.deque", True), ("type", "python;list", False), ("input_type", "python;get_item;Matrix", True), ("input_type", "python;get_item;String", True), ("input_type", "python;get_item;Set", False),
        ("output_type", "python;get_item;Tuple", True), ("output_order", "python;get_item;[int,dict]", False), ("input_order", "python;get_item;[None,Matrix,str]", True), ("ast_syntax", "Python", True),
        ("comment_formatting", "python;python docstring", True), ("naming_convention", "python;class:PascalCase,function:snake_case", True), ("naming_convention", "python;class:snake_case", False),
        ("size", "python;collections.deque;5", False), ("operation", "python;collections.deque;['deque','len']", True), ("level", "python;collections.deque;", True), ("odd", "python", False), ("function", "klingon;x", False),
    ],
)
def test_python(spark, constraint, answer, want):
    df = spark.createDataFrame([(constraint, answer, f"Look:\n```python\n{PY}```")], "constraint string, answer string, response string")
    row = check_rows(df).first()
    assert row["is_matched"] is want
    assert (row["error_message"] == "unknown constraint") is (constraint == "odd")


def test_odd_rows(spark):
    rows = [(None, None, None), ("function", None, "x"), ("library", "python;x", None), ("ast_syntax", "python", "def f(:"), ("type", "python", "\x00"), ("input_type", "java;f;List", "")]
    out = check_rows(spark.createDataFrame(rows, "constraint string, answer string, response string")).collect()
    assert len(out) == 6 and not any(r["is_matched"] for r in out)
    assert any(r["error_message"] and "invalid" in r["error_message"] for r in out if r["constraint"] == "ast_syntax")


@pytest.mark.parametrize(
    "constraint, answer, response, want",
    [
        ("language_version", "python;3.10", "match x:\n    case 1:\n        pass", True), ("language_version", "python;3.8", "match x:\n    case 1:\n        pass", False),
        ("language_version", "python;3.8", "x = 1", True), ("language_version", "python;3.9", "x = 1", False), ("language_version", "python;3.13", "x = (", False),
        ("language_version", "rust;1.86.0", "fn f() {}", False), ("language_version", "cobol;85", "x", False), ("language_version", "python", "x = 1", False),
        ("function", "javascript;f", "const g = x => f(x);", True), ("function", "java;f", "xs.map(x -> f(x));", True), ("function", "java;f", "List<A> f(int x) { }", False),
        ("input_type", "java;run;JSONObject", "class A { int run(JSONObject a) { return 1; } }", True), ("input_type", "java;run;JSONObject", "class A { int run(MyJsonObject a) { return 1; } }", False),
        ("input_type", "rust;run;JSONObject", "fn run(a: MyValue) -> u8 { 1 }", False), ("input_type", "rust;run;JSONObject", "fn run(a: serde_json::Value) -> u8 { 1 }", True),
        ("input_type", "rust;run;List", "fn run(a: LinkedList<u8>) -> u8 { 1 }", True),
    ],
)
def test_versions_calls_and_spellings(spark, constraint, answer, response, want):
    df = spark.createDataFrame([(constraint, answer, response)], "constraint string, answer string, response string")
    assert check_rows(df).first()["is_matched"] is want


def test_known_versions_of_compiled_languages_say_what_they_need(spark):
    df = spark.createDataFrame([("language_version", "java;jdk17", "class A {}"), ("language_version", "java;jdk8", "class A {}")], "constraint string, answer string, response string")
    assert sorted((r["answer"], r["is_matched"], r["error_message"]) for r in check_rows(df).collect()) == [("java;jdk17", False, "needs a compiler"), ("java;jdk8", False, None)]


def test_long_code_takes_no_recursion(spark):
    """Runs that patterns repeat a group over: nested brackets, dotted names, words before a name."""
    codes = ["f(" + "(a)" * 30_000 + ")", "return " + "a." * 30_000 + "f(x)", "word " * 30_000 + "f(x)", "int" + "[]" * 30_000 + " f(int" + "[]" * 30_000 + " a) {"]
    rows = [(c, f"{language};f;List", code) for code in codes for language in ("java", "rust") for c in ("input_type", "output_type", "function", "input_order")]
    df = spark.createDataFrame(rows, "constraint string, answer string, response string")
    assert check_rows(df).where("is_matched is not null").count() == len(rows)


LITERALS = [
    ("type", "java;HashMap", 'String s = "HashMap";', False), ("type", "java;HashMap", "int HashMap = 1;", False), ("type", "java;String", "String s = x;", True),
    ("type", "java;ArrayList", "List<String> a = new ArrayList<>();", True), ("type", "java;List", "void f(final List<Map<String, Integer>> a) {}", True), ("type", "java;Integer", "Map<String, Integer> m;", True),
    ("type", "java;HashMap", "HashMap.of(1);", False), ("type", "java;String", "String[] a = b;", True), ("type", "java;List", "// List<String> a;\nint b;", False),
    ("type", "cpp;vector", "const std::vector<int>& a = b;", True), ("type", "cpp;vector", "vector = 1; f(vector);", False), ("type", "cpp;map", 'auto s = R"(std::map<int, int> m;)";', False),
    ("type", "rust;HashMap", "let m: HashMap<u8, u8> = f();", True), ("type", "rust;Vec", "fn f<'a>(x: &'a mut Vec<u8>) -> u8 { 1 }", True), ("type", "rust;Vec", "let vec = 'v'; /* a /* : Vec<u8> */ : Vec<u8> */", False),
    ("type", "rust;Node", "struct Node { a: u8 }", True), ("type", "go;Stack", "type Stack struct { a []int }", True), ("type", "go;Stack", "s := Stack{}", True), ("type", "go;Stack", "x := `type Stack struct {}`", False), ("type", "go;Item", "func f(a []Item, b *Node) {}", True),
    ("operation", "java;List;['add']", 'String s = "List.add(";', False), ("operation", "java;List;['add']", "List<A> a = b; a.add(1);", True), ("size", "java;List;5", 'List<A> a = f("5");', True),
    ("advanced_syntax", "javascript;arrow functions", 'const s = "a => b";', False), ("advanced_syntax", "javascript;arrow functions", "const s = `${xs.map(a => b)}`;", True), ("advanced_syntax", "javascript;spread operator", "f(/.../, 'a...')", False),
    ("function", "java;f", 'String s = "f(x)";', False), ("naming_convention", "java;class:PascalCase", 'class Box { String s = "class small_box {"; }', True),
    ("library", "javascript;react", "import { a,\n b } from 'react';", True), ("library", "javascript;react", "import a from 'x'; const b = 'react';", False), ("library", "go;gin", 'import "github.com/gin"', True), ("library", "rust;serde", "use serde::{A, B};\nuse x;", True),
]


def test_literals_and_positions(spark):
    df = spark.createDataFrame(LITERALS, "constraint string, answer string, response string, want boolean")
    assert [tuple(r) for r in check_rows(df).where("is_matched != want").collect()] == []


def test_repeated_keywords_are_linear(spark):
    rows = [("library", f"{language};x", word * 60_000) for language in ("javascript", "go", "rust") for word in ("import ", "import (", "use ", "extern crate ", "require(", 'import "', "import x ")]
    rows += [("type", f"{language};x", word * 60_000) for language in ("java", "cpp", "rust", "go") for word in ("a<", "a, ", "new ", "a ", "a::", "[a]", "(a*", "const ")]
    df = spark.createDataFrame(rows, "constraint string, answer string, response string")
    begun = time.monotonic()
    assert check_rows(df).where("is_matched is not null").count() == len(rows)
    assert time.monotonic() - begun < 120


def test_rows_of_one_file_are_parsed_on_all_cores(spark):
    rows = [("function", a, f"x = 1  # f({i})\ny = f({i})\n") for i, a in enumerate(["python;f", "python;g", "java;f", None] * 10)]
    df = spark.createDataFrame(rows, "constraint string, answer string, response string").coalesce(1)
    out = check_rows(df)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    shared = check_rows(with_facts(df, answer=None))  # lexed as Python once; other languages on their own
    assert shared.columns == out.columns
    key = lambda r: (r["response"], r["is_matched"])
    assert sorted(map(key, shared.collect())) == sorted(map(key, out.collect()))
