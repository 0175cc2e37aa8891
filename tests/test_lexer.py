"""The scan against code that is put together from known pieces, and its cost on long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillwork.functions import lexer as X
from quillwork.functions import text as T

CODE = ["x = 1", "f(a, b)", "\n", " + ", "{ y }", "a < b", "; ", "return", "(z)"]
PIECES = {
    "python": (["# a 'b' \"c\"\n"], ["'a#b'", '"it\'s # so"', '"""keep # this\n"and" this"""', "'''a\n'b' # c'''", r"r'\'#'", 'f"{x} # y"', 'b"\\\\"', r"'\'#'"]),
    "java": (["// a \"b\n", "/* a // \" ' b\n*/", "/** @param a */"], ['"// no"', "'\"'", r"'\''", '"""\n text /* no */ "quoted" \n"""', r'"\\"', r"'\u0041'"]),
    "javascript": (["// `a\n", "/* ' */"], ['"//"', "'/*'", r"'\''", "`a // b\n 'c'`", r"`\`#`"]),
    "cpp": (["// R\"(\n", "/* \" */"], ['R"(no // \\ " end)"', 'R"x(a)" b)x"', 'u8"//"', r"'\"'", r"'\\'", 'L"/*"']),
    "rust": (["// 'a\n", "/* a /* b \" */ c */", "/// doc\n"], ['r#"a " // b"#', 'r"\\"', 'b"//"', "'\"'", r"'\''", r"'\u{1F600}'", '"two\nlines // no"']),
    "go": (["// a `\n", "/* \" */"], ["`a // \" \\`", '"/*"', r"'\''", "'\"'"]),
    "kotlin": (["/* a /* b */ c */", "// \"\n"], ['"""a " // b\n"""', '"//"', "'\"'"]),
    "csharp": (["// \"\n", "/* @\" */"], ['@"a\\"', '@"a ""// b"" c"', '$"//"', r"'\''"]),
    "haskell": (["-- \"a\n", "{- a {- b -} \" -}"], ['"-- no"', "'\"'", r"'\''"]),
    "lua": (["-- a \"\n", "--[==[ a ]] b\n]==]", "--[[ ' ]]"], ["[[ -- no ]]", "[=[ a ]] b ]=]", "'--'", r'"\""']),
    "sql": (["-- it's\n", "/* ' */"], ["'it''s -- no'", '"a ""b"""', "'/*'"]),
    "julia": (["# \"\n", "#= a #= b =# ' =#"], ['"""a # "b" """', '"#"']),
}


@pytest.mark.parametrize("language", list(PIECES))
def test_known_pieces(spark, language):
    rng = random.Random(language)
    comments, literals = PIECES[language]
    rows = []
    for _ in range(300):
        parts = [(rng.choice(pool), kind) for pool, kind in rng.choices([(CODE, "code"), (comments, "comment"), (literals, "string")], k=rng.randint(1, 14))]
        pieces = []
        for p, kind in parts:
            line = kind == "comment" and p.endswith("\n")  # its end isn't part of it
            pieces += [(p[:-1] if line else p, kind), ("\n ; " if line else " ; ", "code")]
        rows.append((len(rows), *("".join(p for p, kind in pieces if kind in kinds) for kinds in (("code", "comment", "string"), ("code", "string"), ("code",), ("code", "comment")))))
    df = spark.createDataFrame(rows, "i int, code string, bare string, blank string, commented string")
    lexed, name = X.lexed(F.col("code"), F.lit(language)), F.lit(language)
    got = df.select("*", lexed["bare"].alias("b"), lexed["blank"].alias("k"), T.strip_strings(F.col("code"), name).alias("s"), T.strip_comments(F.col("code"), name).alias("c"))
    for r in got.collect():
        assert (r["b"], r["k"], r["s"], r["c"]) == (r["bare"], r["blank"], r["commented"], r["bare"]), r["code"]


@pytest.mark.parametrize(
    "language, code, blank",
    [
        ("rust", "fn f<'a>(x: &'a str, y: char) { g('b', 'static) }", "fn f<'a>(x: &'a str, y: char) { g(, 'static) }"),
        ("javascript", "a = b / c / d; e = /[/'\"]\\/x/g.test(f) // g", "a = b / c / d; e = .test(f) "),
        ("javascript", "return /a'b/; x = (1) / 2 / '3'", "return ; x = (1) / 2 / "),
        ("js", "`a ${f({b: '}'}, `c ${d}`)} e` + g", "f({b: }, d) + g"),
        ("kotlin", '"a ${f("b")} c" + d', 'f() + d'),
        ("cpp", "int n = 1'000'000; char c = 'x';", "int n = 1'000'000; char c = ;"),
        ("haskell", "f' x = x --> y\ng = 'a' -- z", "f' x = x --> y\ng =  "),
        ("java", 'String s = "open // x\nint b; /* never ended', "String s = \nint b; "),
        ("shell", 'echo $# \'#\' "#" \\# # x', "echo $#   \\# "),
        ("klingon", 'a "b" /* c */', "a  "),
        (None, "a // b", "a "),
    ],
)
def test_single_cases(language, code, blank):
    got = X.without(code, X.tokens(code, language), X.COMMENT, X.STRING)
    assert got == blank


def test_odd_values(spark):
    df = spark.createDataFrame([(1, None, "java"), (2, "", "java"), (3, "a // b", None), (4, "漢 // 字 \U0001f600\n'ü'", "javascript")], "i int, code string, language string")
    rows = df.select("i", X.lexed(F.col("code"), F.col("language")).alias("x")).orderBy("i").collect()
    assert rows[0]["x"] is None and rows[1]["x"]["bare"] == "" and rows[2]["x"]["bare"] == "a " and rows[3]["x"]["blank"] == "漢 \n"
    assert [tuple(t) for t in rows[3]["x"]["tokens"]] == [("comment", 2, 8), ("string", 9, 12)]


@pytest.mark.parametrize("language", [*X.LANGUAGES, "klingon"])
def test_linear_in_long_texts(language):
    """One start after another, with no ends, nested or escaped: a quadratic scan would take minutes."""
    for piece in ("/*", '"', "'", "/", "`${", "{-", '"\\', "#=", "--[==[", 'R"x(', "r#\"", "'a ", "/ /* */ ", " "):
        begun = time.monotonic()
        X.tokens(piece * (250_000 // len(piece)), language)
        assert time.monotonic() - begun < 5, piece
