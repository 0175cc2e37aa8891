"""Comments and literals of source code, told apart by one pass with a table of states per language.

A rule says how a comment or literal starts and how it ends, what is passed over inside, whether
it nests, and whether code may stand in it again (a hole, as in template strings). The scan
looks for the next start and then for that rule's end, so it is linear in the text and takes no
recursion, however deep things are nested. What has no end goes on to the end of the text, or of
the line for literals of one line.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENT, STRING, REGEX, CODE = "comment", "string", "regex", "code"


class Rule(NamedTuple):
    kind: str
    start: str
    #: A pattern; empty where the start is the whole of it. In text, "\\1" is the start's first group.
    stop: str = ""
    skip: str = ""
    nests: bool = False
    hole: str = ""


LINE = r"(?=\n)"
ESCAPE = r"\\[\s\S]"
SLASHES = [Rule(COMMENT, "//", LINE), Rule(COMMENT, r"/\*", r"\*/")]
NESTED = [Rule(COMMENT, "//", LINE), Rule(COMMENT, r"/\*", r"\*/", nests=True)]
DOUBLE, SINGLE = Rule(STRING, '"', rf'"|{LINE}', ESCAPE), Rule(STRING, "'", rf"'|{LINE}", ESCAPE)
#: A character between quotes; a quote that isn't one of these is left as code.
CHARACTER = Rule(STRING, r"'(?:\\(?:u\{[^}\n]{0,8}\}|x[0-9A-Fa-f]+|[0-9]+|[^\n])[^'\n]{0,8}|[^\\'\n])'")
TEXT_BLOCK = Rule(STRING, '"""', '"""', ESCAPE)
RAW_BLOCK = Rule(STRING, '"""', '"""+')
PREFIX = r"(?<![\w])(?:[rRbBfFuUtT]{1,2})?"
PYTHON = [Rule(COMMENT, "#", LINE), *(Rule(STRING, PREFIX + q * 3, q * 3, ESCAPE) for q in "\"'"), *(Rule(STRING, PREFIX + q, rf"{q}|{LINE}", ESCAPE) for q in "\"'")]
TEMPLATE = Rule(STRING, "`", "`", ESCAPE, hole=r"\$\{")
SCRIPT = [*SLASHES, DOUBLE, SINGLE, TEMPLATE, Rule(REGEX, "/", rf"/[a-z]*|{LINE}", rf"{ESCAPE}|\[(?:\\.|[^\]\\\n])*\]")]

LANGUAGES: dict[str, list[Rule]] = {
    "python": PYTHON,
    "java": [*SLASHES, TEXT_BLOCK, DOUBLE, CHARACTER],
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "c": [*SLASHES, Rule(STRING, r'(?:\b(?:u8|[uUL]))?"', rf'"|{LINE}', ESCAPE), CHARACTER],
    "cpp": [*SLASHES, Rule(STRING, r'\b(?:u8|[uUL])?R"([^()\\\s]{0,16})\(', r')\1"'), Rule(STRING, r'(?:\b(?:u8|[uUL]))?"', rf'"|{LINE}', ESCAPE), CHARACTER],
    "rust": [*NESTED, Rule(STRING, r'\b[bc]?r(#{0,255})"', r'"\1'), Rule(STRING, r'(?:\b[bc])?"', '"', ESCAPE), Rule(STRING, r"(?:\bb)?" + CHARACTER.start)],
    "go": [*SLASHES, DOUBLE, Rule(STRING, "`", "`"), CHARACTER],
    "kotlin": [*NESTED, RAW_BLOCK._replace(hole=r"\$\{"), DOUBLE._replace(hole=r"\$\{"), CHARACTER],
    "csharp": [*SLASHES, RAW_BLOCK, Rule(STRING, r'(?:\$@|@\$?)"', '"', '""'), Rule(STRING, r'\$?"', rf'"|{LINE}', ESCAPE), CHARACTER],
    "haskell": [Rule(COMMENT, r"--+(?![!#$%&*+./<=>?@\\^|~:])", LINE), Rule(COMMENT, r"\{-", r"-\}", nests=True), DOUBLE, Rule(STRING, r"(?<![\w'])" + CHARACTER.start)],
    "lua": [Rule(COMMENT, r"--\[(=*)\[", r"]\1]"), Rule(COMMENT, "--", LINE), Rule(STRING, r"\[(=*)\[", r"]\1]"), DOUBLE, SINGLE],
    "sql": [Rule(COMMENT, "--", LINE), Rule(COMMENT, r"/\*", r"\*/"), Rule(STRING, "'", "'", "''"), Rule(STRING, '"', '"', '""')],
    "ruby": [Rule(COMMENT, r"(?m:^)=begin\b", r"\n=end\b[^\n]*"), Rule(COMMENT, "#", LINE), Rule(STRING, '"', '"', ESCAPE, hole=r"#\{"), Rule(STRING, "'", "'", ESCAPE)],
    "shell": [Rule(COMMENT, r"(?<![^\s;|&(])#", LINE), Rule(CODE, ESCAPE), Rule(STRING, '"', '"', ESCAPE), Rule(STRING, "'", "'")],
    "julia": [Rule(COMMENT, "#=", "=#", nests=True), Rule(COMMENT, "#", LINE), TEXT_BLOCK, Rule(STRING, '"', '"', ESCAPE), Rule(STRING, r"(?<![\w')\]])" + CHARACTER.start)],
    "coffeescript": [Rule(COMMENT, "###(?!#)", "###"), Rule(COMMENT, "#", LINE), *(Rule(STRING, q * 3, q * 3, ESCAPE) for q in "\"'"), Rule(STRING, '"', '"', ESCAPE, hole=r"#\{"), Rule(STRING, "'", "'", ESCAPE)],
}
OTHER = [*SLASHES, TEXT_BLOCK, DOUBLE, SINGLE, Rule(STRING, "`", "`")]
SAME = {"c++": "cpp", "c#": "csharp", "js": "javascript", "ts": "typescript", "bash": "shell", "sh": "shell", "py": "python", "golang": "go"}
#: Words of JavaScript after which a slash starts a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of new delete void throw do else instanceof yield await".split())
WORD_END = re.compile(r"[\w$]{1,16}$")

TOKEN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
LEXED = T.StructType([T.StructField("bare", T.StringType()), T.StructField("blank", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN))])
_ARROW = pa.struct([("bare", pa.string()), ("blank", pa.string()), ("tokens", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))])


class _Table:
    """The compiled rules of a language."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        starts = "|".join(f"(?P<r{i}>{r.start})" for i, r in enumerate(rules))
        self.starts, self.starts_in_hole = re.compile(starts), re.compile(rf"{starts}|(?P<open>\{{)|(?P<close>\}})")
        self.inner = [None if not r.stop or r"\1" in r.stop else self._inside(r) for r in rules]

    @staticmethod
    def _inside(rule: Rule) -> re.Pattern[str]:
        ways = [("skip", rule.skip), ("hole", rule.hole), ("stop", rule.stop), ("nest", rule.start if rule.nests else "")]
        return re.compile("|".join(f"(?P<{name}>{p})" for name, p in ways if p))


@cache
def _table(language: str) -> _Table:
    return _Table(LANGUAGES.get(language, OTHER))


def tokens(code: str, language: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of comments and literals in order; what stands in holes is code."""
    name = (language or "").strip().lower()
    name = SAME.get(name, name)
    table = _table(name if name in LANGUAGES else "")
    out: list[tuple[str, int, int]] = []
    holes: list[list[int]] = []  # rule of the literal, braces open in the hole
    at, end = 0, len(code)
    value_before = _ValueBefore(code, out)
    while at < end:
        m = (table.starts_in_hole if holes else table.starts).search(code, at)
        if not m:
            break
        at = m.end()
        if m.lastgroup == "open":
            holes[-1][1] += 1
            continue
        if m.lastgroup == "close":
            if holes[-1][1]:
                holes[-1][1] -= 1
                continue
            rule, start = holes.pop()[0], m.start()
        else:
            rule, start = next(i for i, _ in enumerate(table.rules) if m.group(f"r{i}") is not None), m.start()
        kind = table.rules[rule].kind
        if kind == CODE or kind == REGEX and value_before(start):
            continue
        at, in_hole = _stop(code, at, table, rule, m)
        out.append((STRING if kind == REGEX else kind, start, at))
        if in_hole:
            holes.append([rule, 0])
    return out


def _stop(code: str, at: int, table: _Table, rule: int, start: re.Match[str]) -> tuple[int, bool]:
    """Where a comment or literal ends, and whether a hole starts there."""
    stop, inner, depth = table.rules[rule].stop, table.inner[rule], 1
    if not stop:
        return at, False
    if inner is None:
        group = next(g for g in start.groups()[start.re.groupindex[f"r{rule}"] :] if g is not None)
        closer = stop.replace(r"\1", group)
        found = code.find(closer, at)
        return (found + len(closer) if found >= 0 else len(code)), False
    while m := inner.search(code, at):
        at = m.end()
        if m.lastgroup == "hole":
            return at, True
        depth += (m.lastgroup == "nest") - (m.lastgroup == "stop")
        if not depth:
            return at, False
    return len(code), False


class _ValueBefore:
    """Whether a value stands before a position, so that a slash there divides."""

    def __init__(self, code: str, before: list[tuple[str, int, int]]):
        self.code, self.before = code, before

    def __call__(self, at: int) -> bool:
        k = len(self.before) - 1
        while at:
            if k >= 0 and self.before[k][2] == at:
                if self.before[k][0] != COMMENT:
                    return True
                at, k = self.before[k][1], k - 1
            elif self.code[at - 1].isspace():
                at -= 1
            else:
                break
        if not at:
            return False
        if word := WORD_END.search(self.code, max(0, at - 16), at):
            return word.group() not in BEFORE_REGEX
        return self.code[at - 1] in ")]}"


def without(code: str, spans: list[tuple[str, int, int]], *kinds: str) -> str:
    out, at = [], 0
    for kind, start, stop in spans:
        if kind in kinds:
            out.append(code[at:start])
            at = stop
    return "".join([*out, code[at:]])


@F.arrow_udf(LEXED)
def lexed(code: pa.Array, language: pa.Array) -> pa.Array:
    """bare: code without comments; blank: without literals too; tokens: the spans of both. Null without code."""
    out = []
    for c, name in zip(code.to_pylist(), language.to_pylist(), strict=True):
        if c is None:
            out.append(None)
            continue
        spans = tokens(c, name)
        out.append({"bare": without(c, spans, COMMENT), "blank": without(c, spans, COMMENT, STRING), "tokens": [dict(zip(("kind", "start", "stop"), s)) for s in spans]})
    return pa.array(out, _ARROW)


@F.arrow_udf(T.StringType())
def _without_literals(code: pa.Array, language: pa.Array) -> pa.Array:
    both = zip(code.to_pylist(), language.to_pylist(), strict=True)
    return pa.array([None if c is None else without(c, tokens(c, name), STRING) for c, name in both], pa.string())


def strip_comments(code: Column, language: Column) -> Column:
    return lexed(code, language.cast("string"))["bare"]


def strip_strings(code: Column, language: Column) -> Column:
    """code without its literals; comments stay."""
    return _without_literals(code, language.cast("string"))
