"""Text made of the rows of part, which stands in for code and responses; the tables hold none.

Each row takes the template at p_size modulo their number, with its key put in for @ and its size
for #. The same templates go into the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESPONSES = [
    "Here it is:\n```python\ndef f_@():\n    return #\n```\nDone.",
    "```\nplain @\n```",
    "no fence @ #  ",
    "```c++\nint g_@;\n```",
    "```java\nfirst @\n``` and ```java\nsecond\n```",
    "``````",
]
TAGGED = [
    "<prompt> make @ </prompt> text <answer>Python;\n#</answer>",
    "<prompt>only @</prompt>",
    "<new_prompt>next @</new_prompt><new_answer> Java;# </new_answer>",
    "nothing @",
]
JUDGED = [
    '{"meets_requirements": true, "confidence": 0.9, "reasoning": "fine @", "issues": []}',
    'Sure: {"meets_requirements": true, "confidence": 0.5, "reasoning": "weak @"} end',
    '```json\n{"meets_requirements": false, "issues": ["a", "b"]}\n```',
    "not json @",
    '{"confidence": 0.8}',
    '{"meets_requirements": true, broken',
]
TESTS = [
    '```json\n{"tests": [{"name": "t@", "input": "1", "expected_output": "#"}, {"name": "u", "input": "2", "expected_output": "3"}]}\n```',
    '{"tests": []}',
    "nothing @",
    '{"tests": [{"name": "only @"}]}',
]
ANSWERS = ["Python;f_@;Integer", " Java ", "", "Rust;g;[List,Map];x;#", ";h_@", "go;[a, b]"]
BRACED = [
    "class A@ {\n  int f() {\n    return #;\n  }\n}",
    "class A@\n{\n  int f()\n  {\n    return #;\n  }\n}",
    "if (x) {\n  y = #;\n}\nelse {\n  y = 0;\n}",
    "int x = #;\nint y = @;",
    "int[] a = {1, #};\n",
]
STYLES = ["K&R", "Allman", "1TBS", "other"]
INDENTED = [
    "def f(a, b):\n    x = a + b\n    return x\n",
    "def f(a, b):\n   x = a + b\n   return x\n",
    "def f(a,b):\n\tx=a+b\n\treturn x\n",
    "def f(a, b):\n\tx = a+b\n",
]
LAYOUTS = ["spaces:4;spacing", "tabs;none", "spaces:3;spacing", "tabs;spacing", "dots;spacing"]
NAMES = ["snake_case_@", "PascalCase@", "camelCase@", "kebab-case", "Bad_Name@", "UPPER"]
COMMENTED = [
    "// doc of f\nint f() { return #; }\n",
    "int f() { return #; } // end\n",
    "/* several\n lines */\nint g() { return 1; }\n",
    "// alone\n\nint x = @;\n",
    "/* a */ // b\nx = @\n",
]
GO = [
    "// Run@ starts.\nfunc Run@() {}\n",
    "func Run@() {}\n",
    "package a\n\n// other text\ntype T@ struct {}\n",
    "package a\nx := #\n",
]
PYTHON = [
    "import os\nfrom collections import deque\ndef run_@(items: list[int]) -> dict[str, int]:\n    q = deque(items)\n    return dict(q)\n",
    "import numpy.linalg\nx = sorted(set([#]))\n",
    "from a.b import c\nclass Box@:\n    def get(self, k: str) -> tuple[int, str]:\n        return (k.strip(), #)\n",
    "def broken(:\n",
    "def gen(n: int):\n    \"\"\"Doc.\"\"\"\n    for i in range(n):\n        yield [j for j in list(range(#))]\n",
]
PYTHON_CHECKS = [
    ("function", "python;math.sorted"), ("library", "python;a"), ("library", "python;numpy"), ("type", "Python;Set"),
    ("size", "python;dict;1"), ("advanced_syntax", "python;list comprehension"), ("input_type", "python;get;String"), ("output_type", "python;get;Tuple"),
    ("output_order", "python;get;[int,str]"), ("ast_syntax", "python"), ("operation", "python;list;['range']"), ("unknown", "python;x"),
]


def pick(templates: list[str], shift: int = 0) -> Column:
    at = (F.col("p_size") + shift) % len(templates) + 1
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), at.cast("int"))
    return F.replace(F.replace(text, F.lit("@"), F.col("p_partkey").cast("string")), F.lit("#"), F.col("p_size").cast("string"))


def choose(options: list[str]) -> Column:
    """One of a few options by the row's key, as it is."""
    return F.element_at(F.array(*[F.lit(t) for t in options]), (F.col("p_partkey") % len(options) + 1).cast("int"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(quoted(t) for t in items) + "]"


def pick_sql(templates: list[str], shift: int = 0) -> str:
    return f"replace(replace(({sql_list(templates)})[((p_size + {shift}) % {len(templates)} + 1)::INT], '@', p_partkey::VARCHAR), '#', p_size::VARCHAR)"


def choose_sql(options: list[str]) -> str:
    return f"({sql_list(options)})[(p_partkey % {len(options)} + 1)::INT]"
