import pytest
from pyspark.sql import functions as F

from quillwork.functions import text as T


@pytest.fixture
def apply(spark):
    def run(function, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_extract_code(apply):
    given = ["x = 1\n", "```\na\n```", "```python\na\n```", "```c++\na\n```", "``````", "```a\n1\n```\n```b\n2\n```", "```js\nopen", "  y  ", None]
    assert apply(T.extract_code, *given) == ["x = 1", "a", "a", "++\na", "", "1", "```js\nopen", "y", None]


def test_tagged_pair(apply):
    given = ["<prompt>a\nb</prompt>..<answer> c </answer>", "<prompt>a</prompt>", "<answer>a</answer>", ""]
    assert [tuple(x) for x in apply(T.tagged_pair, *given)] == [("a\nb", "c"), ("", ""), ("", ""), ("", "")]


def test_json(apply):
    assert apply(T.clean_json, '```json\n{"a": 1}\n```', '{"a": 1}', 'x ```json\n1\n```') == ['{"a": 1}', '{"a": 1}', "x ```json\n1\n```"]
    assert [len(x) for x in apply(T.parse_tests, '{"tests": [{"name": "a"}]}', "no", "[]", None)] == [1, 0, 0, 0]
    got = apply(T.parse_verdict, '{"meets_requirements": true}', "none", 'a {"confidence": 1} b', "{broken")
    assert [(x["meets_requirements"], x["confidence"]) for x in got] == [(True, 0.5), (False, 0.0), (False, 1.0), (False, 0.0)]
    with pytest.raises(ValueError):
        T.passes(F.lit(None), 1.5)


def test_answers(apply):
    assert apply(T.answer_language, "Python;f", " Java ", ";x", "", None) == ["Python", "Java", None, None, None]
    assert apply(lambda c: T.split_answer(c, 3), "a;b;c;d;e") == [["a", "b", "c", "d;e"]]
    assert apply(T.bracket_list, "[a, b]", "a") == [["a", " b"], ["a"]]
    assert apply(T.quoted_list, "['a', 'b']", "x") == [["a", "b"], None]
    assert apply(T.level_check, "java;List;", "java;List;5", "java;List;['a']") == ["type", "size", "operation"]
    assert apply(T.last_segment, "a.b.c", "A::b", "c") == ["c", "b", "c"]


def test_predicates(apply):
    assert apply(T.says_yes, "YES", "no, yes", "no") == [True, True, False]
    assert apply(T.is_error, "An Exception", "fine") == [True, False]
    assert apply(T.rouge_tokens, "A b-C é1", None) == [["a", "b", "c", "1"], []]
    assert apply(lambda c: T.same_json(c, F.lit('{"a":[1,2]}')), '{ "a": [1, 2] }', "{}") == [True, False]


def test_comments_and_strings(apply):
    assert apply(lambda c: T.strip_comments(c, F.lit("python")), "a = '#x' # y\nb") == ["a = '#x' \nb"]
    assert apply(lambda c: T.strip_comments(c, F.lit("java")), 'a = "//x"; // y\n/* z\n */b') == ['a = "//x"; \nb']
    assert apply(T.strip_strings, "a = 'x' + \"y\" + '''z\nz'''") == ["a =  +  + "]


def test_long_literals_and_comments(spark):
    """A megabyte inside one literal, escapes included, takes no recursion."""
    df = spark.range(1)
    long = [F.concat(F.lit('x = "'), F.repeat(F.lit(part), 500_000), F.lit('" + y # gone')) for part in ("ab", '\\"')]
    for code in long:
        got = df.select(F.length(T.strip_strings(code)), F.length(T.strip_comments(code, F.lit("python"))), F.length(code)).first()
        assert got[0] == len("x =  + y # gone") and got[1] == got[2] - len("# gone")
