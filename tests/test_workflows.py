import pytest
from pyspark.sql import functions as F

from quillwork.operators import toolchain
from quillwork.operators.toolchain import check_compilation
from quillwork.plans import workflows as W


def respond_with(column):
    return lambda df: df.withColumn("response", column).withColumn("error", F.lit(None).cast("string"))


@pytest.fixture
def tables(spark):
    instructions = spark.createDataFrame(
        [("lib", 0, 1, "syntax", "library", "use os", "python;os"), ("lib", 1, 2, "syntax", "library", "use re", "python;re"), ("alg", 0, 1, "algorithm", "type", "sort", "O(n)"), ("alg", 1, 2, "syntax", "framework", "web", "python;x;y")],
        "constraint_file string, pos int, id long, category string, constraint string, prompt string, answer string",
    )
    generations = spark.createDataFrame(
        [("m", "lib", 0, "```python\nimport os\n```"), ("m", "lib", 1, "import os"), ("m", "alg", 0, "code"), ("m", "alg", 1, "code"), ("m", "lib", 9, "beyond")],
        "model string, constraint_file string, pos int, response string",
    )
    return generations, instructions


def test_evaluate_and_scores(tables):
    details = W.evaluate(*tables, respond_with(F.when(F.contains("prompt", F.lit("sort")), "YES").otherwise("no")))
    got = {(r["constraint_file"], r["pos"]): r["is_matched"] for r in details.collect()}
    assert got == {("lib", 0): True, ("lib", 1): False, ("alg", 0): True, ("alg", 1): False}
    assert {r["constraint_file"]: r["score"] for r in W.scores(details).collect()} == {"lib": 0.5, "alg": 0.5, "overall": 0.5}
    assert {r["error_message"] for r in W.evaluate(*tables).where("category = 'algorithm'").collect()} == {"not judged"}
    new = {r["id"]: r["response"] for r in W.repair_turn(details.where("constraint_file = 'lib'"), respond_with(F.lit("import re"))).collect()}
    assert new == {1: "import os", 2: "import re"}


def test_levels(spark):
    instructions = spark.createDataFrame([("d", 0, 0, "python;dict"), ("d", 1, 1, "python;dict;5"), ("d", 2, 2, "python;list;['len']")], "constraint_file string, pos int, level int, answer string")
    code = "a = dict(x=5)\n"
    generations = spark.createDataFrame([("m", "d", i, code) for i in range(3)], "model string, constraint_file string, pos int, response string")
    got = {r["level"]: (r["total"], r["matched"], r["perfect"]) for r in W.evaluate_levels(generations, instructions).collect()}
    assert got == {0: (1, 1, 1), 1: (1, 2, 1), 2: (1, 2, 0)}


def test_construct(spark):
    seeds = spark.createDataFrame([("numpy", "math", "arrays", "x", "python"), ("flask", "web", "sites", "y", "python")], "name string, category string, description string, example string, language string")
    slots = spark.range(4).select(F.col("id").alias("pos"))
    said = F.when(F.col("pos") == 3, "none").otherwise(F.concat(F.lit("<prompt>"), F.element_at(F.split("prompt", " "), 5), F.when(F.col("pos") > 1, " longer task text").otherwise(""), F.lit("</prompt><answer>python;a</answer>")))
    out = W.construct(slots, seeds, "library", respond_with(said), "name").collect()
    assert sorted(r["id"] for r in out) == list(range(1, len(out) + 1)) and 2 <= len(out) <= 3
    levels = W.evolve(spark.createDataFrame([(1, "p", "a")], "id long, prompt string, answer string"), respond_with(F.lit("<new_prompt>q</new_prompt><new_answer>b</new_answer>")), 2)
    assert sorted((r["level"], r["prompt"]) for r in levels.collect()) == [(0, "p"), (1, "q"), (2, "q")]


def test_judge_tests_and_concepts(spark, tables):
    generations, instructions = tables
    verdicts = W.judge_functions(instructions, generations, respond_with(F.lit('{"meets_requirements": true, "confidence": 0.6}')), 0.6).collect()
    assert len(verdicts) == 4 and all(r["is_matched"] for r in verdicts)
    tests = W.generate_tests(instructions, respond_with(F.lit('{"tests": [{"name": "a"}]}'))).collect()
    assert [len(r["tests"]) for r in tests] == [1] * 4 and "response" not in tests[0].asDict()
    said = F.when(F.col("code") == "a", "loops").otherwise("Exception: x")
    assert [r["concepts"] for r in W.concepts(spark.createDataFrame([("a",), ("b",)], "code string"), respond_with(said)).collect()] == ["loops"]


def test_compilation(spark):
    df = spark.createDataFrame([("x = 1", "Python"), ("x =", "python"), ("a", "klingon"), ("int f() { return 1; }", "c"), ("match x:\n  case 1: pass", "python")], "generated_code string, language string")
    with pytest.raises(PermissionError):
        check_compilation(df)
    got = [(r["is_matched"], r["error_message"]) for r in check_compilation(df, allow=True).collect()]
    assert got[0] == (True, None) and not got[1][0] and "klingon" in got[2][1] and got[4][0]
    assert got[3][0] or got[3][1]  # as the compiler at hand says
    old = check_compilation(df.withColumn("v", F.lit("3.8")), version="v", allow=True).collect()
    assert old[0]["is_matched"] and not old[4]["is_matched"]


def test_no_failure_without_a_reason(monkeypatch, tmp_path):
    """Compilers that say nothing, say it on the other stream, in a form of their own, or can't be run."""
    monkeypatch.setenv("PATH", str(tmp_path))
    tool = tmp_path / "gcc"
    cases = {
        "exit 3": "exit status 3", "kill -9 $$": "ended by signal 9", "echo 'gcc: fatal error: no such thing' >&2; exit 1": "gcc: fatal error: no such thing",
        "echo 'main.c:1:2: error: odd'; exit 1": "main.c:1:2: error: odd", "printf '  quoted secret\\n' >&2; exit 1": "exit status 1",
    }
    for script, want in cases.items():
        tool.write_text(f"#!/bin/sh\n{script}\n")
        tool.chmod(0o755)
        assert toolchain.compiles("int a;", "c") == (False, want)
    tool.write_text("no program")
    assert not toolchain.compiles("int a;", "c")[0] and toolchain.compiles("int a;", "c")[1].startswith("gcc can't be run")
    tool.write_text("#!/bin/sh\nexit 0\n")
    assert toolchain.compiles("int a;", "c") == (True, None)
