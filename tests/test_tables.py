import json

from pyspark.sql import functions as F

from quillwork.sources import tables as S


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "answer": "x"}, {"id": 2, "prompt": "ü\n"}]))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text("[]")
    df = S.json_arrays(spark, str(tmp_path), S.INSTRUCTION)
    assert sorted((r["pos"], r["id"], r["prompt"]) for r in df.collect()) == [(0, 1, None), (1, 2, "ü\n")]
    assert [r["file"].rsplit("/", 1)[1] for r in S.bad_files(spark, str(tmp_path), S.INSTRUCTION).collect()] == ["b.json"]


def test_paths(spark):
    files = ["/o/gpt-4o/syntax_library_gpt-4o_20250101_1.json", "/o/deep-r1-7b/input_order_deep-other.json", "/o/m/_x_m.json"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(f,) for f in files], "f string").select(S.model_and_constraint(F.col("f"))).collect()]
    assert got == [("gpt-4o", "syntax_library"), ("deep-r1-7b", "input_order"), ("m", "x")]


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"code": "a"}\nbroken\n{"code": "b"}\n')
    assert sorted(r["code"] for r in S.json_lines(spark, str(tmp_path), "code string").collect()) == ["a", "b"]
    assert S.or_empty(spark, str(tmp_path / "none*"), "code string").count() == 0
    assert S.or_empty(spark, str(tmp_path / "*.jsonl"), "code string").count() == 2


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("m", "a", 2, 1), ("m", "b", 1, 1)], "model string, constraint string, total int, matched int")
    assert json.loads(S.score_map(scores).first()["scores"]) == {"a": {"total": 2, "matched": 1}, "b": {"total": 1, "matched": 1}}
    rows = spark.createDataFrame([("f", 1, "b"), ("f", 0, "a")], "file string, pos int, v string")
    assert json.loads(S.export_array(rows).first()["body"]) == [{"v": "a"}, {"v": "b"}]
    S.write_records(scores, str(tmp_path / "out"), ["model"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    prompts = spark.createDataFrame([("c", 0), ("c", 1)], "constraint string, pos int")
    tests = spark.createDataFrame([("c", 0, [("t", "1", "2")])], "constraint string, pos int, tests array<struct<name:string,input:string,expected_output:string>>")
    assert sorted(len(r["tests"]) for r in S.with_tests(prompts, tests).collect()) == [0, 1]
