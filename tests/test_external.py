import threading
import time

import pytest
from pyspark.sql import functions as F

from quillwork.operators.counters import Counters
from quillwork.operators.external import from_client, logged
from quillwork.sources.tables import checked_lines, line_counts


def counting(folder, fails=lambda p: False, wait=0.0):
    """A client that leaves one file per call in a folder, and how often each prompt was asked."""

    def connect():
        def client(prompt):
            (folder / f"{prompt}-{time.time_ns()}-{threading.get_ident()}").write_text("")
            time.sleep(wait)
            if fails(prompt):
                raise ValueError("refused")
            return prompt.upper()

        return client

    def asked():
        names = [p.name.split("-")[0] for p in folder.iterdir()]
        return {n: names.count(n) for n in names}

    return connect, asked


def test_calls_in_flight_keep_the_order(spark, tmp_path):
    connect, asked = counting(tmp_path, wait=0.2)
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, prompt string").coalesce(1)
    rows = from_client(df, connect, in_flight=10).collect()
    starts = [int(p.name.split("-")[1]) for p in tmp_path.iterdir()]
    assert max(starts) - min(starts) < 3e9  # one after another the calls begin over 3.8 s
    assert [(r["i"], r["response"]) for r in rows] == [(i, f"P{i}") for i in range(20)]
    assert set(asked().values()) == {1}


def test_log_is_asked_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "i int, prompt string")
    connect, asked = counting(tmp_path / "calls", fails=lambda p: p == "bad")

    def run(df):
        out = logged(df, lambda x: from_client(x, connect, tries=1), str(tmp_path / "log"), each=2)
        return {r["i"]: (r["response"], r["error"]) for r in out.collect()}

    want = {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, "no prompt"), 5: (None, "ValueError: refused")}
    assert run(prompts) == want and asked() == {"a": 1, "b": 1, "bad": 1}
    more = prompts.union(spark.createDataFrame([(6, "c")], prompts.schema))
    assert run(more) == want | {6: ("C", None)} and asked() == {"a": 1, "b": 1, "bad": 2, "c": 1}
    assert run(prompts.limit(0)) == {}


def test_stopped_run_goes_on(spark, tmp_path):
    """A job that breaks off between portions asks for none of the committed ones again."""
    (tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "i int, prompt string")
    connect, asked = counting(tmp_path / "calls")
    turns = []

    def breaks(df):
        turns.append(1)
        if len(turns) == 3:
            raise RuntimeError("stopped")
        return from_client(df, connect)

    with pytest.raises(RuntimeError):
        logged(prompts, breaks, str(tmp_path / "log"), each=6)
    early = asked()
    assert 0 < len(early) < 30
    out = logged(prompts, lambda df: from_client(df, connect), str(tmp_path / "log"), each=6)
    assert {r["i"]: r["response"] for r in out.collect()} == {i: f"P{i}" for i in range(30)}
    assert len(asked()) == 30 and set(asked().values()) == {1}


def test_counters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": "x"}\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text("[]x\n")
    path = str(tmp_path / "*.jsonl")
    got = {r["file"].rsplit("/", 1)[1]: (r["good"], r["bad"]) for r in line_counts(spark, path, "id bigint").collect()}
    assert got == {"a.jsonl": (2, 2), "b.jsonl": (0, 1)}
    counters = Counters()
    rows = counters.watch(checked_lines(spark, path, "id bigint"), "lines", bad=F.col("bad"))
    assert sorted(r["id"] for r in rows.where("not bad").select("item.*").collect()) == [1, 2]
    assert {(r["metric"], r["value"]) for r in counters.table(spark).collect()} == {("rows", 5), ("bad", 3)}
    with pytest.raises(ValueError):
        counters.watch(rows, "lines")
