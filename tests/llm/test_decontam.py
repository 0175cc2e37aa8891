import random
import re

import pytest

from quillwork.llm import decontam
from quillwork.llm.decontam import covered, decontaminate, find_hits

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """For each document its number of words, of words hit, and the items that occur."""
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.fixture
def case(make_docs, spark):
    rng = random.Random(3)
    bag = "Ab cd ef gh-ij klé MN op1 q r s t u v".split()

    def text(n):
        return " ".join(rng.choice(bag) for _ in range(n))

    items = [(i, text(rng.randint(8, 30))) for i in range(15)] + [(20, "short one"), (21, None), (22, ""), (21, "two Rows share an Id but not a text at all here"), (None, text(12))]
    docs = []
    for i in range(40):
        own = [x for _, x in items if x]
        docs.append((i, text(rng.randint(0, 80)) + (" " + rng.choice(own).upper() + " " + text(3) if i % 3 == 0 else "")))
    docs += [(50, None), (51, ""), (52, "a short ONE here"), (52, "a short ONE here"), (None, items[0][1])]
    return docs, items, make_docs(docs), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [20_000, 0])
def test_against_brute_force(case, monkeypatch, most):
    monkeypatch.setattr(decontam, "MAX_SET", most)
    monkeypatch.setattr(decontam, "MAX_BROADCAST", most)
    docs, items, df, bench = case
    hits = find_hits(df.select("doc_id", "text"), bench)
    got = hits.select("row.doc_id", "n_words", covered(hits["spans"]).alias("n"), "items").collect()
    assert sorted([(r[0], r[1], r[2], r[3]) for r in got], key=str) == brute(docs, items)


@pytest.mark.parametrize("most", [20_000, 0])
def test_document_and_span_actions(case, clashing, monkeypatch, most):
    monkeypatch.setattr(decontam, "MAX_SET", most)
    docs, items, df, bench = case
    clean = [x for x in brute(docs, items) if x[2] == 0]
    df = clashing(df)
    out = decontaminate(df, bench)
    assert out.columns == df.columns and out.count() == len(clean)
    cut = decontaminate(df, bench, "span")
    assert cut.columns == df.columns
    left = {r["doc_id"]: len(words(r["text"])) for r in cut.collect()}
    assert all(left[i] == n - h for i, n, h, _ in brute(docs, items) if i is not None)


def test_empty_tables(make_docs, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(make_docs([(1, "a b c")]), bench).count() == 1
    assert decontaminate(make_docs([]), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate(make_docs([]), bench, "other")


def test_large_benchmark_and_a_passage_in_many_items(make_docs, spark):
    """More windows than the hash set takes, and one of them in more items than are broadcast by count of windows."""
    from pyspark.sql import functions as F

    word = F.sha2(F.concat(F.col("id"), F.lit("w"), F.col("j")), 256)
    items = spark.range(30).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(1000)))).select("id", "j", word.alias("w"))
    texts = items.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("text"))
    same = "one two three four five six seven eight nine ten"
    bench = texts.select(F.col("id").alias("item_id"), "text").union(spark.range(1000, 3000).select("id", F.lit(same)))
    some = texts.where("id = 3").first()["text"].split(" ")[100:115]
    df = make_docs([(1, "a b " + " ".join(some) + " c"), (2, "zero " + same), (3, "nothing of it"), (4, None)])
    got = {r["row"]["doc_id"]: (covered_words(r["spans"]), r["items"]) for r in find_hits(df.select("doc_id", "text"), bench).collect()}
    assert got[1] == (15, ["3"]) and got[2][0] == 10 and len(got[2][1]) == 2000 and got[3] == got[4] == (0, [])
    assert sorted(r["doc_id"] for r in decontaminate(df, bench).collect()) == [3, 4]


def covered_words(spans):
    return len({x for s in spans for x in range(s["start"], s["start"] + s["k"])})
