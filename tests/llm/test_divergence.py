import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillwork.llm import divergence
from quillwork.llm.divergence import judge, keep_good, measure, references

WORDS = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(make_docs, odd_rows):
    rng = random.Random(6)
    rows = [r for r in odd_rows if r[0] not in (5, 6)]
    for i in range(40):
        bag = ["a", "b|", "#c", "the", "\n", "x\n\ny"][: rng.randint(1, 6)]
        rows.append((100 + i, " ".join(rng.choice(bag) for _ in range(rng.randint(0, 60)))))
    m = F.col("measured")
    out = measure(make_docs(rows)).select("text", *[m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r)[1:] == base(r["text"]), r["text"]


def js(p, q):
    a, b = sum(p), sum(q)
    out = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        out += (x and x * math.log2(x / m)) / 2 + (y and y * math.log2(y / m)) / 2
    return math.sqrt(max(out, 0))


def test_distance(make_docs):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "of", "Xy", "z9", "and"]) for _ in range(200)), "en", "s", 1) for i in range(12)]
    measured = measure(make_docs(rows))
    pools = references(measured)
    for r in judge(measured, pools).collect():
        assert r["char_distance"] == pytest.approx(js(r["measured"]["chars"], pools["en"]["chars"]), abs=2e-6)
        assert r["word_distance"] == pytest.approx(js(r["measured"]["words"], pools["en"]["words"]), abs=2e-6)


def test_strange_texts_are_rejected_and_others_kept(make_docs):
    rng = random.Random(8)
    bag = "the of and to in is that was on for house tree water green stone river".split()
    good = [(i, " ".join(rng.choice(bag) for _ in range(200)), "en", "s", 1) for i in range(30)]
    rows = good + [(100, " ".join(f"#{i}$%&" for i in range(200)), "en", "s", 1), (101, " ".join(rng.choice(["qq", "vv", "zz"]) + str(i) for i in range(200)), "en", "s", 1)]
    kept = {r["doc_id"] for r in keep_good(make_docs(rows)).collect()}
    assert kept == set(range(30))


def test_odd_rows(make_docs, odd_rows, clashing):
    df = clashing(make_docs([*odd_rows, (20, "x " * 300, None, None, None), (21, "y " * 60, "xx", None, None)]))
    out = keep_good(df)
    assert out.columns == df.columns
    assert not {1, 2, 3, 4} & {r["doc_id"] for r in out.collect()}
    assert keep_good(make_docs([])).count() == 0
    assert divergence.MIN_WORDS == 50
