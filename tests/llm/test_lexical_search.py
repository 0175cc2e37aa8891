import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillwork.llm import lexical_search
from quillwork.llm.lexical_search import blocks, op12_tput_search, search

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(1 for n in lengths if n), sum(lengths)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(counts, lengths):
            score = 0
            for w in set(terms(text)) & c.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 8 * (10 + 90 * n * n_docs // total)))
            if score:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def result(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return sorted((tuple(r) for r in search(d, q, **how).collect()), key=str)


def texts(n, seed, vocabulary=80, longest=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    odds = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices(words, odds, k=rng.randint(1, longest)))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "CHUNK", 16)
    docs, items = texts(150, 1), texts(12, 2, longest=20)
    assert result(spark, docs, items, k=k) == brute(docs, items, k)


def test_ties_by_doc_id(spark):
    docs = [(100 - i, "alpha beta") for i in range(40)] + [(200 + i, f"alpha gamma{i}") for i in range(5)] + [(None, "alpha beta"), (7, "delta"), (7, "delta")]
    items = [(1, "alpha beta"), (2, "Delta"), (3, "alpha alpha ALPHA")]
    got = result(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(61, 71))


def test_odd_rows(spark, odd_rows):
    items = [(1, None), (2, ""), (3, " .,; "), (4, "same text"), (4, "same text"), (None, "id"), (5, "word5x5 ünïcödé 漢字"), (6, " ".join(f"word{i}x{i % 13}" for i in range(977)))]
    assert result(spark, odd_rows, items) == brute(odd_rows, items)


def test_letters(spark):
    docs = [(1, "Ä ä A-Z a_z x y"), (2, "É1 é K k K"), (3, "a b\x00c\x7fd")]
    items = [(1, "ä"), (2, "K"), (3, "k"), (4, "x y"), (5, "c d"), (6, "a z")]
    assert result(spark, docs, items) == brute(docs, items)


def test_blocks_of_items(spark):
    docs, items = texts(60, 3), texts(9, 4, longest=15)
    q = spark.createDataFrame(items, "item_id long, text string")
    found = list(blocks(q, 12))
    assert len(found) > 1 and sorted(i for b in found for i in b.item_ids) == list(range(9))
    assert result(spark, docs, items, max_terms=12) == brute(docs, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == [] and result(spark, [(1, "a")], []) == [] and result(spark, [(1, None)], [(1, "a")]) == []


def test_long_lists_are_divided(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CHUNK", 8)
    monkeypatch.setattr(lexical_search, "LIST", 20)
    docs, items = texts(120, 5), texts(6, 6)
    assert result(spark, docs, items) == brute(docs, items)


def test_clashing_columns(spark):
    docs, items = texts(30, 7), texts(4, 8)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for c in ("rid", "n", "ids", "tfs", "item", "rank", "score", "words", "ikey", "part", "term", "odd.name"):
        d, q = d.withColumn(c, F.lit("own")), q.withColumn(c, F.lit("own"))
    assert sorted((tuple(r) for r in search(d, q).collect()), key=str) == brute(docs, items)


def test_query_against_sql(spark):
    got = op12_tput_search(spark, FOLDER).collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(lexical_search.ORACLE).fetchall())
