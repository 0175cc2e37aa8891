import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillwork.llm import pairwise_quality
from quillwork.llm.pairwise_quality import FEATURES, THRESHOLD, features, fit, fit_all, held_out, labelled, op3_bradley_terry, order_statistic, quantile, sample, score, scored

LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.6
        if not good:
            words = [w + rng.choice(["###", "$$", "%%%", ""]) for w in words] + words[:10]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(make_docs, spark):
    docs, labels = corpus(600)
    df = make_docs(docs)
    w, threshold = fit(*sample(df, spark.createDataFrame(labels, LABELS)))
    out = score(df, w, threshold).withColumn("held", held_out(F.col("doc_id"))).collect()
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in out if r["held"]]
    assert 100 < len(held) < 200
    right = sum((r["score"] >= THRESHOLD) == (truth[r["doc_id"]] == 1) for r in held)
    assert right >= 0.95 * len(held)
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98


def test_no_held_out_label_is_learned(make_docs, spark):
    docs, labels = corpus(200)
    df = make_docs(docs)
    held = {r["doc_id"] for r in df.where(held_out(F.col("doc_id"))).collect()}
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    a, b = (fit(*sample(df, spark.createDataFrame(rows, LABELS))) for rows in (labels, turned))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_sample_is_bounded(make_docs, spark):
    docs, labels = corpus(200)
    x, y = sample(make_docs(docs), spark.createDataFrame(labels * 2, LABELS), limit=50)
    assert len(x) == len(y) <= 50


def test_odd_rows(make_docs, spark, odd_rows):
    df = make_docs([*odd_rows, (8, "A" * 100_000), (9, "!" * 100)])
    rows = df.select(features(F.col("text")).alias("x")).collect()
    assert all(len(r["x"]) == len(FEATURES) and all(map(math.isfinite, r["x"])) for r in rows)
    out = score(df, np.ones(len(FEATURES)), 0.5).collect()
    assert len(out) == len(odd_rows) + 2 and all(0 <= r["score"] <= 1 for r in out)


def test_without_labels(make_docs, spark):
    df = make_docs([(1, "x"), (2, None)])
    for labels, want in (([], 1.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, None, 0), (None, 1, 0), (1, 7, 0)], 1.0)):
        w, threshold = fit(*sample(df, spark.createDataFrame(labels, LABELS)))
        got = {r["score"] for r in score(df, w, threshold).collect()}
        assert got <= {0.0, 1.0} and len(got) == 1, (labels, got, want)


def featured(df):
    return df.select("doc_id", features(F.col("text")).alias("x"))


def test_all_labels_are_learned(make_docs, spark, tmp_path, monkeypatch):
    docs, labels = corpus(300)
    df, known = make_docs(docs), spark.createDataFrame(labels + labels[:50], LABELS)
    held = {r["doc_id"] for r in df.where(held_out(F.col("doc_id"))).collect()}
    rows = labelled(featured(df), known).collect()
    assert {r["doc_id"] for r in rows} == set(range(300)) - held and sum(r["n"] for r in rows) == sum(i not in held for i, *_ in labels + labels[:50])
    for q in (0, 1):
        mine = sorted(r["i"] for r in rows if r["quality"] == q)
        assert mine == list(range(len(mine)))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(pairwise_quality, "MAX_LABELLED", 1)  # no sample decides what is learned
    out = op3_bradley_terry(spark, str(tmp_path)).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(out) == 300 and sum(r["predicted"] == truth[r["doc_id"]] for r in out if r["held_out"]) >= 0.95 * len(held)


def test_fit_of_all_rows_is_close_to_the_local_one(make_docs, spark):
    docs, labels = corpus(300)
    df, known = make_docs(docs), spark.createDataFrame(labels, LABELS)
    one, other = score(df, *fit(*sample(df, known))), scored(featured(df), *fit_all(featured(df), known))
    both = one.select("doc_id", "score").join(other.select("doc_id", F.col("score").alias("s")), "doc_id").collect()
    assert np.corrcoef([r["score"] for r in both], [r["s"] for r in both])[0, 1] > 0.97


def test_order_statistics_are_exact(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, -1.5, 1e-12, rng.random(), 1e9 * rng.random()]) for _ in range(300)]
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    for rank in (0, 60, 299):
        assert order_statistic(counts, rank) == sorted(values)[rank]
    assert quantile(counts, 300, 0.617) == np.quantile(values, 0.617)


def test_all_rows_without_labels(make_docs, spark):
    rows = featured(make_docs([(1, "x"), (2, None)]))
    for labels, want in (([], 1.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, None, 0), (None, 1, 0), (1, 7, 0)], 1.0)):
        got = {r["score"] for r in scored(rows, *fit_all(rows, spark.createDataFrame(labels, LABELS))).collect()}
        assert got == {want}
