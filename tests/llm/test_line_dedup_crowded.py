"""Crowded buckets that were compared whole, keys that hold the same lines, bands of some of the shingles."""

import random

import pytest
from pyspark.sql import functions as F
from test_line_dedup import jaccard, missed, sentence
from test_line_dedup_short import one_letter

from quillwork.llm import line_dedup


def members_of(spark, rng):
    """A bucket of 100 lines that share half their words, in pairs of similar ones."""
    half, lines = sentence(rng, 20), []
    for _ in range(50):
        line = (half + " " + sentence(rng, 20)).split()
        near = list(line)
        near[rng.randrange(20)] = sentence(rng, 1)
        lines += [" ".join(line), " ".join(near)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    return texts.select(F.lit(1).cast("long").alias("key"), "id"), texts, lines


@pytest.mark.parametrize("whole", [2048, 70])
def test_only_larger_buckets_meet_by_rare_shingles(spark, monkeypatch, whole):
    """What was compared whole has no more pairs to find; a larger bucket finds the same links by rare shingles."""
    members, texts, lines = members_of(spark, random.Random(23))
    met = []
    by_rare = line_dedup.open_pairs
    monkeypatch.setattr(line_dedup, "open_pairs", lambda *args: met.append(1) or by_rare(*args))
    monkeypatch.setattr(line_dedup, "WHOLE", whole)
    roots = {r["node"]: r["root"] for r in line_dedup.similar_lines(members, texts).collect()}
    for i, line in enumerate(lines):
        for j in range(i):
            if jaccard(line, lines[j]) >= 0.8:
                assert roots[i] == roots[j]
    assert len(set(roots.values())) > 40
    assert len(met) == (whole == 70)


def test_keys_of_the_same_lines_stay_once(spark):
    rows = [(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (3, 11), (3, 12), (4, 12)]
    got = line_dedup.once_each(spark.createDataFrame(rows, "key long, id long"))
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (3, 10), (3, 11), (3, 12), (4, 12)]


def test_edits_are_found_on_both_sides_of_each_kind_of_bands(spark):
    """One and three edits in lines of 60 to 500 characters, texts with and without characters of SOME."""
    rng, pairs = random.Random(29), []
    while len(pairs) < 500:
        line = sentence(rng, rng.randint(8, 70))
        if len(pairs) % 5 == 0:
            line = line.translate(str.maketrans("aeimqu", "bcdfgh"))
        elif len(pairs) % 5 == 1:
            line = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(rng.randint(50, 200)))
        other = line
        for _ in range(rng.choice([1, 3])):
            other = one_letter(rng, other)
        if other != line and jaccard(line, other) >= 0.8:
            pairs.append((line, other))
    assert missed(spark, pairs) <= 5
    kinds = spark.createDataFrame([(a,) for a, _ in pairs], "line string").select(F.size(line_dedup.thinned(F.col("line"))).alias("n"))
    assert kinds.where(F.col("n") >= line_dedup.ENOUGH).count() > 50 and kinds.where(F.col("n") < line_dedup.FEW).count() > 50
