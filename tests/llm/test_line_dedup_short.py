"""Line dedup where lines are short, and on both sides of any change of method."""

import random

from pyspark.sql import functions as F
from test_line_dedup import brute, jaccard, missed, results, sentence, shingles

from quillwork.llm import line_dedup
from quillwork.llm.line_dedup import dedup_lines

SHORT = [
    ("copyright notice 2023", "copyright notice 2024"), ("all rights reserved", "all rights reserved."),
    ("terms and conditions apply", "terms and conditions apply."), ("unsubscribe", "unsubscribe!"),
]


def one_letter(rng, line):
    i = rng.randrange(len(line))
    return line[:i] + rng.choice(["x", "", line[i] + "x"]) + line[i + 1 :]


def test_short_lines_against_brute_force(make_docs):
    rows = [(10 * k + i, line) for k, pair in enumerate(SHORT) for i, line in enumerate(pair)]
    assert results(dedup_lines(make_docs(rows))) == brute(rows)


def test_recall_of_one_letter_edits(spark):
    rng = random.Random(12)
    for words in (1, 2, 3, 5, 8, 15):
        pairs = []
        while len(pairs) < 300:
            line = sentence(rng, words)
            other = one_letter(rng, line)
            if line != other and jaccard(line, other) >= 0.8:
                pairs.append((line, other))
        assert missed(spark, pairs) <= 3, words


def test_no_break_at_a_line_length(spark, make_docs):
    """One character more, near 16 characters a word and where the kind of bands changes."""
    pairs = [("internationalize", "internationalized"), ("https://ab.cd/e/fg", "https://ab.cd/e/fgh"), ("漢字仮名交文之一二三四五六七八九十", "漢字仮名交文之一二三四五六七八九十百")]
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    pairs += [(line := " ".join(letters[16 * i : 16 * i + 15 + (i == n - 1) * 2] for i in range(n)), line + "s") for n in (1, 2, 3)]
    pairs += [(letters[:n], letters[: n + 1]) for n in (line_dedup.SHORT + line_dedup.SHINGLE + k for k in (-2, -1, 0))]
    assert all(jaccard(*p) >= 0.8 for p in pairs) and missed(spark, pairs) == 0
    rows = [(10 * k + i, line) for k, pair in enumerate(pairs) for i, line in enumerate(pair)]
    assert results(dedup_lines(make_docs(rows))) == brute(rows)


def test_edge_edits_of_short_lines_are_found(spark):
    """An edit at either end of lines of 4 to 9 words, at similarities from 0.8 on."""
    rng = random.Random(21)
    pairs = []
    while len(pairs) < 600:
        line = sentence(rng, rng.randint(4, 9))
        word = sentence(rng, 1)[: rng.randint(1, 6)]
        other = rng.choice([f"{line} {word}", f"{word} {line}", line[len(word) :], line[: -len(word)]])
        if jaccard(line, other) >= 0.8:
            pairs.append((line, other))
    assert missed(spark, pairs) <= 0.01 * len(pairs)


def test_no_link_within_a_crowded_bucket_is_lost(spark):
    """Variants far from the first and last line of the bucket that they all share."""
    rng, lines = random.Random(6), []
    for k in range(60):
        line = sentence(rng, rng.randint(3, 5))
        lines += [line, line + "."]
    texts = dict(enumerate(dict.fromkeys(lines)))
    df = spark.createDataFrame(list(texts.items()), "id long, line string")
    roots = line_dedup.similar_lines(df.select(F.lit(1).cast("long").alias("key"), "id"), df)
    want = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and jaccard(texts[i], texts[j]) >= 0.8:
                want = {k: want[i] if r == want[j] else r for k, r in want.items()}
    got = {r["node"]: r["root"] for r in roots.collect()}
    groups = lambda m: {frozenset(k for k in texts if m.get(k, k) == r) for r in set(m.values())}
    assert len(groups(want)) < len(texts) - 30 and {g for g in groups(got) if len(g) > 1} == {g for g in groups(want) if len(g) > 1}


def test_no_similar_pair_fails_the_bounds(spark):
    rng, pairs = random.Random(8), []
    while len(pairs) < 600:
        line = other = sentence(rng, rng.choice([1, 2, 4, 9, 30, 90]))
        for _ in range(rng.randint(1, 9)):
            other = one_letter(rng, other or "x")
        if jaccard(line, other) >= 0.8:
            pairs.append((line, other))
    marks = line_dedup.with_marks(spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "id long, line string"))
    got = {r["id"]: r["marks"] for r in marks.collect()}
    df = spark.createDataFrame([(got[2 * i], got[2 * i + 1]) for i in range(len(pairs))], "a struct<size:bigint,map:array<bigint>>, b struct<size:bigint,map:array<bigint>>")
    assert df.where(~line_dedup.maybe_similar(F.col("a"), F.col("b"), 0.8)).count() == 0


def test_signatures_of_odd_lines(spark):
    """Short and very long lines, repeated shingles, characters outside the basic plane."""
    lines = ["a", "abcde", "ha " * 30_000, "\U0001f600" * 9, "x" * 100_000, "abcde"]
    rng = random.Random(4)
    lines += [sentence(rng, rng.randint(1, 60)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    keys = {r["id"]: set(r["bands"]) for r in line_dedup.with_bands(df).collect()}
    assert all(keys.values()) and keys[1] == keys[5] and not keys[0] & keys[1]
    assert {r["id"]: r["marks"]["size"] for r in line_dedup.with_marks(df).collect()} == {i: len(shingles(x)) for i, x in enumerate(lines)}


def test_long_words_with_one_edit_are_linked(make_docs):
    """Exact similarity decides, however few of the words are alike."""
    rows = [(1, "internationalization standardization characterization misinterpretation counterrevolutionary"), (2, "internationalization standardixation characterization misinterpretation counterrevolutionary")]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8
    assert results(dedup_lines(make_docs(rows))) == brute(rows)


def test_crowded_bucket_is_split_without_loss(spark):
    """Lines that share half their words, in different parts; among them pairs just beyond the limit."""
    rng = random.Random(12)
    half, lines = sentence(rng, 20), []
    for _ in range(150):
        line = (half + " " + sentence(rng, 20)).split()
        near = list(line)
        for _ in range(rng.randint(1, 5)):
            near[rng.randrange(len(near))] = sentence(rng, 1)
        lines += [" ".join(line), " ".join(near)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    members = texts.select(F.lit(1).cast("long").alias("key"), "id", F.col("id").alias("part"))
    pairs = line_dedup.open_pairs(members, line_dedup.with_marks(texts), texts, 0.8)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {(i, j) for j in range(len(lines)) for i in range(j) if jaccard(lines[i], lines[j]) >= 0.8}
    assert want and want <= got and len(got) < 2 * len(lines)


def test_joined_parts_give_no_rows_by_rare_shingles(spark):
    """A dense group in two crowded buckets: the bounds are held in the join, which makes each pair's rows only if they allow it."""
    rng = random.Random(17)
    half, lines = sentence(rng, 20), []
    for _ in range(80):
        line = (half + " " + sentence(rng, 20)).split()
        near = list(line)
        near[rng.randrange(len(near))] = sentence(rng, 1)
        lines += [" ".join(line), " ".join(near)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    marks = line_dedup.with_marks(texts)
    members = texts.select(F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("key"), "id", F.col("id").alias("part"))
    similar = {(i, j) for j in range(len(lines)) for i in range(j) if jaccard(lines[i], lines[j]) >= 0.8}
    in_buckets = {(r["a"], r["b"]) for r in line_dedup.few_pairs(members, marks, 0.8).collect()}
    assert similar and similar <= in_buckets and len(in_buckets) < 2 * len(lines)
    met = line_dedup.open_pairs(members, marks, texts, 0.8)
    joins = [x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "NOT (part" in x]
    assert joins and all("bit_count" in x for x in joins)
    # lines that the buckets have joined don't meet again
    joined = members.withColumn("part", F.col("id") - F.col("id") % 2)
    assert {(r["a"], r["b"]) for r in line_dedup.open_pairs(joined, marks, texts, 0.8).collect()} & similar == set()
