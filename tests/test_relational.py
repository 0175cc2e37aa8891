import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.operators import external, templates
from quillwork.operators import relational as R
from quillwork.operators import similarity
from quillwork.operators.similarity import greedy_keep, lcs_length, lcs_native, rouge_l_filter, rouge_l_links, rouge_l_pairs, token_classes


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_agree(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcd") for _ in range(rng.randint(0, 20))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    for r in df.select("i", lcs_length("a", "b").alias("x"), lcs_native(F.col("a"), F.col("b")).alias("y")).collect():
        assert r["x"] == r["y"] == plain_lcs(*pairs[r["i"]])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=8), max_size=14), st.sampled_from([0.3, 0.7, 1.0]))
def test_rouge_filter_is_the_sequential_one(spark, texts, limit):
    kept, edges = [], set()
    for i, t in enumerate(texts):
        f = {j: 2 * plain_lcs(texts[j], t) / (len(t) + len(texts[j])) if t and texts[j] else 0 for j in range(i)}
        edges |= {(j, i) for j in f if f[j] >= limit - 1e-9}
        if not any(f[j] >= limit - 1e-9 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    assert {(r["a"], r["b"]) for r in rouge_l_pairs(df, "id", "text", limit).collect()} == edges
    assert sorted(r["id"] for r in rouge_l_filter(df, "id", "text", limit, native=True).collect()) == kept


def test_greedy_is_not_components(spark):
    nodes, edges = spark.range(4), spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert sorted(r["id"] for r in greedy_keep(nodes, edges).collect()) == [0, 2, 3]
    with pytest.raises(ValueError):
        rouge_l_pairs(nodes, "id", "id", 0)


def test_positions(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 3).repartition(5)
    out = R.reindexed(df.drop("id"), F.col("x")).collect()
    assert sorted((r["id"], r["x"]) for r in out) == [(i + 1, 3 * i) for i in range(1000)]
    a = R.with_position(spark.createDataFrame([("k", 5), ("k", 3), ("l", 1)], "g string, v int"), ["v"], ["g"])
    b = spark.createDataFrame([("k", 0, "p")], "g string, pos int, w string")
    assert [(r["v"], r["w"]) for r in R.positional_join(a, b, ["g"]).collect()] == [(3, "p")]
    assert R.beyond_end(a, b, ["g"]).count() == 2


def test_scores(spark):
    rows = [("m", "a", True), ("m", "a", False), ("m", "b", None), ("n", "a", True)]
    df = spark.createDataFrame(rows, "model string, constraint string, ok boolean")
    out = {(r["model"], r["constraint"]): (r["total"], r["matched"], r["score"]) for r in R.score(df, ["model", "constraint"], F.col("ok"), ["model"]).collect()}
    assert out == {("m", "a"): (2, 1, 0.5), ("m", "b"): (1, 0, 0.0), ("n", "a"): (1, 1, 1.0), ("m", "overall"): (3, 1, 1 / 3), ("n", "overall"): (1, 1, 1.0)}
    assert R.score(df.limit(0), ["model"], F.col("ok")).count() == 0


def test_chains(spark):
    levels = [0, 1, 2, 0, 6, 5, 3]
    df = spark.createDataFrame([("c", i, n, f"a{i}") for i, n in enumerate(levels)], "g string, pos int, level int, answer string")
    got = {r["pos"]: r["chain"] for r in R.chains(df, ["g"]).collect()}
    assert got == {0: ["a0"], 1: ["a0", "a1"], 2: ["a0", "a1", "a2"], 3: ["a3"], 5: ["a0", "a1", "a2", "a3", "a4", "a5"], 6: ["a3", "a4", "a5", "a6"]}
    scores = R.level_scores(spark.createDataFrame([("m", 1, [True, False]), ("m", 1, [True, True])], "model string, level int, checks array<boolean>"), ["model"])
    assert scores.first().asDict() == {"model": "m", "level": 1, "total": 2, "matched": 3, "perfect": 1, "ssr": 0.75, "hsr": 0.5}
    assert R.all_levels(scores).count() == 6


def test_balanced(spark):
    slots = spark.range(23).withColumnRenamed("id", "pos")
    items = spark.createDataFrame([(x,) for x in "abcde"], "item string")
    out = R.assign_balanced(slots, items, "item", seed=4).collect()
    counts = [sum(r["item"] == x for r in out) for x in "abcde"]
    assert len(out) == 23 and max(counts) - min(counts) <= 1
    for epoch in range(4):
        assert len({r["item"] for r in out if r["pos"] // 5 == epoch}) == 5
    with pytest.raises(ValueError):
        R.assign_balanced(slots, items.limit(0), "item")


def test_unseen_and_parameters(spark):
    new = spark.createDataFrame([(" a b ",), ("c",), (None,), ("long enough",)], "code string")
    old = spark.createDataFrame([("a b",), (None,)], "code string")
    assert sorted(r["code"] for r in R.unseen(new, old).collect()) == ["c", "long enough"]
    assert [r["code"] for r in R.unseen(new, old, least=5).collect()] == ["long enough"]
    df = spark.sql("select array(named_struct('position', 2, 'd', 'x'), named_struct('position', cast(null as int), 'd', 'y'), named_struct('position', 0, 'd', 'z')) p")
    assert [x["d"] for x in df.select(R.sorted_parameters(F.col("p"))).first()[0]] == ["y", "z", "x"]


def test_repair_and_external(spark):
    details = spark.createDataFrame([(1, "good", True), (2, "bad", False), (3, "bad", None)], "id long, generated_code string, is_matched boolean")
    responses = spark.createDataFrame([(2, "new")], "id long, response string")
    got = {r["id"]: (r["response"], r["error"]) for r in R.repaired(details, responses).collect()}
    assert got == {1: ("good", None), 2: ("new", None), 3: (None, "no response")}

    def connect():
        def ask(prompt):
            if "x" in prompt:
                raise RuntimeError("no")
            return prompt.upper()

        return ask

    asked = spark.createDataFrame([(1, "a"), (2, "x")], "id long, prompt string")
    out = {r["id"]: (r["response"], r["error"]) for r in external.retried(asked, lambda df: external.from_client(df, connect, tries=2)).collect()}
    assert out == {1: ("A", None), 2: (None, "RuntimeError: no")}
    levels = external.evolved(asked.select("id", "prompt"), lambda df, k: df.withColumn("prompt", F.concat("prompt", F.lit(str(k)))), 2).collect()
    assert sorted((r["level"], r["prompt"]) for r in levels) == [(0, "a"), (0, "x"), (1, "a1"), (1, "x1"), (2, "a12"), (2, "x12")]


def test_templates(spark):
    seeds = spark.createDataFrame([([(2, "Map", ""), (1, "List", "of ints")], "fixed")], "parameter_list array<struct<position int, data_structure string, description string>>, feature string")
    assert "1: List, of ints; 2: Map" in templates.prompts(seeds, "input_order", F.lit("Go")).first()["prompt"]
    with pytest.raises(KeyError):
        templates.generator("nothing")
    with pytest.raises(ValueError):
        templates.register("library", lambda f: F.lit(""))
    df = spark.createDataFrame([("Javadoc",), ("other",)], "n string")
    assert [r[0] for r in df.select(templates.comment_language(F.col("n"), F.lit("C"))).collect()] == ["Java", "C"]


def test_reindexed_keeps_every_wide_row(spark):
    """Many wide rows over many ranges: no row is lost and the numbers have no gap."""
    n = 1_500_000
    df = spark.range(n, numPartitions=16).select((F.lit(7 * n) - F.col("id") * 7).alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("wide"))
    out = R.reindexed(df, F.col("key"))
    got = out.agg(F.count("*"), F.min("id"), F.max("id"), F.countDistinct("id"), F.sum((F.col("id") * 7 != F.col("key")).cast("int")), F.count("wide")).first()
    assert tuple(got) == (n, 1, n, n, 0, n)


def test_rouge_filter_of_many_copies(spark):
    """Ten thousand copies are compared as one."""
    df = spark.range(10_000).select("id", F.when(F.col("id") % 5_000 == 4_999, "other words in this one").otherwise("the same words again and again").alias("text"))
    assert sorted(r["id"] for r in rouge_l_filter(df, "id", "text").collect()) == [0, 4_999]
    few = df.where("id < 20")
    assert rouge_l_pairs(few, "id", "text").where("score = 1 and lcs = 6").count() == 190


def test_common_words_alone_make_no_candidates(spark, monkeypatch):
    """Six common words of ten can't reach 0.7: such pairs get no LCS."""
    monkeypatch.setattr(similarity, "lcs_length", lambda x, y: F.least(F.size(x), F.size(y)))  # passes whatever is verified
    texts = [(i, f"p{i} q{i} r{i} s{i} the of and to in is") for i in range(20)] + [(20, "p0 q0 r0 s0 the of and to in on")]
    links = rouge_l_links(token_classes(spark.createDataFrame(texts, "id long, text string"), "id", "text")[0])
    assert [(r["a"], r["b"]) for r in links.collect()] == [(0, 20)]
