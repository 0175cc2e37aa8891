import random

from pyspark.sql import functions as F

from quillwork.llm.chat_snapshots import collapse

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(set(v))) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        same = [d for d, o in seqs.items() if o == s]
        if c == min(same):
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s))
    return out


def results(df):
    return {r["conv_id"]: (r["n_turns"], r["n_same"], r["chat"]) for r in df.collect()}


def test_against_brute_force(spark):
    rng, rows = random.Random(13), []
    for c in range(120):
        start = rng.choice([0, 1, 5])
        n = rng.randint(1, 5)
        for t in range(n):
            rows.append((c, start + 2 * t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "yes"]) if t else rng.choice(["hi", "hi", "hey"])))
    assert results(collapse(spark.createDataFrame(rows, TURNS).repartition(4))) == brute(rows)


def test_prefix_in_text_alone_is_no_snapshot(spark):
    rows = [(1, 0, "user", "ab"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, 0, "assistant", "a")]
    assert set(results(collapse(spark.createDataFrame(rows, TURNS)))) == {1, 3, 4}


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "x" * 100_000), (2, 0, "user", "x" * 100_000), (3, 0, None, None), (4, 0, "", "")]
    df = spark.createDataFrame(rows, TURNS).withColumn("k", F.lit(1)).withColumn("p", F.lit(2)).withColumn("chat", F.lit(3))
    got = results(collapse(df))
    assert got == brute(rows) and got[2][0] == 1
    assert collapse(spark.createDataFrame([], TURNS)).count() == 0
