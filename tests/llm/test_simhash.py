import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import simhash
from quillwork.llm.simhash import fingerprint, keep_one, label, links


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids):
    """ids: (doc_id, fingerprint) to doc_id: smallest id reachable."""
    root = {i: i for i, _ in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in ids:
        for j, y in ids:
            if i < j and (x ^ y).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(make_docs, odd_rows):
    rows = [*odd_rows, (8, "A b C d E"), (9, "one"), (10, "x\u00a0y z\tw v\x1cu")]
    got = make_docs(rows).select("text", fingerprint(F.col("text")).alias("fp")).collect()
    assert all(r["fp"] == signed(brute_fingerprint(r["text"])) for r in got) and len(got) == len(rows)


def near(rng, n):
    """Numbers some of which are a few bits from each other."""
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_links_connect_what_all_links_connect(spark):
    values = list(set(near(random.Random(4), 400)))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    got = {(r["a"], r["b"]) for r in links(df).collect()}
    assert got <= {tuple(sorted((signed(x), signed(y)))) for x in values for y in values if x < y and (x ^ y).bit_count() <= 4}
    assert joined(got, map(signed, values)) == joined([(signed(x), signed(y)) for x in values for y in values if (x ^ y).bit_count() <= 4], map(signed, values))


def joined(pairs, values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in root}


@pytest.mark.parametrize("crowd", [0, 256])
def test_links_of_values_with_equal_segments(spark, monkeypatch, crowd):
    """Two segments are the same in all, so every value meets every other; three differ, some by four bits or fewer."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    low = rng.getrandbits(26)
    values = list({low | (v >> 26) << 26 for v in near(rng, 400)})
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    want = [(signed(x), signed(y)) for x in values for y in values if x < y and (x ^ y).bit_count() <= 4]
    got = {(r["a"], r["b"]) for r in links(df).collect()}
    assert got <= {tuple(sorted(p)) for p in want}
    assert joined(got, map(signed, values)) == joined(want, map(signed, values))


def test_keys_that_nobody_holds_drop_out(spark):
    """Two values that change a bit each to the same key, far apart otherwise, and no third one there."""
    value = random.Random(3).getrandbits(64)
    other = value ^ 0b11 << 13 ^ 0xFFFF << 30
    rows = [(signed(v), signed(v), held, key, True) for v in (value, other) for held, key in ((True, v >> 13 & 0x1FFF), (False, value >> 13 & 0x1FFF ^ 1))]
    df = spark.createDataFrame(rows, "fp long, part long, held boolean, key long, same boolean")
    assert simhash._shared(df).count() == 0


def test_dense_cluster_gives_few_links(spark):
    """All within two bits of one value, so each is linked with each; some strangers share its keys."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    values = rng.sample(sorted(values), 1800) + [centre ^ (0xFFF << 26), centre ^ (0xFFF << 44)]
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    found = [(r["a"], r["b"]) for r in links(df).collect()]
    assert len(found) <= 20 * len(values)
    want = joined([(signed(values[0]), signed(v)) for v in values[:1800]], map(signed, values))
    assert joined(found, map(signed, values)) == want


def test_chain_of_links(spark):
    """Each within four bits of the next only."""
    value, values = random.Random(7).getrandbits(64), []
    for i in range(16):
        values.append(value)
        value ^= 0xF << (4 * i)
    df = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "doc_id long, fp long")
    assert {r["component_id"] for r in label(df).collect()} == {0}
    assert label(df.limit(0)).count() == 0


def test_components(spark):
    ids = list(enumerate(near(random.Random(8), 300)))
    df = spark.createDataFrame([(i, signed(v)) for i, v in ids], "doc_id long, fp long").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in df.join(label(df), "fp").collect()}
    assert got == brute_components(ids)


def test_keep_one(make_docs, odd_rows, clashing):
    df = clashing(make_docs([*odd_rows, (0, "same text here"), (11, "other words in here")]))
    out = keep_one(df)
    assert out.columns == df.columns
    rows = out.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    assert len(set(fps)) == len(fps)
    ids = {r["doc_id"] for r in rows}
    assert {0, 1, 5, 7, 11} <= ids and not {2, 3, 4, 6} & ids
    assert keep_one(make_docs([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_some_chain_stays_within_its_budget(x, bits):
    """The principle that the join rests on, for any difference of four bits or fewer."""
    d = [0] * 5
    for b in bits:
        d[min(b // 13, 4)] += 1
    assert any(all(sum(d[(i + k) % 5] for k in range(n)) <= 4 * n // 5 for n in range(1, 6)) for i in range(5))
