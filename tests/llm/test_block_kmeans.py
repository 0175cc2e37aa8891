import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import block_kmeans
from quillwork.llm.block_kmeans import LARGEST, clustered, compressed, op13_block_kmeans, with_inertia

SCHEMA = "vec_id long, embedding array<double>, label int"
FOLDER = "/root/testdata/sf0.001"


def brute(rows, clusters=16, rounds=3):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, digest) by plain integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) <= LARGEST for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == k]
            if own:
                centroids[k] = [sum(xs) // len(own) for xs in zip(*own)]
    found = assign()
    of = [sum(d for c, d in found if c == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, of[c], sum(of), digest[c]) for (i, _), (c, d) in zip(kept, found)), key=str)


def result(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r)[:6] for r in with_inertia(*clustered(df)).collect()), key=str)


def vectors(n, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_integers(spark, seed):
    rows = vectors(150, seed, 0.1 * seed)
    assert result(spark, rows) == brute(rows)


def test_ties_copies_and_wide_values(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 1)) / 64 for _ in range(2)] + [0.0] * 62) for i in range(120)]
    rows += [(1000 + i, [0.5] * 64) for i in range(60)]
    rows += [(7, [rng.uniform(-2_000_000, 2_000_000) for _ in range(64)]) for _ in range(6)]
    assert result(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    good = vectors(20, 4)
    nan, inf = float("nan"), float("inf")
    odd = [(30, None), (31, []), (32, [0.1] * 63), (33, [0.1] * 65), (34, [None] + [0.1] * 63), (35, [nan] + [0.1] * 63), (36, [inf] + [0.1] * 63), (37, [-inf] + [0.1] * 63), (38, [1e300] + [0.1] * 63), (None, [0.2] * 64), (None, [0.3] * 64), (3, [0.2] * 64)]
    got = result(spark, good + odd)
    assert got == brute(good + odd) and {r[0] for r in got} == {*range(20), None}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = vectors(n, 5)
    assert result(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    rows = vectors(40, 6)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for c in ("codes", "step", "coarse", "left_out", "cluster", "distance", "h", "n", "at", "odd.name"):
        df = df.withColumn(c, F.lit("own"))
    assert sorted((tuple(r)[:6] for r in with_inertia(*clustered(df)).collect()), key=str) == brute(rows)


def test_bounds_screen_and_never_exceed_the_distance(spark):
    rows = vectors(200, 7, 0.05)
    coded = compressed(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    for r in coded:
        rest = np.array(r["codes"]) - r["step"] * np.array(r["coarse"], np.int64)
        assert np.abs(r["coarse"]).max() <= block_kmeans.LEVELS and 2 * np.abs(rest).max() <= r["step"]
        assert np.allclose(r["left_out"], np.sqrt(np.square(rest.reshape(8, 8)).sum(1)))
    assigned, _ = clustered(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    assert assigned.agg(F.avg("n_exact")).first()[0] < 8


def test_query_against_sql(spark):
    got = op13_block_kmeans(spark, FOLDER).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{FOLDER}/embeddings.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(block_kmeans.ORACLE).fetchall())


def test_query_has_the_columns_of_its_sql(spark):
    assert op13_block_kmeans(spark, FOLDER).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
