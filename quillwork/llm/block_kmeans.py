"""Centroid clustering of embeddings in integer arithmetic, screened by block norms.

Each vector is kept as 64 integers, its compressed form (five bits a component, times a step of
its own) and, for each of eight segments, the norm of what the compressed form leaves out; all of
it is written once. By Cauchy-Schwarz a segment's left-out part adds at most the product of its
norm and the centroid's to the inner product, so the compressed form and the norms give a lower
bound of the squared distance to each centroid. The centroid with the least bound gets an exact
integer distance first; of the others only those whose bound doesn't exceed the best distance so
far get one. Bounds are rounded down, so equal distances are never screened out and the smaller
number wins as it should.

Only sums leave a task: one row per cluster of components, counts and distances. The driver sees
CLUSTERS rows a round, whatever the number of vectors.

Defined results: a vector with a null, non-finite or missing component, or with another number
of components, has no row; neither has one with a component of 64 * |x| above LARGEST, whose
squared distances would not be exact in 64 bits. Vectors that repeat a vec_id are vectors of
their own; equal hashes and null vec_ids (last) are ordered by their components. Fewer vectors
than CLUSTERS give as many centroids as there are vectors; an empty table gives no rows. An
inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm.common import stored, table

DIMENSIONS = 64
SEGMENT = 8
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Largest component of a compressed vector: five bits with the sign.
LEVELS = 15
LARGEST = 1 << 27
#: Vectors that are compared at once: bounds and differences of a block stay in a few MB.
BLOCK = 4096

SUMS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
ASSIGNED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("n_exact", T.IntegerType())])


def compressed(vectors: DataFrame, scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, codes, step, coarse, left_out): the kept vectors as integers, compressed, and the norms of the rest."""

    def usable(x: Column) -> Column:
        return x.isNotNull() & (F.abs(x.cast("double")) * scale <= LARGEST)  # NaN is the largest double

    x = F.col("embedding")
    kept = vectors.where((F.size(x) == dimensions) & F.forall(x, usable))
    codes = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    coded = kept.select(F.col("vec_id").cast("long").alias("vec_id"), codes.alias("codes"))
    step = F.greatest(F.lit(1), F.ceil(F.array_max(F.transform("codes", F.abs)) / LEVELS)).cast("int")
    coded = coded.withColumn("step", step).withColumn("coarse", F.transform("codes", lambda c: F.round(c / F.col("step")).cast("byte")))

    def norm(start: int) -> Column:
        rest = F.zip_with(F.slice("codes", start + 1, SEGMENT), F.slice("coarse", start + 1, SEGMENT), lambda c, q: (c - q * F.col("step")).cast("double"))
        return F.sqrt(F.aggregate(rest, F.lit(0.0), lambda a, r: a + r * r))

    return coded.withColumn("left_out", F.array(*[norm(s) for s in range(0, dimensions, SEGMENT)]))


def first_centroids(coded: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    hashed = coded.select("codes", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"))
    rows = hashed.orderBy(F.col("h").asc_nulls_last(), "codes").limit(clusters).collect()
    return np.array([r["codes"] for r in rows], np.int64)


def segment_norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points.reshape(len(points), -1, SEGMENT).astype(np.float64)).sum(2))


class Block(NamedTuple):
    """Rows of compressed() as matrices."""

    vec_id: pa.Array
    codes: np.ndarray
    step: np.ndarray
    coarse: np.ndarray
    left_out: np.ndarray


def nearest(block: Block, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, exact distances computed) of each row."""
    codes = block.codes
    points, norms = centroids.astype(np.float64), segment_norms(centroids)
    size = np.square(codes.astype(np.float64)).sum(1)[:, None] + np.square(points).sum(1)[None, :]
    product = block.step[:, None] * (block.coarse @ points.T) + block.left_out @ norms.T
    # Rounding is a few parts in 1e16 of the sizes; the margin is far above that.
    bounds = size - 2 * product - (1e-9 * size + 1)
    best = bounds.argmin(1)
    distance = np.square(codes - centroids[best]).sum(1)
    exact = np.ones(len(codes), np.int32)
    first = best.copy()
    for k in range(len(centroids)):
        near = np.flatnonzero((bounds[:, k] <= distance) & (first != k))
        if len(near):
            d = np.square(codes[near] - centroids[k]).sum(1)
            exact[near] += 1
            better = (d < distance[near]) | ((d == distance[near]) & (k < best[near]))
            best[near[better]], distance[near[better]] = k, d[better]
    return best.astype(np.int32), distance, exact


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            codes, coarse, left_out = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("codes", "coarse", "left_out"))
            yield Block(part.column("vec_id"), codes.astype(np.int64), part.column("step").to_numpy().astype(np.float64), coarse.astype(np.float64), left_out)


def _summing(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for block in _blocks(batches):
            cluster, _, _ = nearest(block, centroids)
            count += np.bincount(cluster, minlength=len(centroids))
            for k in np.unique(cluster):
                total[k] += block.codes[cluster == k].sum(0)
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(total[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigning(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            cluster, distance, exact = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([block.vec_id, pa.array(cluster), pa.array(distance), pa.array(exact)], ["vec_id", "cluster", "distance", "n_exact"])

    return run


def refined(coded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of the mean of each cluster; empty ones stay."""
    wide = T.DecimalType(38, 0)
    sums = coded.mapInArrow(_summing(centroids), SUMS).select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    rows = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast(T.DecimalType(20, 0))).cast(wide).alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, n_exact), final centroids) of the columns vec_id and embedding."""
    if dimensions % SEGMENT:
        raise ValueError(f"the dimensions must be a multiple of {SEGMENT}")
    coded = stored(compressed(vectors.select("vec_id", "embedding"), scale, dimensions))
    centroids = first_centroids(coded, clusters)
    if not len(centroids):
        return coded.sparkSession.createDataFrame([], ASSIGNED), centroids
    for _ in range(rounds):
        centroids = refined(coded, centroids)
    return stored(coded.mapInArrow(_assigning(centroids), ASSIGNED)), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with the inertia of each cluster and of all, and the centroids' digests."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(T.DecimalType(20, 0))).alias("total")).collect()
    whole = sum(int(r["total"]) for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def long(x: int) -> int | None:
        return x if x < 1 << 63 else None

    rows = [(r["cluster"], long(int(r["total"])), long(whole), digests[r["cluster"]]) for r in sums]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")


def op13_block_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, sf_dir, "embeddings"))).drop("n_exact")


def _round(k: int) -> str:
    """Assignment a{k} to the centroids c{k} and, but for the last, the centroids after it."""
    return f"""
d{k} AS MATERIALIZED (SELECT p.rid, c.k, sum((p.v - c.v) * (p.v - c.v)) AS d FROM parts p JOIN c{k} c USING (i) GROUP BY ALL),
a{k} AS (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{k} GROUP BY rid),
m{k} AS (SELECT a.k, p.i, sum(p.v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} a JOIN parts p USING (rid) GROUP BY ALL),
c{k + 1} AS (SELECT c.k, c.i, coalesce((CASE WHEN m.s >= 0 THEN m.s // m.n ELSE -((-m.s + m.n - 1) // m.n) END)::BIGINT, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (k, i))"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS codes
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(x::DOUBLE) * {SCALE} <= {LARGEST})) = {DIMENSIONS}
), parts AS MATERIALIZED (SELECT rid, unnest(range({DIMENSIONS})) AS i, unnest(codes) AS v FROM kept),
firsts AS (SELECT codes, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, codes) - 1 AS k FROM kept QUALIFY k < {CLUSTERS}),
c0 AS (SELECT k, unnest(range({DIMENSIONS})) AS i, unnest(codes) AS v FROM firsts),{",".join(_round(k) for k in range(ROUNDS + 1))},
digests AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, a.k::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rid) JOIN digests USING (k)
"""
