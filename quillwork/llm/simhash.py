"""SimHash near-duplicates with pigeonring filtering.

The fingerprint of a text has a bit set where over half of its shingles' 64-bit hashes have it.
Texts of one fingerprint are grouped first, so only distinct fingerprints are compared. Two
fingerprints within MAX_BITS differences are found through the ring of five segments: if the
whole differs in at most 4 bits, some segment starts a chain of consecutive segments whose
cumulative differences stay within its share of the budget (0 bits in one segment, 1 in two, 2
in three, 3 in four, 4 in all five). The first two links of that chain are the join key: the
first segment is equal and the second differs in one bit at most, which one side spells out.
Where many meet at a key, its third link, two bits in all, joins the key: each side spells out some
of the bits. The rest of the chain is checked as the join's condition, before the full Hamming
check. Only links that connect parts are kept, so dense clusters give no quadratic number of pairs.
Components of the links come from distributed star contraction.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Rows
that repeat a doc_id each have their own fingerprint; a null doc_id is a member but never a
component's id unless nothing else is in it. One row of each component is kept, whether it has
an id or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm.common import ascii_lower, connected_components, durable, let, space_words, stored, table

SHINGLE = 4
MAX_BITS = 4
#: (lowest bit, bits) of the ring's segments: one more than MAX_BITS.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Up to so many row numbers are broadcast; more meet the rows by shuffle.
MAX_BROADCAST = 1_000_000
#: Keys with more rows than this go on by the chain's third segment; both ways find all links.
CROWD = 256
#: Hashes that are unpacked at once.
BLOCK = 1 << 15


@F.arrow_udf(T.LongType())
def majority_bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The 64-bit value whose bits are set in over half of each list's values."""
    for lists in batches:
        out = np.zeros(len(lists), np.int64)
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        octets = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)
        start = 0
        for row, end in enumerate(ends):
            if end > start:
                counts = np.zeros(64, np.int64)
                for at in range(start, end, BLOCK):
                    counts += np.unpackbits(octets[at : min(end, at + BLOCK)], axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[row] = np.packbits(2 * counts > end - start, bitorder="little").view("<i8")[0]
            start = end
        yield pa.array(out)


def fingerprint(text: Column) -> Column:
    """The text's SimHash as a signed 64-bit number."""

    def shifted(a: Column, by: int, more: int) -> Column:
        return F.slice(a, F.lit(by + 1), F.size(a) - more)

    def joined(left: Column, right: Column) -> Column:
        return F.concat(left, F.lit(" "), right)

    def shingles(words: Column) -> Column:
        """Four words: two neighbours, then two neighbouring pairs."""
        pairs = F.zip_with(shifted(words, 0, 1), shifted(words, 1, 1), joined)
        return let(pairs, lambda p: F.zip_with(shifted(p, 0, 2), shifted(p, 2, 2), lambda a, b: F.xxhash64(joined(a, b))))

    def whole(words: Column) -> Column:
        return F.array(F.xxhash64(F.array_join(words, " ")))

    hashes = let(
        space_words(ascii_lower(text)),
        lambda w: F.when(F.size(w) >= SHINGLE, shingles(w)).when(F.size(w) > 0, whole(w)).otherwise(F.array().cast("array<bigint>")),
    )
    return majority_bits(hashes)


def _segment(fp: Column, i: int) -> Column:
    low, bits = SEGMENTS[i]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _within_ring(x: Column, start: Column) -> Column:
    """Whether the chain from segment start stays within budget at every length.

    x: the differing bits of two fingerprints.
    """
    m = len(SEGMENTS)
    out = F.lit(False)
    for i in range(m):
        chain, used = F.lit(True), F.lit(0)
        for length in range(1, m + 1):
            used = used + F.bit_count(_segment(x, (i + length - 1) % m))
            chain = chain & (used <= length * MAX_BITS // m)
        out = F.when(start == i, chain).otherwise(out)
    return out


def _key(i: int, first: Column, second: Column) -> Column:
    return F.shiftleft(first, 13).bitwiseOR(second).bitwiseOR(F.lit(i << 26))


def _held(fp: Column) -> Column:
    """One key per segment: it and the next."""
    m = len(SEGMENTS)
    return F.array(*[F.struct(F.lit(i).alias("i"), _key(i, _segment(fp, i), _segment(fp, (i + 1) % m)).alias("key")) for i in range(m)])


def _asked(fp: Column) -> Column:
    """The same keys, and each with one bit of the second segment changed."""
    m = len(SEGMENTS)
    out = []
    for i in range(m):
        flips = [0, *[1 << b for b in range(SEGMENTS[(i + 1) % m][1])]]
        key = _key(i, _segment(fp, i), _segment(fp, (i + 1) % m))
        out += [F.struct(F.lit(i).alias("i"), key.bitwiseXOR(F.lit(f)).alias("key"), F.lit(f == 0).alias("same")) for f in flips]
    return F.array(*out)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of keys that some value holds and that join several parts, with ``n``, the key's number of rows."""
    group = Window.partitionBy("key")
    several = F.min("part").over(group) != F.max("part").over(group)
    out = rows.withColumn("n", F.count("*").over(group)).withColumn("_open", several & F.max("held").over(group))
    return out.where("_open").drop("_open")


def _longer(rows: DataFrame) -> DataFrame:
    """rows by longer keys: two rows within the chain's first three budgets still share one.

    With the third segment one side or both change a bit of it where two are left of the budget,
    and only the holder where the asking side has changed a bit of the second.
    """
    m = len(SEGMENTS)
    third = F.get(F.array(*[_segment(F.col("fp"), (i + 2) % m) for i in range(m)]), F.col("i"))
    flips = F.array(*[F.lit(f).cast("long") for f in (0, *[1 << b for b in range(13)])])
    spelled = rows.withColumn("flip", F.explode(F.when(F.col("held") | F.col("same"), flips).otherwise(F.slice(flips, 1, 1))))
    key = F.shiftleft(F.col("key").cast("long"), 13).bitwiseOR(third.bitwiseXOR(F.col("flip"))).bitwiseOR(F.lit(1 << 45))
    return spelled.withColumn("key", key).drop("flip")


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values ``fp`` within MAX_BITS bits that connect what all such pairs connect.

    First every value is held against the smallest and the largest of those with the same key, which
    is linear. Where a key that some value holds then still joins several parts, the values outside its largest part are held
    against all others, and one pair is kept of each two parts. So a dense cluster of n values gives
    some n pairs instead of n * n, and no two parts that have a link stay apart.
    """
    x = F.col("a").bitwiseXOR(F.col("b"))
    held = fingerprints.select("fp", F.explode(_held(F.col("fp"))).alias("k")).select("fp", "k.*")
    ends = held.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    stars = held.join(ends, "key").select("fp", F.explode(F.array("low", "high")).alias("lead")).where("fp != lead")
    stars = stars.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))
    stars = durable(stars.where(F.bit_count(x) <= MAX_BITS).distinct())
    parts = connected_components(stars).withColumnRenamed("node", "fp")
    placed = durable(fingerprints.select("fp").join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("part")))
    own = placed.select("fp", "part", F.lit(True).alias("held"), F.explode(_held(F.col("fp"))).alias("k")).select("fp", "part", "held", "k.*", F.lit(True).alias("same"))
    asked = placed.select("fp", "part", F.lit(False).alias("held"), F.explode(_asked(F.col("fp"))).alias("k")).select("fp", "part", "held", "k.*")
    every = durable(_shared(own.union(asked)))
    every = durable(every.where(F.col("n") <= CROWD).union(_shared(_longer(every.where(F.col("n") > CROWD).drop("n")))))
    sizes = every.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    every = every.join(sizes, "key").withColumn("aside", F.col("part") != F.col("main"))
    left = every.where("held").select("key", "i", F.col("fp").alias("a"), F.col("part").alias("part_a"), F.col("aside").alias("aside_a"))
    right = every.where("not held").select("key", F.col("fp").alias("b"), F.col("part").alias("part_b"), F.col("aside").alias("aside_b"))
    near = _within_ring(x, F.col("i")) & (F.bit_count(x) <= MAX_BITS) & (F.col("part_a") != F.col("part_b"))
    met = left.where("aside_a").join(right, "key").union(left.where("not aside_a").join(right.where("aside_b"), "key")).where(near)
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    bridges = met.groupBy(F.least("part_a", "part_b").alias("p"), F.greatest("part_a", "part_b").alias("q")).agg(F.min(pair).alias("l"))
    return stars.union(bridges.select("l.a", "l.b"))


def label(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of the rows (doc_id, fp).

    root is the component's smallest fingerprint, component_id its smallest doc_id, null without any.
    """
    groups = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(groups)).withColumnRenamed("node", "fp")
    placed = groups.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, the first of equals."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id"), F.monotonically_increasing_id().alias("rid"), fingerprint(F.col("text")).alias("fp"))
    rows = stored(rows)
    slim = rows.select("doc_id", "fp", "rid").join(label(rows.select("doc_id", "fp")), "fp")
    keepers = slim.groupBy("root").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))).alias("rid"))
    gone = durable(slim.select("rid").join(keepers.select("rid"), "rid", "left_anti"))
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    return rows.join(gone, "rid", "left_anti").select("row.*")


def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = durable(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    placed = marked.join(label(marked), "fp")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
