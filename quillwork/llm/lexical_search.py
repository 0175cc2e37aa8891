"""Ranked lexical search by TPUT over postings that are partitioned by term.

Documents become slim vectors (counts of the terms that any item asks for), written once. Their
inverted form is the postings table: lists by term, highest impact first. A list is kept in
chunks of CHUNK documents and dealt by term; the list of a term in over LIST documents goes to
several partitions, so a word that stands in every document never lies in one task.

Three phases answer a block of items at once:
1. The first K entries of each list are fetched. Exact scores of these documents give each item a
   lower bound, the K-th best of them.
2. A document that beats the bound has an entry of at least bound / terms in some list. So every
   list of an item is read down to that one threshold, and no further. The sums of what was read
   raise the bound; with the most that each unread entry can add they give upper bounds.
3. Documents whose upper bound reaches the bound are looked up in the vectors and scored exactly.

No phase groups by document and item in a shuffle: sums are made per chunk, whose lists hold all
entries of its documents. Items are answered in blocks of MAX_TERMS terms, so the vocabulary that
tasks hold is bounded whatever the number of items.

Defined results: null and empty texts have no terms; such an item has no rows and such a document
doesn't count. Documents that repeat a doc_id are ranked each for themselves, and equal scores
are ordered by doc_id, null last, then by the order of reading. Items that repeat an item_id are
answered each for themselves. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import ascii_lower, stored, table

K = 10
CHUNK = 4096
LIST = 1_000_000
MAX_TERMS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every byte that ends a term as a space, A-Z lower-cased, all others as they are.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

VECTORS = "rid long, doc_id long, n long, ids array<int>, tfs array<int>"
POSTINGS = "term int, split int, chunk long, rids array<long>, impacts array<long>"
FETCHED = "chunk long, term int, rids array<long>, impacts array<long>"
CANDIDATES = "item int, rid long, partial long, most long"
SCORES = "item int, rid long, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"

Batches = Iterator[pa.RecordBatch]


class Block(NamedTuple):
    """Items that are answered together: their ids, and their terms as numbers into words."""

    item_ids: list[int | None]
    terms: list[np.ndarray]
    words: list[bytes]


class Weights(NamedTuple):
    """What turns counts into impacts."""

    n_docs: int
    n_terms: int
    df: np.ndarray
    weight: np.ndarray

    def impacts(self, ids: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 10 + 90 * n * self.n_docs // self.n_terms
        return self.weight[ids] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


def blocks(items: DataFrame, max_terms: int = MAX_TERMS) -> Iterator[Block]:
    """The items (item_id, text) in blocks of about max_terms terms; an item is never divided."""
    words = F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS), ""))
    asked = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("ikey"), words.alias("words")).where(F.size("words") > 0))
    total = asked.agg(F.sum(F.size("words"))).first()[0]
    if total is None:
        return
    parts = 1 + total // max_terms
    while True:
        dealt = asked.withColumn("part", F.pmod(F.xxhash64("ikey"), F.lit(parts)))
        sizes = dealt.groupBy("part").agg(F.sum(F.size("words")).alias("terms"), F.count("*").alias("items"))
        if not sizes.where((F.col("terms") > 2 * max_terms) & (F.col("items") > 1)).head(1):
            break
        parts *= 2
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).select("item_id", "words").orderBy("item_id", "ikey").collect()
        if rows:
            lists = [[w.encode() for w in r["words"]] for r in rows]
            words = sorted(set().union(*lists))
            number = {w: i for i, w in enumerate(words)}
            yield Block([r["item_id"] for r in rows], [np.array(sorted(number[w] for w in ws), np.int64) for ws in lists], words)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def _flat(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False)


def vectors(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """One row per document: its length in terms and its counts of the given words, by number."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n, sizes, ids, tfs = [], [], [], []
            for text in batch.column("text"):
                terms = (text.as_py() or b"").translate(FOLDED).split()
                counts = Counter(terms)
                known = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                n.append(len(terms))
                sizes.append(len(known))
                ids.extend(k for k, _ in known)
                tfs.extend(c for _, c in known)
            lengths = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), _lists(ids, lengths, pa.int32()), _lists(tfs, lengths, pa.int32())], ["rid", "doc_id", "n", "ids", "tfs"])

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, VECTORS)


def weights(rows: DataFrame, n_words: int) -> Weights:
    """Document counts over all vectors. The driver gets a row per word at most."""

    def run(batches: Batches) -> Batches:
        df, docs, terms = np.zeros(n_words, np.int64), 0, 0
        for batch in batches:
            n = _numbers(batch, "n")
            docs, terms = docs + int(np.count_nonzero(n)), terms + int(n.sum())
            df += np.bincount(_flat(batch, "ids")[0], minlength=n_words)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, [-1, -2]])), pa.array(np.concatenate([df[found], [docs, terms]]))], ["word", "df"])

    counted = rows.select("n", "ids").mapInArrow(run, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    of = {r["word"]: r["df"] for r in counted.collect()}
    n_docs, df = of.get(-1, 0), np.array([of.get(i, 0) for i in range(n_words)], np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    return Weights(n_docs, of.get(-2, 0), df, weight)


def postings(rows: DataFrame, by: Weights) -> DataFrame:
    """The lists of all terms, in chunks, dealt by term; entries of no impact add nothing and are left out."""
    splits = 1 + by.df // LIST

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                rid, n = _numbers(batch, "rid"), _numbers(batch, "n")
                (ids, sizes), (tfs, _) = _flat(batch, "ids"), _flat(batch, "tfs")
                impacts, rids = by.impacts(ids, tfs, np.repeat(n, sizes)), np.repeat(rid, sizes)
                order = np.lexsort((rids, -impacts, ids))
                order = order[impacts[order] > 0]
                if len(order):
                    terms, lengths = np.unique(ids[order], return_counts=True)
                    chunk = np.full(len(terms), rid[0])
                    columns = [pa.array(terms, pa.int32()), pa.array(rid[0] // CHUNK % splits[terms], pa.int32()), pa.array(chunk), _lists(rids[order], lengths, pa.int64()), _lists(impacts[order], lengths, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["term", "split", "chunk", "rids", "impacts"])

    return rows.mapInArrow(run, POSTINGS).repartition("term", "split").drop("split")


def heads(lists: DataFrame, k: int = K) -> DataFrame:
    """(term, rid, impact): the first k entries of each list."""
    first = lists.select("term", F.inline(F.arrays_zip(F.slice("rids", 1, k).alias("rid"), F.slice("impacts", 1, k).alias("impact"))))
    first = first.toDF("term", "rid", "impact")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "rid"))
    return first.withColumn("place", place).where(F.col("place") <= k).drop("place")


def lookup(pairs: DataFrame, rows: DataFrame, block: Block, by: Weights) -> DataFrame:
    """Exact scores of the distinct pairs (item, rid). A document's items are a list of the block's at most."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in block.terms])])
    flat = np.concatenate(block.terms)

    def run(batches: Batches) -> Batches:
        impact = np.zeros(len(block.words), np.int64)
        for batch in batches:
            rid, n = _numbers(batch, "rid"), _numbers(batch, "n")
            (ids, sizes), (tfs, _), (items, asked) = _flat(batch, "ids"), _flat(batch, "tfs"), _flat(batch, "items")
            impacts, scores = by.impacts(ids, tfs, np.repeat(n, sizes)), np.zeros(len(items), np.int64)
            a = b = 0
            for i in range(batch.num_rows):
                own, a_next, b_next = slice(a, a + sizes[i]), a + sizes[i], b + asked[i]
                impact[ids[own]] = impacts[own]
                for j in range(b, b_next):
                    scores[j] = impact[flat[starts[items[j]] : starts[items[j] + 1]]].sum()
                impact[ids[own]] = 0
                a, b = a_next, b_next
            doc_id = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), asked)))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(np.repeat(rid, asked)), doc_id, pa.array(scores)], ["item", "rid", "doc_id", "score"])

    asked = pairs.groupBy("rid").agg(F.collect_list("item").alias("items"))
    return rows.join(asked, "rid").mapInArrow(run, SCORES)


def bounds(scores: DataFrame, column: str, n_items: int, k: int = K) -> np.ndarray:
    """The k-th highest value of each item, 0 where it has fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(column), "rid"))
    rows = scores.select("item", column, place.alias("place")).where(F.col("place") == k).collect()
    out = np.zeros(n_items, np.int64)
    for r in rows:
        out[r["item"]] = r[column]
    return out


def fetch(lists: DataFrame, block: Block, bound: np.ndarray, tops: np.ndarray, k: int = K) -> DataFrame:
    """(item, rid, partial, most) of the documents that may reach the bound.

    partial sums the entries at or above the item's threshold, most adds what unread ones can have.
    """
    threshold = [max(1, -(-int(b) // len(t))) for b, t in zip(bound, block.terms)]
    lowest = np.full(len(block.words), np.iinfo(np.int64).max)
    for terms, t in zip(block.terms, threshold):
        lowest[terms] = np.minimum(lowest[terms], t)

    def prefixes(batches: Batches) -> Batches:
        for batch in batches:
            term = _numbers(batch, "term").astype(np.int64)
            (rids, sizes), (impacts, _) = _flat(batch, "rids"), _flat(batch, "impacts")
            row = np.repeat(np.arange(len(term)), sizes)
            read = impacts >= lowest[term][row]
            lengths = np.bincount(row[read], minlength=len(term))
            some = np.flatnonzero(lengths)
            columns = [pa.array(_numbers(batch, "chunk")[some]), pa.array(term[some], pa.int32()), _lists(rids[read], lengths[some], pa.int64()), _lists(impacts[read], lengths[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "term", "rids", "impacts"])

    def sums(lists: pa.Table) -> pa.Table:
        (rids, sizes), (impacts, _) = _flat(lists, "rids"), _flat(lists, "impacts")
        docs, at = np.unique(rids, return_inverse=True)
        ends = np.cumsum(sizes)
        where = {int(t): slice(e - s, e) for t, e, s in zip(_numbers(lists, "term"), ends, sizes)}
        out: list[tuple[np.ndarray, ...]] = []
        for item, (terms, t) in enumerate(zip(block.terms, threshold)):
            unread = np.minimum(t - 1, tops[terms])
            partial, gain = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            for term, most in zip(terms.tolist(), unread.tolist()):
                if own := where.get(term):
                    n = int(np.searchsorted(-impacts[own], -t, "right"))
                    index, values = at[own][:n], impacts[own][:n]  # a document is once in a list
                    partial[index] += values
                    gain[index] += values - most
            seen = np.flatnonzero(partial)
            if len(seen):
                own_bound = np.partition(partial[seen], -k)[-k] if len(seen) >= k else 0
                most = gain[seen] + int(unread.sum())
                near = most >= max(int(bound[item]), int(own_bound))
                out.append((np.full(near.sum(), item, np.int32), docs[seen[near]], partial[seen[near]], most[near]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int32)] + [np.zeros(0, np.int64)] * 3
        return pa.table(columns, ["item", "rid", "partial", "most"])

    return lists.mapInArrow(prefixes, FETCHED).groupBy("chunk").applyInArrow(sums, CANDIDATES)


def _answer(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    rows = stored(vectors(docs, block.words))
    by = weights(rows, len(block.words))
    if not by.df.any():
        return None
    lists = stored(postings(rows, by))
    first = stored(heads(lists, k))
    tops = np.zeros(len(block.words), np.int64)
    for r in first.groupBy("term").agg(F.max("impact").alias("top")).collect():
        tops[r["term"]] = r["top"]
    asking = spark.createDataFrame([(int(t), i) for i, terms in enumerate(block.terms) for t in terms], "term int, item int")
    pairs = first.join(asking, "term").select("item", "rid").distinct()
    bound = bounds(lookup(pairs, rows, block, by), "score", len(block.item_ids), k)
    found = stored(fetch(lists, block, bound, tops, k))
    bound = np.maximum(bound, bounds(found, "partial", len(block.item_ids), k))
    least = spark.createDataFrame(list(enumerate(map(int, bound))), "item int, bound long")
    near = found.join(F.broadcast(least), "item").where("most >= bound").select("item", "rid")
    scores = lookup(near, rows, block, by).where("score > 0")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid"))
    ids = spark.createDataFrame(list(enumerate(block.item_ids)), "item int, item_id long")
    ranked = scores.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each of items (item_id, text)."""
    found = [a for b in blocks(items, max_terms) if (a := _answer(docs, b, k)) is not None]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], RESULT)


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
i AS MATERIALIZED (SELECT row_number() OVER () AS ikey, item_id, list_distinct({_TERMS}) AS t FROM benchmark),
totals AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
asked AS MATERIALIZED (SELECT ikey, unnest(t) AS term FROM i),
p AS MATERIALIZED (
  SELECT rid, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT rid, len(t) AS n, unnest(t) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY rid, term
), w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, totals GROUP BY term),
s AS (
  SELECT ikey, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN asked USING (term), totals GROUP BY ikey, rid
)
SELECT item_id, (row_number() OVER (PARTITION BY ikey ORDER BY score DESC, doc_id NULLS LAST, rid))::INT AS rank, doc_id, score
FROM s JOIN i USING (ikey) JOIN d USING (rid) WHERE score > 0 QUALIFY rank <= {K}
"""
