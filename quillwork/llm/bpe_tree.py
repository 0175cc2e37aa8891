"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by the tokenizer's pattern into pieces that never merge with each other. A piece
is encoded by halves, recursively, and the halves are joined at their boundary: the tokens next
to it are re-encoded in a growing window until the window's outer seams are stable. A seam is
stable when the two tokens beside it, encoded together, come out as the same two tokens; the
merges of a longer text can't cross such a seam first, so the tokens outside the window stay
as they are. Joining is associative, with the empty piece as its neutral element, and decoding
is the same tree with concatenation as its join.

Pieces repeat across texts, so each Python worker keeps the results of short ones. Work for a
piece is in proportion to its length times the tree's depth, whatever it consists of.

Defined results: null is encoded as the empty text, without tokens. Invalid UTF-8 is replaced
by U+FFFD before encoding. Rows are encoded one by one; order, repeats and further columns
don't matter.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes up to which a run is encoded directly.
LEAF = 16
NO_RANK = 1 << 60
#: Bytes from which pairs are kept in a heap.
LONG = 96
#: Tokens up to which a run is decoded directly.
DECODE_LEAF = 1024
#: Pieces that a worker keeps, and the longest of them in characters.
KEPT_PIECES = 200_000
KEPT_LENGTH = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class TreeCodec:
    """Encodes and decodes pieces with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.seams: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain greedy merging, for short runs: the pair of lowest rank first, leftmost on ties."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > LONG:
            return self.merge_long(data)
        rank = ranks.get
        cuts = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != NO_RANK:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NO_RANK)
        return [ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs, for windows that had to grow."""
        rank, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        pairs = [rank(data[i : i + 2], NO_RANK) for i in range(n - 1)] + [NO_RANK, NO_RANK]
        heap = [(r, i) for i, r in enumerate(pairs) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if pairs[i] != r:
                continue
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            pairs[gone] = NO_RANK
            for j in (i, before[i]):
                if j >= 0 and (k := after[j]) < n:
                    pairs[j] = rank(data[j : after[k]], NO_RANK)
                    if pairs[j] != NO_RANK:
                        heapq.heappush(heap, (pairs[j], j))
                elif j >= 0:
                    pairs[j] = NO_RANK
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        key = (left, right)
        if (known := self.seams.get(key)) is None:
            if len(self.seams) > KEPT_PIECES:
                self.seams.clear()
            known = self.seams[key] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenation of what both sides encode."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merge(self.decode(left[a:] + right[:b]))
            if (a == 0 or self.stable(left[a - 1], middle[0])) and (b == len(right) or self.stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def encode(self, data: bytes) -> list[int]:
        if len(data) <= LEAF or data in self.ranks:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_worker: list = []


def _codec(shared: Broadcast) -> tuple[TreeCodec, dict[str, bytes]]:
    """This worker's codec and kept pieces, made anew for another vocabulary."""
    if not _worker or _worker[0] is not shared.value:
        _worker[:] = [shared.value, TreeCodec(shared.value), {}]
    return _worker[1], _worker[2]


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The ranks of a vocabulary file, read by the driver and broadcast.

    It holds one row per token, 50,256 in the default one.
    """
    return spark.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))


def encoder(shared: Broadcast, pattern: str = public_tokenizers.PATTERN) -> Callable[[Column], Column]:
    """A function from a text column to its token ids (array of int), without special tokens."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, kept = _codec(shared)
        cut = regex.compile(pattern).findall

        def piece(p: str) -> bytes:
            ids = array("i", codec.encode(p.encode())).tobytes()
            if len(p) <= KEPT_LENGTH:
                if len(kept) >= KEPT_PIECES:
                    kept.clear()
                kept[p] = ids
            return ids

        for texts in batches:
            rows = [b"".join([kept.get(p) or piece(p) for p in cut(t)]) if (t := text.as_py()) else b"" for text in texts]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return lambda text: encode(F.make_valid_utf8(text))


def decoder(shared: Broadcast) -> Callable[[Column], Column]:
    """A function from token ids to the bytes that they stand for; null ids give no bytes."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, _ = _codec(shared)
        for ids in batches:
            flat, ends = ids.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))
            starts = [0, *ends[:-1]]
            yield pa.array([codec.decode(flat[a:b].tolist()) for a, b in zip(starts, ends)], pa.binary())

    return decode


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids``, the token ids of the text, and ``decoded``, the bytes they decode to."""
    shared = vocabulary(docs.sparkSession, path)
    return docs.withColumn("ids", encoder(shared)(F.col("text"))).withColumn("decoded", decoder(shared)(F.col("ids")))


def digests(docs: DataFrame) -> DataFrame:
    out = tokenize(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
