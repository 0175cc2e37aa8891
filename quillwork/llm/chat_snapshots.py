"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation again and again, each time with more turns. A rolling hash
runs over the turns of each conversation, so the hash after k turns names the first k turns.
The hashes that a conversation goes through before its last turn are the prefixes it contains;
an anti-join of every conversation's last hash against the set of those prefixes leaves the
maximal conversations. Of equal ones the smallest conv_id stays. Only hashes are shuffled for
that, one row per turn at most and summed up before; the texts move once, for rendering.

The rolling hash is a pair of sums of 64-bit hashes of (position, role, text), so it is kept up
turn by turn and depends on the order.

Defined results: turns are taken by turn (null first), then by role and, where both are equal,
by the text's hash; a turn that is there twice, word for word, counts once. Positions are those of the order, so turns may start at any
number and skip. Null roles and texts are equal to each other and render as empty. Rows without
conv_id belong to no conversation and are left out. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import durable, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p, q): the hashes p and q of the first k turns of each conversation.

    A row holds one turn and no text. Each distinct turn of a conversation counts once.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = turns.where("conv_id is not null").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit(1), text).alias("g"),
    )
    marked = marked.distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "h", "g")
    at = marked.withColumn("k", F.row_number().over(order))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rolled(h: str, seed: int) -> Column:
        # a decimal holds the sum of 64-bit numbers; ANSI arithmetic on longs would overflow
        each = F.xxhash64(F.lit(seed), "k", "role", h).cast("decimal(20,0)")
        return F.sum(each).over(rolling).cast("decimal(38,0)")

    return at.select("conv_id", "k", rolled("h", 0).alias("p"), rolled("g", 1).alias("q"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same): conversations that no other contains, one of each set of equals.

    n_same counts the conversations equal to it, itself included.
    """
    steps = durable(prefixes(turns))
    ends = steps.groupBy("conv_id").agg(F.max(F.struct("k", "p", "q")).alias("end")).select("conv_id", "end.*")
    inner = steps.join(ends.select("conv_id", F.col("k").alias("n")), "conv_id").where("k < n").select("k", "p", "q").distinct()
    whole = ends.groupBy("k", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    return whole.join(inner, ["k", "p", "q"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_same")


def render(turns: DataFrame, opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """(conv_id, chat): every conversation as one text with role markers."""
    text = F.coalesce("text", F.lit(""))
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("h"), text.alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(said)).alias("turns"))
    # array_sort puts a null turn inside a struct first, as the window above does
    lines = F.transform("turns", lambda t: F.concat(F.lit(opening), t["role"], F.lit("\n"), t["text"], F.lit(closing + "\n")))
    return whole.select("conv_id", F.array_join(lines, "").alias("chat"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, chat) for the maximal conversations."""
    stay = maximal(turns)
    chats = render(turns.select("conv_id", "turn", "role", "text").join(stay.select("conv_id"), "conv_id", "left_semi"))
    return stay.join(chats, "conv_id")


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_same", F.sha2("chat", 256).alias("chat_sha256"), "chat")


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT conv_id, row_number() OVER w AS k,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS chat
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT conv_id, max(k) AS n_turns, arg_max(chat, k) AS chat FROM s GROUP BY conv_id),
inner_prefix AS (SELECT DISTINCT s.k, s.chat FROM s JOIN e USING (conv_id) WHERE s.k < e.n_turns),
w AS (SELECT n_turns, chat, min(conv_id) AS conv_id, count(*) AS n_same FROM e GROUP BY n_turns, chat)
SELECT conv_id, n_turns, n_same, sha256(chat) AS chat_sha256, chat
FROM w WHERE NOT EXISTS (SELECT 1 FROM inner_prefix i WHERE i.k = w.n_turns AND i.chat = w.chat)
"""
