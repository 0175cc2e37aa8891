"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Every ten
consecutive words of a benchmark item are a window; an item of fewer words is one window. The
hashes of all windows travel with the plan as a hash set, so the scan of the training texts
keeps only the few positions that may match. Those positions carry their words into an exact
join with the windows. Only rows with hits are shuffled, never texts.

The benchmark's size is counted first. Up to MAX_SET windows the set holds their hashes; of a
larger benchmark it holds one bit for each, in a bitmap of at most MOST_WORDS * 64 bits, which a
few other windows pass as well. Up to MAX_BROADCAST rows of windows are broadcast to the exact
join; more are joined by shuffle. The result is the same. Where only documents are to be found or
cut and the set holds all windows, their texts are compared in place and nothing is shuffled.

Defined results: a null or empty text has no words and no hits; a null or empty item has no
window; an item without an id marks words but isn't listed. Rows that repeat a doc_id are
judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import ascii_lower, let, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text that isn't lower-cased yet.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
MAX_SET = 20_000
MAX_BROADCAST = 500_000
#: 64-bit words of the bitmap of a larger benchmark, at most, and bits for each of its windows.
MOST_WORDS = 1 << 19
BITS_EACH = 16


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _window_hashes(h: Column, k: int, use) -> Column:
    """use(array of the hash of every k consecutive words), from the words' hashes h.

    Two window hashes of k // 2 and k - k // 2 words make one of k, so the work is
    logarithmic in k for each position. h must have k elements or more.
    """
    if k == 1:
        return use(h)
    a = k // 2

    def pair(left: Column, right: Column) -> Column:
        n = F.size(h) - (k - 1)
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(a + 1), n), lambda x, y: F.xxhash64(x, y))

    if a == k - a:
        return _window_hashes(h, a, lambda w: let(pair(w, w), use))
    return _window_hashes(h, a, lambda left: _window_hashes(h, k - a, lambda right: let(pair(left, right), use)))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _starts(words: Column, k: int, among: Callable[[Column], Column]) -> Column:
    """0-based first positions of the k-word windows whose hash is among those of the set."""
    found = let(
        _word_hashes(words),
        lambda h: _window_hashes(h, k, lambda w: F.array_compact(F.transform(w, lambda x, i: F.when(among(x), i)))),
    )
    return F.when(F.size(words) >= k, found).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(k, window, item_id): every n-word window of each item, or the whole of a shorter one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normal_words(F.col("text")).alias("words")).where("size(words) > 0")
    items = items.withColumn("k", F.least(F.lit(n), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)
    items = items.select("item_id", "words", "k", F.explode(starts).alias("at"))
    return items.select("k", F.array_join(F.slice("words", F.col("at"), F.col("k")), " ").alias("window"), "item_id").distinct()


def _hashed(windows: DataFrame, k: int) -> DataFrame:
    hashes = let(_word_hashes(F.split("window", " ")), lambda h: _window_hashes(h, k, lambda w: w[0]))
    return windows.where(F.col("k") == k).select(hashes.alias("h"))


def _hash_set(windows: DataFrame, k: int) -> Callable[[Column], Column]:
    """Whether a hash is that of a window of k words; MAX_SET of them at most come to the driver."""
    hashes = [r["h"] for r in _hashed(windows, k).distinct().collect()]
    return lambda x: x.isin(*hashes)


def _bitmap(windows: DataFrame, k: int, n: int) -> Callable[[Column], Column]:
    """The same with few false hits, by a bitmap of n windows: MOST_WORDS numbers at most come to the driver."""
    size = 64
    while size < MOST_WORDS and size * 64 < BITS_EACH * n:
        size *= 2

    def word(h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(size - 1)).cast("int")

    def bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    rows = _hashed(windows, k).groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(bit(F.col("h"))).alias("bits")).collect()
    bits = [0] * size
    for r in rows:
        bits[r["word"]] = r["bits"]
    # a constant, so it is read once for a plan
    held = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    return lambda h: F.get(held, word(h)).bitwiseAND(bit(h)) != 0


def _sized(benchmark: DataFrame, n: int) -> tuple[DataFrame, dict[int, int], int]:
    """The windows, how many distinct ones there are by length (n lengths at most), and all rows."""
    windows = benchmark_windows(benchmark, n)
    by_length = windows.groupBy("k").agg(F.countDistinct("window").alias("n"), F.count("*").alias("rows")).collect()
    return windows, {r["k"]: r["n"] for r in by_length}, sum(r["rows"] for r in by_length)


def _candidates(words: Column, sets: dict[int, Callable[[Column], Column]]) -> Column:
    """(start, k, window) of every place of a text that may hold a window."""

    def places(k: int, among: Callable[[Column], Column]) -> Column:
        return F.transform(
            _starts(words, k, among),
            lambda p: F.struct(p.alias("start"), F.lit(k).alias("k"), F.array_join(F.slice(words, p + 1, F.lit(k)), " ").alias("window")),
        )

    found = [places(k, among) for k, among in sorted(sets.items())]
    return F.flatten(F.array(*found)) if found else F.array().cast("array<struct<start:int,k:int,window:string>>")


def find_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(row, spans): docs' columns but text as a struct, and the sorted (start, k) of its hits."""
    windows, lengths, _ = _sized(benchmark, n)
    if sum(lengths.values()) > MAX_SET:
        return find_hits(docs, benchmark, n).select("row", "spans")
    sets = {k: _hash_set(windows, k) for k in lengths}
    texts = [r["window"] for r in windows.select("window").distinct().collect()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    scanned = docs.select(row.alias("row"), normal_words(F.col("text")).alias("_words"))
    exact = F.filter("hits", lambda h: h["window"].isin(*texts))
    spans = F.sort_array(F.transform(exact, lambda h: F.struct(h["start"].alias("start"), h["k"].alias("k"))))
    return scanned.select("row", _candidates(F.col("_words"), sets).alias("hits")).select("row", spans.alias("spans"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs (their columns but text as a struct ``row``) with n_words, spans and items.

    spans: sorted (start, k) of every occurrence of a window; items: sorted ids as strings.
    """
    windows, lengths, rows = _sized(benchmark, n)
    small = sum(lengths.values()) <= MAX_SET
    sets = {k: _hash_set(windows, k) if small else _bitmap(windows, k, m) for k, m in lengths.items()}
    if rows <= MAX_BROADCAST:
        windows = F.broadcast(windows)
    columns = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    words = F.col("_words")
    scanned = docs.select(row.alias("row"), normal_words(F.col("text")).alias("_words"))
    scanned = scanned.select(
        F.monotonically_increasing_id().alias("rid"),
        "row",
        F.size("_words").cast("long").alias("n_words"),
        _candidates(words, sets).alias("hits"),
    )
    # each document once, so that those without a hit stay, and once more for every candidate;
    # the key of the first kind matches no window and is dealt out evenly
    marker = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("k"), F.concat(F.lit("\0"), F.col("rid").cast("string")).alias("window")))
    each = scanned.select("rid", "row", "n_words", F.explode(F.concat(marker, "hits")).alias("hit"))
    each = each.select("rid", "hit.*", F.when(F.col("hit.start").isNull(), F.struct("row", "n_words")).alias("doc"))
    joined = each.join(windows.select("window", "item_id", F.lit(True).alias("in_item")), "window", "left")
    joined = joined.where(F.col("doc").isNotNull() | F.col("in_item"))
    out = joined.groupBy("rid").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sort_array(F.collect_set(F.when(F.col("in_item"), F.struct("start", "k")))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    return out.select("doc.row", "doc.n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["k"] - F.greatest(acc["end"], s["start"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["k"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the sorted spans and the gaps before them."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).*?{ANY_CASE_WORD}|.+$"), F.lit(0))

    def keep(p: Column) -> Column:
        """Parts before, between and after the spans."""
        done = F.aggregate(
            spans,
            F.struct(F.lit("").alias("out"), F.lit(0).alias("end")),
            lambda acc, s: F.struct(
                F.concat(acc["out"], F.array_join(F.slice(p, acc["end"] + 1, F.greatest(F.lit(0), s["start"] - acc["end"])), "")).alias("out"),
                F.greatest(acc["end"], s["start"] + s["k"]).alias("end"),
            ),
        )
        return let(done, lambda d: F.concat(d["out"], F.array_join(F.slice(p, d["end"] + 1, F.size(p)), "")))

    return F.when(F.size(spans) == 0, text).otherwise(let(parts, keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "document") -> DataFrame:
    """docs without contaminated documents, or, with action "span", without the hit words."""
    if action not in ("document", "span"):
        raise ValueError(f"action: {action}")
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    hits = find_spans(docs.select(row, "text"), benchmark)
    if action == "document":
        return hits.where(F.size("spans") == 0).select("row.row.*")
    cut = cut_spans(F.col("row.row.text"), F.col("spans"))
    return hits.select("row.row.*", cut.alias("_cut")).select(*[F.col("_cut").alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])


def op7_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "row.doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
