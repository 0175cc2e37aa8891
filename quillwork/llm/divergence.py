"""Quality rules: distribution divergence from language references.

A document passes the base rules (enough words, few repeated three-word windows) and then its
histograms of character classes and of common words are held against the reference of its
language by Jensen-Shannon distance. References are pooled counts over every document that is
long enough. One scan measures every document; no text is shuffled. Only the pooled counts, at
most one row per known language and one for all others, reach the driver.

Defined results: a null or empty text has no words and fails the base rules; an unknown or
null language uses the character pool of all unknown languages and no word histogram; a language without a pool, and a text
under the length guards, is judged by the base rules alone. Repeated rows are judged alike,
and further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import durable, let, space_words, stored, table

#: Common words of each language, the bins of the word histogram.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "den", "von", "das", "zu", "mit", "sich", "des", "auf", "ist"],
    "fr": ["le", "et", "les", "un", "du", "une", "pour", "par", "dans", "qui", "pas", "sur"],
    "es": ["que", "el", "en", "y", "los", "se", "las", "del", "por", "con", "no", "para"],
}
LANGS = list(COMMON)
#: Character classes beside white space (before them) and all other characters (after them).
CLASSES = {
    "symbol": "[#*$%&|<>]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "punct": r"[.,;:!?'\"()-]+",
    "non_ascii": r"[^\x00-\x7F]+",
}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Length guards: shorter texts have histograms too thin to compare.
MIN_CHARS = 250
MIN_COMMON_WORDS = 150
#: Jensen-Shannon distances (base 2, 0 to 1) from which a document is rejected.
MAX_CHAR_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.24


def _class_counts(text: Column, words: Column) -> Column:
    """Characters of each class, lower-case letters (what is left of the text) last."""

    def count(joined: Column) -> Column:
        """joined: the text without white space."""
        n = F.length(joined)
        rare = F.array(*[n - F.length(F.regexp_replace(joined, p, "")) for p in CLASSES.values()])
        return let(rare, lambda r: F.concat(F.array(F.length(text) - n), r, F.array(F.aggregate(r, n, lambda s, x: s - x))))

    return let(F.array_join(words, ""), count).cast("array<bigint>")


def _word_counts(words: Column, lang: Column) -> Column:
    """Occurrences of each common word of the language, then of all other words.

    Null for a language without a list.
    """

    def counts(hits: Column, names: list[str]) -> Column:
        per_word = [F.size(hits) - F.size(F.array_remove(hits, w)) for w in names]
        return F.array(*[c.cast("long") for c in [*per_word, F.size(words) - F.size(hits)]])

    def of(names: list[str]) -> Column:
        return let(F.filter(words, lambda w: w.isin(*names)), lambda hits: counts(hits, names))

    out = F.lit(None).cast("array<bigint>")
    for name, names in COMMON.items():
        out = F.when(lang == name, of(names)).otherwise(out)
    return out


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Few distinct repeated windows are looked up in a
    short list; a text with many sorts its windows instead.
    """

    def covered(starts: Column) -> Column:
        """starts: ascending first positions of repeated windows; each covers three words."""
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    def by_list(windows: Column, again: Column) -> Column:
        at = F.transform(windows, lambda h, i: F.when(F.array_contains(again, h), i))
        return covered(F.array_compact(at))

    def by_sort(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: covered(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def repeated(windows: Column) -> Column:
        again = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j + 1))))
        return let(again, lambda d: F.when(F.size(d) <= 32, by_list(windows, d)).otherwise(by_sort(windows)))

    def triples(h: Column) -> Column:
        """One hash per window: of its first two words, then with the third."""
        n = F.size(h)
        two = F.zip_with(F.slice(h, F.lit(1), n - 2), F.slice(h, F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(h, F.lit(3), n - 2), lambda a, b: F.xxhash64(a, b))

    found = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            triples(h),
            lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(repeated(t)),
        ),
    )
    return F.when(F.size(words) >= 4, found).otherwise(F.lit(0)).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long"))


def _bucket(lang: Column) -> Column:
    return F.when(lang.isin(*LANGS), lang).otherwise(F.lit(""))


def measure(docs: DataFrame) -> DataFrame:
    """docs with a struct column ``measured``: the base counts and both histograms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = _bucket(F.col("lang"))
    words = F.col("_words")
    out = docs.withColumn("_words", space_words(text)).withColumn("_chars", _class_counts(text, words))
    chars = F.col("_chars")
    fields = F.struct(
        lang.alias("lang"),
        F.size(words).cast("long").alias("n_words"),
        (F.length(text) - chars[0]).cast("long").alias("word_chars"),
        chars[1].alias("n_symbols"),
        _dup_lines(text).alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        chars.alias("chars"),
        _word_counts(words, lang).alias("words"),
    )
    return out.withColumn("measured", fields).drop("_words", "_chars")


def references(measured: DataFrame, min_words: int = MIN_WORDS) -> dict[str, dict[str, list[int]]]:
    """Pooled counts by language over every measured document of min_words words or more.

    At most one entry per known language and one for the others, so the size is fixed.
    """
    slim = measured.where(F.col("measured.n_words") >= min_words)
    pools: dict[str, dict[str, list[int]]] = {}
    for kind, size in (("chars", len(CLASSES) + 2), ("words", 1 + max(map(len, COMMON.values())))):
        bins = slim.select(F.col("measured.lang").alias("lang"), F.posexplode(f"measured.{kind}").alias("bin", "n"))
        for row in bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
            pools.setdefault(row["lang"], {}).setdefault(kind, [0] * size)[row["bin"]] = row["n"]
    return pools


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms; null where either is empty."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(np: Column, nq: Column) -> Column:
        terms = F.zip_with(
            counts,
            reference,
            lambda c, r: (part(c / np, (c / np + r / nq) / 2) + part(r / nq, (c / np + r / nq) / 2)) / 2,
        )
        return F.sqrt(F.greatest(total(terms), F.lit(0.0)))

    return F.when(
        (F.coalesce(total(counts), F.lit(0.0)) > 0) & (F.coalesce(total(reference), F.lit(0.0)) > 0),
        let(total(counts), lambda np: let(total(reference), lambda nq: divergence(np, nq))),
    )


def _reference(pools: dict, kind: str, lang: Column) -> Column:
    out = F.lit(None).cast("array<bigint>")
    for name, pool in pools.items():
        if kind in pool:
            out = F.when(lang == name, F.array(*[F.lit(int(v)).cast("bigint") for v in pool[kind]])).otherwise(out)
    return out


def judge(
    measured: DataFrame,
    pools: dict,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """measured documents with base_failed, char_distance, word_distance and kept added."""
    m = F.col("measured")
    n, lang = m["n_words"], m["lang"]
    char_distance = F.when(m["word_chars"] >= MIN_CHARS, js_distance(m["chars"], _reference(pools, "chars", lang)))
    word_distance = F.when(n >= MIN_COMMON_WORDS, js_distance(m["words"], _reference(pools, "words", lang)))
    failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= max_char_distance) & (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) <= max_word_distance
    )
    return (
        measured.withColumn("char_distance", F.round(char_distance, 6))
        .withColumn("word_distance", F.round(word_distance, 6))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & near)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang")
    measured = stored(measure(row).select("row", "measured"))
    return judge(measured, references(measured)).where("kept").select("row.*")


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = durable(measure(docs).select("doc_id", "measured"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(measured, references(measured)).select(
        "doc_id", *[f"measured.{c}" for c in names], "base_failed", "kept", "char_distance", "word_distance"
    )
