import random
import re

from pyspark.sql import functions as F

from quillwork.llm import line_dedup
from quillwork.llm.line_dedup import dedup_lines, drop_repeated_lines

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def normal(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line).strip(WS)


def shingles(s):
    return {s[i : i + 5] for i in range(len(s) - 4)} if len(s) > 5 else {s}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def brute(rows):
    """rows of distinct (doc_id, text): doc_id to the text without repeated and similar lines."""
    rows = sorted(rows)
    lines = [(i, p, normal(s)) for i, t in rows for p, s in enumerate(t.split("\n")) if normal(s)]
    kinds = list(dict.fromkeys(s for _, _, s in lines))
    root = {s: s for s in kinds}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            if jaccard(x, y) >= 0.8:
                root[find(x)] = find(y)
    seen, kept = set(), set()
    for i, p, s in lines:
        if find(s) not in seen:
            seen.add(find(s))
            kept.add((i, p))
    return {i: "\n".join(s for p, s in enumerate(t.split("\n")) if (i, p) in kept or not normal(s)) for i, t in rows}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(3, 9))) for _ in range(n))


def corpus(rng, families, docs):
    lines = []
    for _ in range(families):
        base = sentence(rng, 40).split()
        lines.append(" ".join(base))
        for _ in range(3):  # one word changed: similarity of about 0.93
            new = list(base)
            new[rng.randrange(len(new))] = sentence(rng, 1)
            lines.append(" ".join(new))
    lines += [sentence(rng, rng.randint(5, 30)) for _ in range(40)] + ["", "  ", "x", "Yes.", "yes. "]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(docs)]


def missed(spark, pairs):
    """How many of the pairs of lines share no band."""
    df = spark.createDataFrame(pairs, "a string, b string")
    both = line_dedup.with_bands(line_dedup.with_bands(df, "a").withColumnRenamed("bands", "bands_a"), "b")
    return both.where(~F.arrays_overlap("bands_a", "bands")).count()


def results(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_against_brute_force(make_docs):
    rows = corpus(random.Random(5), 12, 60)
    assert results(dedup_lines(make_docs(rows))) == brute(rows)


def test_crowded_buckets_lose_no_link(make_docs, monkeypatch):
    """Variants that drift away from each other, so that no leader accounts for all links."""
    monkeypatch.setattr(line_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 8)
    rng = random.Random(9)
    words, rows = sentence(rng, 40).split(), []
    for i in range(40):
        words[i % len(words)] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    assert results(dedup_lines(make_docs(rows))) == brute(rows)


def test_recall_near_the_limit(spark):
    rng, pairs = random.Random(2), []
    while len(pairs) < 300:
        base = sentence(rng, rng.randint(20, 60)).split()
        new = list(base)
        while jaccard(" ".join(base), " ".join(new)) > 0.86:
            new[rng.randrange(len(new))] = sentence(rng, 1)
        if jaccard(" ".join(base), " ".join(new)) >= 0.8:
            pairs.append((" ".join(base), " ".join(new)))
    assert len(pairs) - missed(spark, pairs) >= 0.97 * len(pairs)


def test_odd_rows(make_docs, odd_rows, clashing):
    df = clashing(make_docs(odd_rows))
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "_line_counts"]
    got = sorted((r["doc_id"] or 0, r["text"], r["_line_counts"]["n_kept"]) for r in out.collect() if r["text"] is not None)
    assert len(got) == len(odd_rows) - 2
    assert [x for x in got if x[0] == 4] == [(4, "", 0), (4, "same text here", 1)]
    assert [x[2] for x in got if x[0] in (5, 6)] == [1, 0]
    assert [x[1] for x in got if x[0] == 3] == [" \n\t\n"]


def test_documents_that_lose_all_lines_go(make_docs):
    out = drop_repeated_lines(make_docs([(1, "a line of text"), (2, "A line of text "), (3, ""), (4, None), (5, "a line of text\nmore")]))
    assert results(out) == {1: "a line of text", 3: "", 4: None, 5: "more"}


def test_empty_table(make_docs):
    assert dedup_lines(make_docs([])).count() == 0


def test_texts_are_shuffled_once(spark, make_docs):
    """The join with the lines that stay and the numbering of equal rows share one exchange."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        out = dedup_lines(spark.createDataFrame([(1, "one line"), (1, "one line"), (None, "two"), (None, "three")], "doc_id long, text string"))
        kept = sorted((r["doc_id"] or 0, r["text"], r["_line_counts"]["n_kept"]) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert kept == [(0, "three", 1), (0, "two", 1), (1, "", 0), (1, "one line", 1)]
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(r#", final)) == 2  # the texts, the lines that stay
