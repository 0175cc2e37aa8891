"""The extraction against texts that the pages were made from, and its parts against plain versions."""

import random
import re
from collections import Counter, defaultdict
from html import escape, unescape

import pytest
from pyspark.sql import functions as F

from quillwork.llm import html_templates
from quillwork.llm.html_blocks import Page
from quillwork.llm.html_templates import WHOLE, Template, candidates, extract, hot_hosts, op11_template_extraction, orders_of, slots_of, stored

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n))


def results(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_query_against_pattern(spark):
    """The pages of the table have one article each, whose blocks a pattern can find."""
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"]).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n".join(b for b in blocks if b)
        want[r["page_id"]] = (r["url"], text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in op11_template_extraction(spark, FOLDER).collect()}
    assert got == want


def site(rng, n, marked):
    """Pages of one site whose frame has no telling names; their articles."""
    out = []
    for i in range(n):
        paragraphs = [words(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{escape(p)} &amp; {i}" for p in paragraphs)
        links = "".join(f'<li><a href="/{k}">{words(rng, 2)}</a>' for k in range(5))
        body = f"<article>{body}</article>" if marked else f"<div class=c>{body}</div>"
        html = f"<html><body><div id=t><div>The Site of Things</div></div><div class=x><ul>{links}</ul></div>{body}<div class=z>All rights with the makers</div></body></html>"
        out.append((html, "\n".join(f"{p} & {i}" for p in paragraphs)))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_sites_without_marks(spark, monkeypatch, broadcast):
    """Frames go by the template alone: repeated texts by their classes, link lists by their slots."""
    if not broadcast:
        monkeypatch.setattr(html_templates, "MAX_BROADCAST", 0)
    rng = random.Random(1)
    rows, want = [], {}
    for host, n, marked in (("a.example", 40, False), ("b.example", 12, True), ("c.example", 4, False)):
        for html, text in site(rng, n, marked):
            want[len(rows)] = text
            rows.append((len(rows), f"http://{host}/{len(rows)}", html))
    assert results(extract(spark.createDataFrame(rows, PAGES).repartition(3))) == want


def test_pages_without_marks_learn_from_marked_ones(spark):
    """An aside without a telling name goes where marked pages of the host have it outside of their articles."""
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(30):
        text, aside = words(rng, 20), words(rng, 20)
        tag = "div" if i % 10 == 0 else "article"
        rows.append((i, "http://h.example/", f"<body><div class=q><p>{aside}</p></div><{tag}><p>{text}</p></{tag}></body>"))
        want[i] = text
    assert results(extract(spark.createDataFrame(rows, PAGES))) == want


def test_repeated_articles_stay(spark):
    same = "<body><nav>Go</nav><article><h1>One</h1><p>The same text on all pages</p></article></body>"
    plain = "<body><div><p>The same plain text on all pages</p></div></body>"
    rows = [(i, f"http://h.example/{i}", same) for i in range(9)] + [(20 + i, f"http://g.example/{i}", plain) for i in range(9)]
    got = results(extract(spark.createDataFrame(rows, PAGES)))
    assert {got[i] for i in range(9)} == {"One\nThe same text on all pages"}
    assert {got[20 + i] for i in range(9)} == {"The same plain text on all pages"}


def test_vectors_against_plain_counts(spark):
    """Tokens are of one class just where their counts are the same on every distinct page."""
    rng = random.Random(3)
    rows = [(i, "http://h.example/", html) for i, (html, _) in enumerate(site(rng, 25, False))]
    rows += rows[:5]
    slim = spark.createDataFrame(rows, PAGES).select(F.lit("h").alias("host"), "html")
    sequences = stored(slim.mapInArrow(html_templates._scanning, html_templates.SEQUENCES))
    got = defaultdict(set)
    for r in candidates(sequences, hot_hosts(sequences)).collect():
        got[r["class"]].add(r["token"])
    distinct = sorted({h for _, _, h in rows})
    vectors = defaultdict(lambda: [0] * len(distinct))
    text = {}
    for k, html in enumerate(distinct):
        for e in Page(html).events:
            vectors[e.token][k] += 1
            text[e.token] = e.kind == 2
    want = defaultdict(set)
    for t, v in vectors.items():
        if sum(map(bool, v)) >= max(3, (0.5 if text[t] else 0.1) * len(distinct)):
            want[tuple(v)].add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def template(**classes):
    tokens = {ord(t): ord(c) for c, ts in classes.items() for t in ts}
    return Template(tokens, Counter(tokens.values()), {ord(c): (len(ts), ord(c)) for c, ts in classes.items()})


def test_nested_slots_orders_and_crossing():
    t = template(A="abc", B="xy")
    slots, crossing = slots_of([ord(c) for c in "1a2x3y4xy5b6c7"], t)
    at = dict(zip("1234567", [s for c, s in zip("1a2x3y4xy5b6c7", slots) if c.isdigit()]))
    assert at == {"1": WHOLE, "2": ord("a"), "3": ord("x"), "4": ord("a"), "5": ord("a"), "6": ord("b"), "7": WHOLE} and not crossing
    assert slots_of([ord(c) for c in "axbyc"], t)[1] == {ord("B")}
    same, other, broken = (orders_of([ord(c) for c in s], t)[ord("B")] for s in ("x1yxy", "yx", "xxyy"))
    assert same == orders_of([ord("x"), ord("y")], t)[ord("B")] != other and broken is None


def test_hot_host_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(html_templates, "HOT_SHARE", 0.1)
    rows = spark.range(100).select(F.when(F.col("id") < 70, "big").otherwise(F.concat(F.lit("h"), "id")).alias("host"), "id")
    hot = hot_hosts(rows)
    assert [tuple(r) for r in hot.collect()] == [("big", 7)]
    per = rows.groupBy("host").agg(F.max("id").alias("most"))
    got = html_templates.beside(rows, per, hot, F.col("id"))
    assert sorted((r["host"], r["id"], r["most"]) for r in got.collect()) == sorted((r["host"], r["id"], 69 if r["host"] == "big" else r["id"]) for r in rows.collect())


def test_odd_pages(spark):
    long = "<article>" + "<p>some words &lt;here&gt;</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "no host", "just text"), (4, "http://x.example", "<p>a<p>b<script>c"), (4, "http://x.example", "<p>a<p>b<script>c"), (None, None, "<<<>&&amp;"), (5, "http://x.example", long)]
    df = spark.createDataFrame(rows, PAGES)
    for c in ("host", "token", "tokens", "slot", "class", "salt", "odd.name"):
        df = df.withColumn(c, F.lit("own"))
    got = sorted(((r["page_id"], r["text"]) for r in extract(df).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "just text"), (4, "a\nb"), (4, "a\nb"), (5, "\n".join(["some words <here>"] * 50_000)), (None, "<<<>&&")]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], PAGES)).collect() == []
