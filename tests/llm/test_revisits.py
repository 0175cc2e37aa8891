import random

import pytest
from pyspark.sql import functions as F

from quillwork.llm.revisits import PERMITTED, canonical, resolve

RECORDS = "record_id long, url string, ts long, kind string, digest string, headers array<struct<name:string,value:string>>"


def test_canonical(spark):
    cases = [
        ("http://A.com/x/#t", "http://a.com/x"), ("https://www.a.com:443/x?b=2&a=1", "http://a.com/x?a=1&b=2"), ("http://a.com/x?utm_source=q&ref=z", "http://a.com/x"),
        ("HTTP://u:p@a.com", "http://a.com"), ("http://a.com/X", "http://a.com/X"), ("http://a.com:8080/?refer=1", "http://a.com:8080?refer=1"), (None, None), ("", None), ("a.com/x", None), ("http://", None),
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "url string").select("url", canonical(F.col("url")).alias("c"))
    got = {r["url"]: r["c"] for r in df.collect()}
    assert got == dict(cases)


def plain_headers(h):
    return {n.lower(): v for n, v in h or [] if n is not None}


def brute(records):
    out = []
    for i, url, ts, kind, digest, h in records:
        mine, when = plain_headers(h), (ts is not None, ts or 0, i)
        row = [i, kind == "response" and "response" or "no_response", None, digest, mine]
        if kind != "response" and url is not None:
            earlier = [r for r in records if r[1] == url and r[3] == "response" and (r[2] is not None, r[2] or 0, r[0]) < when]
            if earlier:
                r = max(earlier, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
                old = plain_headers(r[5])
                pair = [(mine.get(k), old.get(k)) for k in ("etag", "last-modified")]
                known = [(a, b) for a, b in pair if a is not None and b is not None]
                same = known and known[0][0].removeprefix("W/") == known[0][1].removeprefix("W/")
                row[1] = "no_validator" if not known else "resolved" if same else "validator_mismatch"
                if row[1] == "resolved":
                    row[2:] = [r[0], r[4], old | {k: v for k, v in mine.items() if k in PERMITTED and v is not None}]
        out.append(row)
    return sorted(out, key=str)


@pytest.fixture
def records():
    rng, out = random.Random(12), []
    urls = ["http://hot.com/a"] * 6 + ["http://b.com/%d" % i for i in range(5)] + [None]
    for i in range(400):
        tag, day = rng.choice(["x", "W/x", "y", None]), rng.choice(["d1", "d2", None])
        h = [(n, v) for n, v in (("ETag", tag), ("Last-Modified", day), ("Content-Length", str(i)), ("DATE", "t%d" % i)) if v is not None]
        out.append((i, rng.choice(urls), rng.choice([None, *range(60)]), rng.choice(["response", "revisit"]), "g%d" % i, rng.choice([h, h, h, None])))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_against_brute_force(spark, records, partitions):
    """Seven ranges, so that the busy URL is carried from one into others."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resolve(spark.createDataFrame(records, RECORDS).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([[r["record_id"], r["status"], r["response_id"], r["digest"], r["headers"]] for r in got], key=str) == brute(records)


def test_edges(spark):
    assert resolve(spark.createDataFrame([], RECORDS)).count() == 0
    twice = [("etag", "a"), ("ETag", "b"), (None, "c")]
    rows = [(1, "http://a.com", 1, "response", "g", [("etag", "b")]), (2, "http://a.com", 2, "revisit", None, twice), (2, "http://a.com", 2, "revisit", None, twice)]
    got = resolve(spark.createDataFrame(rows, RECORDS).withColumn("range", F.lit(1)).withColumn("found", F.lit(1))).where("record_id = 2").collect()
    assert [(r["status"], r["headers"]) for r in got] == [("resolved", {"etag": "b"})] * 2
