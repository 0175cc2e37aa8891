"""WARC: resolution of not-modified revisits.

A revisit record with a not-modified answer has no body; it stands for the latest earlier full
response of the same canonical URL. An as-of join finds that response, the validators of both
are held against each other, and the headers that a not-modified answer may update are merged
over those of the response.

The join is a sort: records are dealt out by range of (URL, time, record), so the captures of a
busy URL spread over as many tasks as their number asks for. Inside a range a window carries the
latest response forward; the last response of each URL in each range, a row per URL and range,
carries it on into later ranges. Bodies aren't shuffled: a resolved record names the response.

Defined results: captures of equal time are taken by record_id; a response doesn't serve a
revisit before it. An entity tag on both sides decides (weakly compared); else Last-Modified on
both sides does; without either the record is unresolved, status ``no_validator``. Other statuses:
``resolved``, ``no_response`` (nothing earlier), ``validator_mismatch``; a full response itself is
``response``. A null URL has no canonical form and is never resolved; a null time sorts first.
Repeated rows are resolved one by one. Header names compare in lower case; of a name that is
there twice the last value counts, null headers are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import ascii_lower, durable, table

#: Header fields that a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't choose the content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without www. and default port; no fragment, no tracking
    parameters, no slash at the end. Null for a null URL or one without "://"."""
    cut = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = ascii_lower(F.regexp_extract(cut, r"(?s)^([^:/?#]+)://", 1))
    host = ascii_lower(F.regexp_extract(cut, r"(?s)^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(cut, r"(?s)^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(cut, r"(?s)\?(.*)$", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{TRACKING})(?:=|$)")))
    whole = F.concat(F.regexp_replace(scheme, "^https$", "http"), F.lit("://"), host, path)
    return F.when(host != "", F.concat(whole, F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")))


def headers_of(pairs: Column) -> Column:
    """A map of lower-case names to values from an array of (name, value) structs; the last of equals."""
    named = F.transform(F.coalesce(pairs, F.array().cast("array<struct<name:string,value:string>>")), lambda p: F.struct(ascii_lower(p["name"]).alias("name"), p["value"].alias("value")))
    last = F.filter(named, lambda p, i: p["name"].isNotNull() & ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["name"].eqNullSafe(p["name"])))
    return F.map_from_entries(last)


def merged(base: Column, update: Column, permitted: list[str] = PERMITTED) -> Column:
    """base with the permitted fields of update put over it."""
    new = F.map_filter(update, lambda k, v: k.isin(permitted) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(new, k)), new)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, ts, status, response_id, digest, headers) for every record.

    records: (record_id, url, ts, kind, digest, headers), kind being "response" or "revisit" and
    headers an array of (name, value) structs.
    """
    slim = records.select("record_id", canonical(F.col("url")).alias("url"), "ts", "kind", "digest", headers_of(F.col("headers")).alias("headers"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "headers"))
    dealt = slim.withColumn("full", full).repartitionByRange("url", "ts", "record_id").withColumn("range", F.spark_partition_id())
    dealt = durable(dealt)
    earlier = Window.partitionBy("range", "url").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("found", F.last("full", ignorenulls=True).over(earlier))
    ends = dealt.where("full is not null and url is not null").groupBy("url", "range").agg(F.max_by("full", F.struct("ts", "record_id")).alias("last"))
    spans = dealt.where("url is not null").groupBy("url", "range").agg(F.count("*").alias("n"))
    # a row per URL and range at most, so as many per URL as there are ranges
    before = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(ends, ["url", "range"], "left").withColumn("carried", F.last("last", ignorenulls=True).over(before))
    carried = carried.where("carried is not null").select("url", "range", "carried")
    both = inside.join(carried, ["url", "range"], "left").withColumn("found", F.coalesce("found", "carried"))
    mine, old = F.col("headers"), F.col("found.headers")
    tags = mine["etag"].isNotNull() & old["etag"].isNotNull()
    dates = mine["last-modified"].isNotNull() & old["last-modified"].isNotNull()
    status = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("url").isNull() | F.col("found").isNull(), "no_response")
        .when(tags, F.when(_weak(mine["etag"]) == _weak(old["etag"]), "resolved").otherwise("validator_mismatch"))
        .when(dates, F.when(mine["last-modified"] == old["last-modified"], "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id",
        "url",
        "ts",
        "status",
        F.when(ok, F.col("found.record_id")).alias("response_id"),
        F.when(ok, F.col("found.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(ok, merged(old, mine)).otherwise(mine).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records made of pages, which hold no captures of their own.

    Each page is a full response at the time of its page_id, and is asked for again three times:
    a while later with its entity tag, then with another tag, then with its date only. The tag is
    a digest of the body.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    p = F.col("page_id")
    day = F.concat(F.lit("day "), p.cast("string"))

    def record(i: int, kind: str, digest: Column, *headers: Column) -> Column:
        late = F.lit(0) if i == 0 else F.pmod(p * 7, F.lit(50)) * 4 + i
        return F.struct(
            (p * 4 + i).alias("record_id"), "url", (p * 4 + late).alias("ts"), F.lit(kind).alias("kind"), digest.alias("digest"), F.array(*headers).alias("headers")
        )

    none = F.lit(None).cast("string")
    rows = F.array(
        record(0, "response", digest, header("ETag", digest), header("Last-Modified", day), header("Content-Length", F.length("html")), header("Date", p)),
        record(1, "revisit", none, header("etag", F.concat(F.lit("W/"), digest)), header("Date", p + 1), header("Content-Length", F.lit(0))),
        record(2, "revisit", none, header("ETag", F.lit("other")), header("Last-Modified", day)),
        record(3, "revisit", none, header("Last-Modified", day), header("Expires", p + 3)),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op9_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    names = F.array_sort(F.map_keys("headers"))
    listed = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.coalesce(F.col("headers")[k], F.lit("")))), ";")
    return out.select("record_id", "url", "ts", "status", "response_id", "digest", listed.alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, length(html) AS n, regexp_replace(trim(url), '(?s)#.*$', '') AS cut FROM pages),
parts AS (
  SELECT page_id, digest, n,
    regexp_replace(translate(regexp_extract(cut, '(?s)^([^:/?#]+)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^https$', 'http') AS scheme,
    regexp_replace(regexp_replace(translate(regexp_extract(cut, '(?s)^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', ''), ':(?:80|443)?$', '') AS host,
    regexp_replace(regexp_extract(cut, '(?s)^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(cut, '(?s)\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(?:=|$)'))) AS query
  FROM p),
u AS (
  SELECT page_id, digest, n,
    CASE WHEN host <> '' THEN scheme || '://' || host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url
  FROM parts),
r AS (
  SELECT page_id * 4 AS record_id, url, page_id * 4 AS ts, 0 AS i, page_id, digest, n FROM u
  UNION ALL
  SELECT page_id * 4 + i, url, page_id * 4 + (page_id * 7 % 50) * 4 + i, i, page_id, digest, n FROM u, (VALUES (1), (2), (3)) v(i)),
j AS (
  SELECT a.record_id, a.url, a.ts, a.i, a.page_id, a.digest, a.n, b.record_id AS b_id, b.digest AS b_digest, b.page_id AS b_page, b.n AS b_n,
    row_number() OVER (PARTITION BY a.record_id, a.page_id ORDER BY b.ts DESC NULLS LAST, b.record_id DESC) AS nth
  FROM r a LEFT JOIN r b ON a.i > 0 AND b.i = 0 AND a.url = b.url AND (b.ts < a.ts OR (b.ts = a.ts AND b.record_id < a.record_id))),
s AS (
  SELECT *, CASE WHEN i = 0 THEN 'response' WHEN url IS NULL OR b_id IS NULL THEN 'no_response'
    WHEN i = 1 THEN CASE WHEN digest = b_digest THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN i = 2 THEN 'validator_mismatch'
    ELSE CASE WHEN page_id = b_page THEN 'resolved' ELSE 'validator_mismatch' END END AS status
  FROM j WHERE nth = 1)
SELECT record_id, url, ts, status, CASE WHEN status = 'resolved' THEN b_id END AS response_id,
  CASE WHEN status = 'resolved' THEN b_digest WHEN i = 0 THEN digest END AS digest,
  CASE
    WHEN i = 0 THEN 'content-length=' || coalesce(n::VARCHAR, '') || ';date=' || page_id || ';etag=' || digest || ';last-modified=day ' || page_id
    WHEN i = 1 AND status = 'resolved' THEN 'content-length=' || coalesce(b_n::VARCHAR, '') || ';date=' || (page_id + 1) || ';etag=W/' || digest || ';last-modified=day ' || b_page
    WHEN i = 1 THEN 'content-length=0;date=' || (page_id + 1) || ';etag=W/' || digest
    WHEN i = 2 THEN 'etag=other;last-modified=day ' || page_id
    WHEN status = 'resolved' THEN 'content-length=' || coalesce(b_n::VARCHAR, '') || ';date=' || b_page || ';etag=' || b_digest || ';expires=' || (page_id + 3) || ';last-modified=day ' || page_id
    ELSE 'expires=' || (page_id + 3) || ';last-modified=day ' || page_id END AS headers
FROM s
"""
