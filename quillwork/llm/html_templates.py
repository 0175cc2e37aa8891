"""Main text of web pages by the template that the pages of a host share.

A page is a sequence of element starts, element ends and text blocks (html_blocks). For every
token of a host its occurrence vector says how often it stands in each distinct page; tokens of
equal vectors form an equivalence class. A class is valid if its tokens keep one order on every
page, repeated as a whole, and if it doesn't cross another class; valid classes nest into the
host's template. What stands after a template token, outside of classes nested there, is a slot.
A slot is the article's unless what pages with a marked article say of it, or its links, speak
against it; a block stays if its slot is the article's and the page's own marks agree.

At scale: pages are scanned twice, once for the slim token sequences that are written, once for
the texts, which never pass an exchange unless the templates are too many to broadcast. Vectors
are sums of hashes, so no list of pages is built. A token of the template has to stand on a tenth
of its host's pages, so a template is at most ten pages long on the average, whatever the number of
pages; hosts with many pages are dealt out by salts.

Defined results: a null or empty html gives an empty text. A null url, or one without a host,
belongs to the host "". Copies of a page count once in the vectors, and each gets its text. A
host of fewer than MIN_PAGES distinct pages has no template: its pages are one slot each. Extra
columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, OrderedDict, defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from quillwork.llm.common import stored, table
from quillwork.llm.html_blocks import MAIN, TEXT, Page, signed
from quillwork.llm.url_trust import host_of

MIN_PAGES = 3
#: Least share of a host's pages that a tag of the template stands on, and a text.
TAG_SUPPORT, TEXT_SUPPORT = 0.1, 0.5
#: Template tokens and slots of all hosts that may be broadcast; beyond it pages are dealt by host.
MAX_BROADCAST = 500_000
#: A host with more than this share of the pages is dealt out to several groups.
HOT_SHARE = 0.001
#: Templates that a task keeps at hand.
KEPT_TEMPLATES = 256

SEQUENCES = "page_key long, tokens array<long>, texts array<boolean>, main array<int>, free array<int>, linked array<int>, marked boolean, host string"
VERDICTS = "host string, class long, least long, most long, crossed boolean"
SLOTS = "host string, slot long, main long, outside long, free long, linked long"
#: The slot of what stands in no template token.
WHOLE = 0


class Template(NamedTuple):
    """Class by token, and of each class its size and its rank, by which the weaker of two that cross is found."""

    classes: dict[int, int]
    sizes: Counter[int]
    rank: dict[int, tuple[int, int]]


def template_of(entries: Sequence[dict]) -> Template:
    classes = {e["token"]: e["class"] for e in entries}
    sizes = Counter(classes.values())
    classes = {t: c for t, c in classes.items() if sizes[c] > 1}
    return Template(classes, sizes, {e["class"]: (e["support"], e["class"]) for e in entries})


def slots_of(tokens: Sequence[int], template: Template) -> tuple[list[int], set[int]]:
    """The slot of each token of a page, and classes that cross a stronger one there."""
    out, crossing = [], set()
    open_classes: list[list[int]] = []  # class, tokens of it still to come, slot
    inside: Counter[int] = Counter()
    for t in tokens:
        c = template.classes.get(t)
        if c is not None:
            if inside[c]:
                while open_classes[-1][0] != c:
                    other = open_classes.pop()[0]
                    inside[other] -= 1
                    crossing.add(min(c, other, key=template.rank.__getitem__))
                top = open_classes[-1]
                top[1] -= 1
                top[2] = t
                if not top[1]:
                    open_classes.pop()
                    inside[c] -= 1
            else:
                open_classes.append([c, template.sizes[c] - 1, t])
                inside[c] += 1
        out.append(open_classes[-1][2] if open_classes else WHOLE)
    return out, crossing


def orders_of(tokens: Sequence[int], template: Template) -> dict[int, int | None]:
    """By class the hash of its tokens' order on a page; None where the class isn't repeated as a whole."""
    found: dict[int, list[int]] = defaultdict(list)
    for t in tokens:
        if (c := template.classes.get(t)) is not None:
            found[c].append(t)
    out: dict[int, int | None] = {}
    for c, order in found.items():
        unit = order[: template.sizes[c]]
        whole = len(order) % len(unit) == 0 and unit * (len(order) // len(unit)) == order
        out[c] = signed(xxh3_64_intdigest(b"".join(t.to_bytes(8, "little", signed=True) for t in unit))) if whole else None
    return out


class _Templates:
    """Templates by host, the latest of a task."""

    def __init__(self) -> None:
        self._kept: OrderedDict[str, Template] = OrderedDict()

    def of(self, host: str, entries: pa.Scalar) -> Template:
        if host not in self._kept:
            self._kept[host] = template_of(entries.as_py() or [])
            if len(self._kept) > KEPT_TEMPLATES:
                self._kept.popitem(last=False)
        self._kept.move_to_end(host)
        return self._kept[host]


def _arrow(schema: str, rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = [field.split(" ") for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, _TYPES[kind]) for values, (_, kind) in zip(zip(*rows), columns)], [name for name, _ in columns])


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}


def _scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slim sequence of each page: tokens, and the lengths of blocks by their marks."""
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host"), batch.column("html")):
            html = html.as_py() or ""
            page = Page(html)
            es = page.events
            key = signed(xxh3_64_intdigest(html.encode("utf-8", "surrogatepass")))
            main = [len(e.text) if e.mark == MAIN else 0 for e in es]
            free = [len(e.text) - m for e, m in zip(es, main)]
            # a text of the article is never one of the template
            plain = [e.kind == TEXT and e.mark != MAIN for e in es]
            tokens = [0 if e.kind == TEXT and e.mark == MAIN else e.token for e in es]
            rows.append((key, tokens, plain, main, free, [e.n_link for e in es], page.marked > 0, host.as_py()))
        if rows:
            yield _arrow(SEQUENCES, rows)


def _judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest order of each class, and whether it crosses another, over a batch's pages."""
    templates = _Templates()
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for host, tokens, entries in zip(batch.column("host"), batch.column("tokens"), batch.column("template")):
            host, tokens = host.as_py(), tokens.as_py()
            template = templates.of(host, entries)
            _, crossing = slots_of(tokens, template)
            for c, order in orders_of(tokens, template).items():
                bad = order is None or c in crossing
                order = order or 0
                at = found.setdefault((host, c), [order, order, False])
                at[0], at[1], at[2] = min(at[0], order), max(at[1], order), at[2] or bad
        if found:
            yield _arrow(VERDICTS, [(*k, *v) for k, v in found.items()])


def _weighing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slot the characters of marked articles, of what lies outside them, of pages without marks, and of links there."""
    templates = _Templates()
    for batch in batches:
        found: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        names = ("host", "tokens", "template", "main", "free", "linked", "marked")
        for host, tokens, entries, main, free, linked, marked in zip(*map(batch.column, names)):
            host, tokens, marked = host.as_py(), tokens.as_py(), marked.as_py()
            template = templates.of(host, entries)
            slots, _ = slots_of(tokens, template)
            for t, slot, m, f, n in zip(tokens, slots, main.as_py(), free.as_py(), linked.as_py()):
                if (m or f) and t not in template.classes:
                    at = found[host, slot]
                    at[0] += m
                    if marked:
                        at[1] += f
                    else:
                        at[2] += f
                        at[3] += n
        if found:
            yield _arrow(SLOTS, [(*k, *v) for k, v in found.items()])


def main_text(page: Page, template: Template, foreign: set[int]) -> str:
    """The blocks of the article's slots, in page order; foreign: slots that aren't the article's."""
    tokens = [0 if e.kind == TEXT and e.mark == MAIN else e.token for e in page.events]
    slots, _ = slots_of(tokens, template)
    out = []
    for e, t, slot in zip(page.events, tokens, slots):
        if e.kind == TEXT and t not in template.classes and (e.mark == MAIN if page.marked else slot not in foreign):
            out.append(e.text)
    return "\n".join(out)


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = _Templates()
    for batch in batches:
        texts = []
        for host, html, entries, foreign in zip(*map(batch.column, ("host", "html", "template", "foreign"))):
            texts.append(main_text(Page(html.as_py() or ""), templates.of(host.as_py(), entries), set(foreign.as_py() or ())))
        lengths = pa.array([len(t) for t in texts], pa.int64())
        texts = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts, lengths], ["page_id", "url", "text", "n_chars"])


def hot_hosts(sequences: DataFrame) -> DataFrame:
    """(host, salts) for hosts of more than HOT_SHARE of the pages: at most 1 / HOT_SHARE rows."""
    counts = sequences.groupBy("host").agg(F.count("*").alias("n"))
    n = sequences.count()
    return stored(counts.where(F.col("n") > F.lit(HOT_SHARE) * n).select("host", F.ceil(F.col("n") / (F.lit(HOT_SHARE) * max(n, 1))).cast("int").alias("salts")))


def beside(rows: DataFrame, per_host: DataFrame, hot: DataFrame, by: Column) -> DataFrame:
    """rows with the columns of per_host (a row per host), null where it has none; hot hosts' rows are dealt by the hash of by."""
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    copies = per_host.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copies, ["host", "salt"], "left").drop("salt")


def candidates(sequences: DataFrame, hot: DataFrame) -> DataFrame:
    """(host, token, class, support): the tokens with enough support, and their equivalence classes.

    Two sums of hashes over distinct pages stand for an occurrence vector, with the number of
    pages and of occurrences.
    """
    distinct = sequences.dropDuplicates(["host", "page_key"])
    # token 0, a text of an article, stands for the page itself: its support is the host's number of pages
    pairs = distinct.select("host", "page_key", F.explode(F.arrays_zip("tokens", "texts")).alias("e")).select("host", "page_key", "e.tokens", "e.texts").where("tokens != 0")
    pages = distinct.select("host", "page_key", F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("texts"))
    # all tokens of a page are in one partition before and after, so this is one exchange with the next
    counted = pairs.union(pages).groupBy("host", "tokens", "page_key").agg(F.count("*").alias("n"), F.max("texts").alias("text"))
    part = lambda seed: F.sum(F.pmod(F.xxhash64("page_key", "n", F.lit(seed)), F.lit(1 << 31)))
    vectors = counted.groupBy("host", F.col("tokens").alias("token")).agg(
        part(1).alias("a"), part(2).alias("b"), F.count("*").alias("support"), F.sum("n").alias("n"), F.max("text").alias("text")
    )
    vectors = stored(vectors.where(F.col("support") >= MIN_PAGES))
    totals = vectors.where("token = 0").select("host", F.col("support").alias("pages"))
    share = F.when(F.col("text"), TEXT_SUPPORT).otherwise(TAG_SUPPORT)
    kept = beside(vectors.where("token != 0"), totals, hot, F.col("token")).where(F.col("support") >= share * F.col("pages"))
    return kept.select("host", "token", F.xxhash64("a", "b", "support", "n").alias("class"), "support")


def per_host(entries: DataFrame) -> DataFrame:
    """(host, template): a bounded list per host, see TAG_SUPPORT."""
    return entries.groupBy("host").agg(F.collect_list(F.struct("token", "class", "support")).alias("template"))


def valid_classes(sequences: DataFrame, entries: DataFrame, attach: Callable[[DataFrame, DataFrame, Column], DataFrame]) -> DataFrame:
    """The entries of classes that keep one order on all pages and cross no stronger class."""
    judged = attach(sequences.select("host", "page_key", "tokens"), per_host(entries), F.col("page_key")).select("host", "tokens", "template").mapInArrow(_judging, VERDICTS)
    bad = judged.groupBy("host", "class").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("crossed").alias("crossed"))
    bad = bad.where("crossed or least != most").select("host", "class")
    return entries.join(bad, ["host", "class"], "left_anti")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    slim = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    sequences = stored(slim.select("host", "html").mapInArrow(_scanning, SEQUENCES))
    hot = hot_hosts(sequences)
    entries = stored(candidates(sequences, hot))
    few = entries.count() <= MAX_BROADCAST

    def attach(rows: DataFrame, templates: DataFrame, by: Column) -> DataFrame:
        return rows.join(F.broadcast(templates), "host", "left") if few else beside(rows, templates, hot, by)

    entries = stored(valid_classes(sequences, entries, attach))
    templates = per_host(entries)
    weighed = attach(sequences.drop("texts"), templates, F.col("page_key")).drop("page_key").mapInArrow(_weighing, SLOTS)
    sums = weighed.groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("main", "outside", "free", "linked")))
    foreign = sums.where("outside > main or 2 * linked > free").groupBy("host").agg(F.collect_list("slot").alias("foreign"))
    learned = stored(templates.join(foreign, "host", "full"))
    # hosts without a template have one slot each and may be many
    few = few and learned.count() <= MAX_BROADCAST
    return attach(slim, learned, F.xxhash64("html")).select("page_id", "url", "html", "host", "template", "foreign").mapInArrow(_extracting, _schema(pages))


def _schema(pages: DataFrame) -> T.StructType:
    return T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def op11_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
