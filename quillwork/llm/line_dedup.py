"""Fuzzy line deduplication by MinHash.

Lines are compared in their normal form, lower-cased and without outer white space. Equal normal
forms are one line from the start, known by a 128-bit hash. Then:

1. Signatures. All shingles of SHINGLE characters are hashed and sorted; of long lines only those
   that start with every fourth character, where these are ENOUGH. Each band has as many
   minima as it has rows: the smallest hashes from the band's start on the ring of hash values
   (one-permutation MinHash). Long lines have BANDS bands of ROWS rows, so that chance meetings
   stay rare, and SOME_BANDS where only some shingles are hashed; short ones have SHORT_BANDS of SHORT_ROWS from each of two rings. Lines whose
   number of shingles allows partners of both kinds have both.
2. Stars. Every line of a bucket is compared with the bucket's first line, and if that leaves
   several parts of it unlinked, with the last, where the sizes of their shingle sets and a bitmap
   of each allow the similarity; no pair that has it fails these bounds. The cost is linear.
3. The rest. Other lines that these links leave in different parts of a bucket are held against
   each other by the bounds, in buckets of up to WHOLE lines, and only pairs within them are
   verified. What stands in a larger bucket that still has several parts then meets by the rarest of its
   shingles, of which similar lines share at least one: a prefix filter, which is lossless too. So
   no link between lines that share a bucket is lost, whatever its size, unless they are in one
   component already.
4. Verification. Exact Jaccard similarity of the sets of all shingles, each candidate pair once.
5. Distributed union-find over the links; the first line of each component (by doc_id, then row
   and position) stays, in the place where it stands.

Defined results: lines of white space only are layout and always stay; a null text has no lines
and stays null. A null doc_id sorts last. Rows that repeat a doc_id are different documents.
A line no longer than a shingle is its own only shingle. A text may become empty. Of two lines
with the same first half of the hash only one, with the lower second half, is compared with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import connected_components, durable, let, release, stored, table

SIMILARITY = 0.8
SHINGLE = 5
#: Bands of lines of more than SIMILARITY * SHORT shingles, and the minima in each.
BANDS = 10
ROWS = 6
#: Bands from each of two rings for lines of up to SHORT shingles.
SHORT = 64
SHORT_BANDS = 8
SHORT_ROWS = 3
TOP, LEAST = (1 << 63) - 1, -(1 << 63)
#: Of lines with ENOUGH shingles that start with every fourth character, bands hold those only; lines
#: with fewer have bands of all shingles. From FEW to ENOUGH, and up to 2 * SHORT characters, they have both.
SOME = "[" + "".join(f"\\x{c:02x}" for c in range(1, 128, 4)) + "\\x80-\\x{10ffff}]"
FEW, ENOUGH = 40, 64
#: They have more bands, of ROWS minima each, since edits change a varying share of these shingles.
SOME_BANDS = 16
#: Parts of 64 bits of a line's bitmap of shingles.
MAPS = 16
#: Rounds of the union-find between the steps; what they don't join yet is only compared again.
EARLY_ROUNDS = 2
#: Shingles start in pieces of so many characters, which keeps the search for them linear.
PIECE = 16
#: One line in so many is looked at to find keys that hold a share of 1 / HOT_SHARE of the lines,
#: and HOT_LEAST of the lines looked at or more. Rows of such a key are dealt to SALTS groups.
HOT_SAMPLE = 32
HOT_SHARE = 1000
HOT_LEAST = 32
SALTS = 256
#: Which lines of a bucket all its others are compared with.
LEADERS = (F.min, F.max)
#: Open lines of buckets of up to WHOLE are all compared in the bucket by their marks. Those of larger
#: ones meet by rare shingles, across buckets too; open_pairs alone leaves out those of up to CROWD.
CROWD = 64
WHOLE = 2048
#: Bits of the candidates' bitmap for each of them, and at most; a part holds 32,768 bits.
BITS_EACH = 16
MOST_PARTS = 8192
PART_BITS = 1 << 15
#: For comparing distances that were computed by division.
EPSILON = 1e-9
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) == ""


def sample(line: Column) -> Column:
    """Sorted distinct 64-bit hashes of all of a line's shingles, overlapping ones included."""
    wide = PIECE + SHINGLE - 1
    pieces = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE},{wide}}})).{{1,{PIECE}}}"), F.lit(1))

    def at(piece: Column, i: Column | int) -> Column:
        return F.xxhash64(F.substring(piece, i, F.lit(SHINGLE) if isinstance(i, Column) else SHINGLE))

    def hashed(piece: Column) -> Column:
        whole = F.array(*[at(piece, i + 1) for i in range(PIECE)])
        rest = F.transform(F.sequence(F.lit(1), F.length(piece) - (SHINGLE - 1)), lambda i: at(piece, i))
        return F.when(F.length(piece) == wide, whole).otherwise(rest)

    every = F.when(F.length(line) > SHINGLE, F.flatten(F.transform(pieces, hashed))).otherwise(F.array(F.xxhash64(line)))
    return F.sort_array(F.array_distinct(every))


def thinned(line: Column) -> Column:
    """Sorted distinct hashes of those of a line's shingles that start with a character of SOME."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=({SOME}.{{{SHINGLE - 1}}})){SOME}"), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.xxhash64(x))))


def with_bands(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with ``bands``, the band keys of each line, of one kind or of several.

    Each step is a column that the next reads several times, which keeps its work in compiled code.
    """
    none = F.array().cast("array<bigint>")
    text = F.col(line)
    out = lines.withColumn("_some", F.when(F.length(text) > SHORT + SHINGLE - 1, thinned(text)).otherwise(none))
    every = (F.length(text) <= 2 * SHORT) | (F.size("_some") < ENOUGH)
    out = out.withColumn("_h", F.when(every, sample(text)).otherwise(none))
    other = F.transform("_h", lambda h: F.xxhash64(F.lit("again"), h))
    out = out.withColumn("_again", F.when(F.size("_h").between(1, SHORT), F.sort_array(other)))
    long, short = F.size("_h") > int(SIMILARITY * SHORT), F.size("_h").between(1, SHORT)
    rings = [("_h", BANDS, ROWS, long), ("_h", SHORT_BANDS, SHORT_ROWS, short), ("_again", SHORT_BANDS, SHORT_ROWS, short)]
    rings.append(("_some", SOME_BANDS, ROWS, F.size("_some") >= FEW))
    starts = [[F.lit(LEAST + 2 * (TOP // n) * i) for i in range(n)] for _, n, _, _ in rings]
    # the hashes with the starts among them, and the ring on which they go on after the last
    steps = {}
    for k, (h, _, rows, used) in enumerate(rings):
        steps[f"_placed{k}"] = F.when(used, F.sort_array(F.concat(h, F.array(*starts[k]))))
        steps[f"_ring{k}"] = F.when(used, F.concat(h, *[F.slice(h, 1, rows)] * rows))
    out = out.withColumns(steps)
    # how many hashes come before each start
    before = {f"_before{k}": F.when(used, F.array(*[F.array_position(f"_placed{k}", s).cast("int") - 1 - i for i, s in enumerate(starts[k])])) for k, (_, _, _, used) in enumerate(rings)}
    out = out.withColumns(before)

    def keys(k: int, rows: int) -> Column:
        return F.transform(f"_before{k}", lambda p, i: F.xxhash64(F.lit(k), i, *[F.get(f"_ring{k}", p + j) for j in range(rows)]))

    found = [F.when(used, keys(k, rows)).otherwise(none) for k, (_, _, rows, used) in enumerate(rings)]
    return out.select(*[F.col(f"`{c}`") for c in lines.columns], F.array_distinct(F.concat(*found)).alias("bands"))


def with_marks(texts: DataFrame) -> DataFrame:
    """(id, marks) of texts (id, line), one row per id: the number of shingles and their bitmap.

    A bit is set if an odd number of hashes fall on it, so long lines don't fill the map. Each
    hash in one of two samples only changes one bit, so the maps never differ in more bits than
    the samples differ in hashes.
    """
    h = F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8).bitwiseAND(F.lit(63)).cast("int"))
    part = h.bitwiseAND(F.lit(MAPS - 1))
    parts = [F.coalesce(F.bit_xor(F.when(part == i, bit)), F.lit(0).cast("long")) for i in range(MAPS)]
    marks = texts.select("id", F.explode_outer(sample(F.col("line"))).alias("h")).groupBy("id").agg(F.count("*").alias("size"), F.array(*parts).alias("map"))
    return marks.select("id", F.struct("size", "map").alias("marks"))


def identified(docs: DataFrame) -> DataFrame:
    """docs with ``r``, a hash that together with doc_id names a row.

    Rows that agree in both are interchangeable here and told apart only at the end.
    """
    return docs.withColumn("r", F.xxhash64("doc_id", "text"))


def exploded(docs: DataFrame) -> DataFrame:
    """(at, id, check, line): every line that isn't blank, in its normal form.

    at orders lines by doc_id (null last), row and position. id and check are 128 bits of hash.
    """
    lines = docs.select("doc_id", "r", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r", "pos")
    lines = lines.select(at.alias("at"), F.btrim("line", F.lit(BLANK)).alias("line")).where("line != ''")
    return lines.withColumn("id", F.xxhash64("line")).withColumn("check", F.xxhash64(F.lit(1), "line"))


def maybe_similar(x: Column, y: Column, similarity: float) -> Column:
    """Whether lines with these marks can reach the similarity: no pair that does fails this.

    Two sets of Jaccard similarity s or more have sizes of ratio s or more and differ in at most
    (1 - s) / (1 + s) of the sum of their sizes.
    """
    return within(words(x), words(y), similarity)


def words(marks: Column) -> list[Column]:
    """The number of shingles and the parts of the bitmap, none of them null."""
    return [F.coalesce(marks["size"], F.lit(0)), *[F.coalesce(F.get(marks["map"], F.lit(i)), F.lit(0)) for i in range(MAPS)]]


def flat(rows: DataFrame) -> DataFrame:
    """rows with the words of their marks as columns w0, w1, ...: joins compare these in short compiled code."""
    return rows.select(*[c for c in rows.columns if c != "marks"], *[w.alias(f"w{i}") for i, w in enumerate(words(F.col("marks")))])


def flat_words(side: str) -> list[Column]:
    return [F.col(f"{side}.w{i}") for i in range(MAPS + 1)]


def within(x: list[Column], y: list[Column], similarity: float) -> Column:
    sizes = F.least(x[0], y[0]) >= F.lit(similarity - EPSILON) * F.greatest(x[0], y[0])
    differing = sum((F.bit_count(m.bitwiseXOR(n)) for m, n in zip(x[1:], y[1:], strict=True)), F.lit(0))
    return sizes & (differing <= F.lit((1 - similarity) / (1 + similarity) + EPSILON) * (x[0] + y[0]))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b), each once, whose exact Jaccard similarity is high enough. texts: (id, line)."""
    # so many parts stay, since pairs take few bytes and much work
    pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "a", "b").distinct()
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", sample(F.col("line_a")).alias("x"), sample(F.col("line_b")).alias("y"))
    pairs = pairs.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return pairs.where(F.col("both") / (F.col("m") + F.col("n") - F.col("both")) >= similarity - EPSILON).select("a", "b")


def flagged(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """lines with ``there``: true for all whose id is among ids and for few others, by a broadcast bitmap.

    The bitmap grows with the ids up to MOST_PARTS parts of 4 kB; a fuller one flags more lines.
    """
    parts = 1
    while parts < MOST_PARTS and parts * PART_BITS < BITS_EACH * ids.count():
        parts *= 2
    slot = F.pmod(F.xxhash64("id"), F.lit(parts * PART_BITS))
    maps = ids.select(F.floor(slot / PART_BITS).cast("int").alias("part"), (slot % PART_BITS).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    placed = lines.withColumn("part", F.floor(slot / PART_BITS).cast("int")).withColumn("bit", (slot % PART_BITS).cast("int"))
    octet = F.conv(F.hex(F.substring("map", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.call_function("shiftright", octet, F.col("bit") % 8) % 2 == 1, F.lit(False))
    return placed.join(F.broadcast(maps), "part", "left").select(*lines.columns, there.alias("there"))


def distinct_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, check, at, line): each line with its first place, and its text where its id is one of ids."""
    text = F.first(F.when(F.col("there"), F.col("line")), ignorenulls=True)
    once = flagged(lines, ids).groupBy("id", "check").agg(F.min("at").alias("at"), text.alias("line"))
    return stored(once)


def buckets(docs: DataFrame) -> DataFrame:
    """(key, id): the lines that share a band with others, each once. docs as identified gives them.

    Keys that hold a thousandth of the lines or more, as a sample of the documents shows, are dealt
    to SALTS groups each; there are at most a few thousand of them, which are broadcast. Groups of
    others drop out here unless they hold two lines. The sample decides the way, not the result.
    """

    def keyed(some: DataFrame) -> DataFrame:  # outer, since no filter of empty lists may repeat the work; none is empty
        deal = F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")
        lines = exploded(some).select("id", deal.alias("deal"), "line")
        return with_bands(lines).select("id", "deal", F.explode_outer("bands").alias("key"))

    sampled = docs.where(F.pmod("r", F.lit(HOT_SAMPLE)) == 0)
    counts = durable(keyed(sampled).groupBy("key").count())
    least = max(HOT_LEAST, (counts.agg(F.sum("count")).first()[0] or 0) // (BANDS * HOT_SHARE))
    hot = durable(counts.where(F.col("count") >= least).select("key"))
    keys = keyed(docs)
    salt = F.when(F.col("hot"), 1 + F.col("deal")).otherwise(F.lit(0))
    dealt = keys.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left").select("key", salt.alias("salt"), "id")
    group = Window.partitionBy("key", "salt")
    shared = dealt.withColumn("least", F.min("id").over(group)).withColumn("most", F.max("id").over(group))
    return durable(shared.where("salt > 0 or least != most").select("key", "id").distinct())


def similar_lines(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the components of all similar lines that share a bucket.

    members: (key, id), each once. texts: (id, line), one row per line.
    """
    marks = durable(with_marks(texts))
    release(marks)
    parts, links = members.withColumn("part", F.col("id")), None
    for pick in LEADERS:
        lead = parts.groupBy("key").agg(pick(F.struct("id", "part")).alias("lead"), F.min("part").alias("least"), F.max("part").alias("most"))
        led = parts.join(lead.where("least != most").select("key", "lead"), "key")
        stars = led.where("part != lead.part").select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
        found = durable(verified(alike(stars, marks, similarity), texts, similarity))
        del stars
        release(found)
        links = found if links is None else links.union(found)
        roots = connected_components(links, rounds=EARLY_ROUNDS).withColumnRenamed("node", "id")
        # the leader has been compared with all others
        parts = durable(led.where("id != lead.id").select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("part")))
    rest = durable(several(parts))
    small = F.col("n") <= WHOLE
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"))
    found = durable(verified(few_pairs(rest.join(sizes.where(small).select("key"), "key"), marks, similarity), texts, similarity))
    release(found)
    roots = connected_components(links.union(found))
    # all pairs of the others have been held against each other
    large = durable(rest.join(sizes.where(~small).select("key"), "key"))
    if large.isEmpty():
        return roots
    joined = large.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "part").alias("part"))
    found = durable(verified(open_pairs(joined, marks, texts, similarity), texts, similarity))
    release(found)
    return roots if found.isEmpty() else connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))


def once_each(members: DataFrame) -> DataFrame:
    """members (key, id) without keys that hold the same lines as another, by 128 bits of hash."""
    sets = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    return members.join(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def several(members: DataFrame) -> DataFrame:
    """Those rows (key, id, part) whose key has more than one part."""
    keys = members.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least != most").select("key")
    return members.join(keys, "key")


def alike(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose marks allow the similarity."""
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("id").alias(side), F.col("marks").alias(f"marks_{side}")), side)
    return pairs.where(maybe_similar(F.col("marks_a"), F.col("marks_b"), similarity)).select("a", "b")


def open_pairs(members: DataFrame, marks: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the pairs of lines of crowded buckets that may be links between two parts."""
    crowded = members.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("most"))
    crowded = crowded.where((F.col("n") > CROWD) & (F.col("least") != F.col("most"))).select("key")
    return crowded_pairs(members.join(crowded, "key").select("id", "part").distinct(), marks, texts, similarity)


def few_pairs(members: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the same bucket and of different parts whose marks allow the similarity."""
    # so many parts stay, since pairs weigh more than bytes; both sides are the same plan and share them
    every = flat(members.join(marks, "id")).repartition(4 * members.sparkSession.sparkContext.defaultParallelism, "key")
    near = (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & within(flat_words("x"), flat_words("y"), similarity)
    met = every.alias("x").join(every.alias("y"), F.col("x.key") == F.col("y.key")).where(near)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def crowded_pairs(members: DataFrame, marks: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of members (id, part) of different parts that share a rare shingle and whose marks allow the similarity.

    Two sets of similarity s share one of the n - ceil(s * n) + 1 first of each one's n shingles,
    in any order that is the same for all; here the rarest among the members come first. The first
    one that they share leaves enough behind it to reach the overlap that s asks for. The marks
    are compared in the join, so that pairs beyond the bounds give no rows.
    """
    hashes = durable(members.join(texts, "id").select("id", "part", F.explode(sample(F.col("line"))).alias("h")))
    counts = hashes.groupBy("h").agg(F.count("*").alias("n"))
    ranked = hashes.join(counts, "h").groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("all"))
    size = F.size("all")
    first = F.slice("all", F.lit(1), size - F.ceil(F.lit(similarity - EPSILON) * size).cast("int") + 1)
    placed = F.transform(first, lambda s, pos: F.struct(s["n"].alias("n"), s["h"].alias("h"), (size - pos).alias("left")))
    # a shingle of one line only meets no other
    heads = durable(flat(ranked.select("id", "part", F.filter(placed, lambda s: s["n"] > 1).alias("heads")).join(marks, "id")))
    heads = heads.select("*", F.explode("heads").alias("s")).select("*", "s.h", "s.left").drop("heads", "s")
    enough = F.least("x.left", "y.left") >= F.lit(similarity / (1 + similarity) - EPSILON) * (F.col("x.w0") + F.col("y.w0"))
    near = (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & enough & within(flat_words("x"), flat_words("y"), similarity)
    # both sides are the same plan, so they share one exchange
    met = heads.alias("x").join(heads.alias("y"), F.col("x.h") == F.col("y.h")).where(near)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(r, doc_id, kept): for each document with such a line, the positions of its lines that stay."""
    members = buckets(docs)
    release(members)
    members = durable(once_each(members))
    firsts = distinct_lines(exploded(docs), durable(members.select("id").distinct()))
    release(firsts)
    texts = firsts.where("line is not null").select("id", "check", "line")
    # of lines with the same id the one with the lowest check
    twice = texts.groupBy("id").agg(F.min("check").alias("lowest"), F.max("check").alias("most")).where("lowest != most").select("id", "lowest")
    texts = texts.join(twice, "id", "left").where("lowest is null or lowest = check").select("id", "check", "line")
    roots = similar_lines(members, texts.select("id", "line"), similarity).withColumnRenamed("node", "id")
    roots = roots.join(texts.select("id", "check"), "id")
    marked = durable(firsts.select("id", "check", "at").join(roots, ["id", "check"], "left").select("at", "root"))
    lone = marked.where("root is null").select("at")
    grouped = marked.where("root is not null").groupBy("root").agg(F.min("at").alias("at")).select("at")
    return lone.union(grouped).groupBy("at.r", "at.doc_id").agg(F.sort_array(F.collect_list("at.pos")).alias("kept"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with every line that repeats or resembles an earlier one taken out of the text.

    Adds ``_line_counts``: a struct of n_lines and n_kept, lines of white space not counted.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = identified(docs.select(row.alias("row"), "doc_id", "text"))
    kept = kept_lines(base.select("doc_id", "text", "r"), similarity)
    # dealt by r for the join and for the window, so the texts are shuffled once
    by_r = kept.groupBy("r").agg(F.collect_list(F.struct("doc_id", "kept")).alias("found"))
    same = Window.partitionBy("r", "doc_id").orderBy(F.xxhash64("row"))
    joined = base.select("row", "r", "doc_id").join(by_r, "r", "left").withColumn("nth", F.row_number().over(same))
    own = F.get(F.filter("found", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id"))), F.lit(0))["kept"]
    joined = joined.withColumn("kept", F.when(F.col("nth") == 1, own))
    text = F.col("row.text")
    none = F.array().cast("array<int>")

    def blank(x: Column) -> Column:
        return F.array_compact(F.transform(x, lambda s, i: F.when(is_blank(s), i)))

    def judged(x: Column, blanks: Column) -> Column:
        n_lines, n_kept = F.size(x) - F.size(blanks), F.coalesce(F.size("kept"), F.lit(0))
        stay = F.sort_array(F.array_union(F.coalesce("kept", none), blanks))
        rest = F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n")
        return F.struct(F.when(n_lines == n_kept, text).otherwise(rest).alias("text"), n_lines.cast("long").alias("n_lines"), n_kept.cast("long").alias("n_kept"))

    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_kept"))
    done = F.when(text.isNull(), nothing).otherwise(let(F.split(text, "\n"), lambda x: let(blank(x), lambda e: judged(x, e))))
    out = joined.select("row", done.alias("done"))
    columns = [F.col("done.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns, F.struct("done.n_lines", "done.n_kept").alias("_line_counts"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; one that loses every line goes."""
    out = dedup_lines(docs)
    counts = F.col("_line_counts")
    return out.where((counts["n_lines"] == 0) | (counts["n_kept"] > 0)).drop("_line_counts")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "_line_counts.n_lines", "_line_counts.n_kept", F.sha2("text", 256).alias("text_sha256"), "text")
