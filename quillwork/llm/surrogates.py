"""PII: detected entities are replaced by keyed surrogates of the same type.

Detection is one pattern over whole texts: e-mail addresses, IPv4 addresses, phone numbers,
payment cards (Luhn-valid only), social security numbers, IBANs, access keys, values of password
and token assignments, and persons (a title or a known first name before capitalised names).

Each distinct entity, in a canonical form that leaves out how it is written, gets a surrogate
drawn from a keyed hash: digits for digits and letters for letters, a phone number's country code
kept (with the plus sign it is written with, which tells +49 30 123456 from 493-012-3456), valid check digits for cards
and IBANs, reserved domains for addresses, private networks for private networks, first names of
the same gender and script by a keyed permutation of the list, family names of the same script
with their gendered endings. Surrogates that two entities share, that a settled entity has, or
that occur as an entity themselves are drawn again, round by round, until all are distinct. So
equal entities stay equal across documents and different ones different. A surrogate is written
as its mention was: with its separators and its letter case.

Only distinct entities are compared, after a partial aggregate per task, and only documents with
mentions are joined with their surrogates; a common entity's rows may be split.

Defined results: a null or empty text stays as it is; numbers of 13 to 19 digits that fail the
Luhn check aren't cards and stay. A masked value, one punctuation mark again and again in place
of a secret, is no entity and stays. Where a format has too few free values, entities that are
left after WIDE_ROUNDS get a wider one: secrets and addresses a longer one, phones any digits,
private IPs the network 10/8 and then, as all IPs, the reserved 240/4. Rows that repeat a doc_id are rewritten one by one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import ascii_lower, durable, let, stored, table

KEY = "public-demo-key"
MAX_ROUNDS = 60
#: Rounds within an entity's own format, and those after which IPs leave the network 10/8 too.
WIDE_ROUNDS = 20
WIDEST_ROUNDS = 40
#: Country codes of one and of two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
MASK = r"^([^\p{L}\p{N}])\1*$"
#: (class, alphabet) of the characters of secrets that aren't ASCII letters or digits.
ALPHABETS = [
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{Lu}", "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜÝ"),
    (r"[\p{IsLatin}&&\p{L}]", "àáâäåæçèéêëìíîïñòóôöøùúûüý"),
    (r"\p{L}", "一二三四五六七八九十天地人山水火木金土日月年"),
    (r"\p{N}", "٠١٢٣٤٥٦٧٨٩"),
]
MARKS = "!#$%&*+-./:=?@^_~"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
TITLES_M = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"]
TITLES = [*TITLES_M, *TITLES_F, "Dr", "Prof"]
#: First names by script and gender.
FIRST_NAMES = {
    "latin m": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Karl Pierre Jacques Carlos Luis Juan Miguel".split(),
    "latin f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Anna Maria Julia Emma Claire Sophie Carmen Laura Elena Ingrid Greta Marie".split(),
    "cyrillic m": "Иван Алексей Сергей Дмитрий Николай Владимир Михаил Андрей".split(),
    "cyrillic f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "greek m": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Σπύρος".split(),
    "greek f": "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Άννα".split(),
}
SYLLABLES = {
    "latin": "bar bel cor dan del far gar hal kel lan mar mor nel pol ran rol san sel tan tor val ven wil zan".split(),
    "cyrillic": "бар бел вор дан зор кал лан мир нор пол рад сел тор вен гор жар".split(),
    "greek": "βαρ δελ θαν καλ λαμ μορ νελ παλ ραν σελ τορ φαν".split(),
}
_ALL_FIRST = [n for names in FIRST_NAMES.values() for n in names]
#: (kind, pattern), in the order in which they are tried.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,31}\.[A-Za-z]{2,63}"),
    ("secret", r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}[\"']?)[^\s\"',;]{6,}"),
    ("access", r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("person", rf"(?<![\p{{L}}0-9])(?:(?:{'|'.join(TITLES)})\.?(?: {_NAME}){{1,3}}|(?:{'|'.join(_ALL_FIRST)})(?: {_NAME}){{1,2}})"),
]
_BY_KIND = dict(PATTERNS)


def _one_of(*kinds: str) -> str:
    return "(?:" + "|".join(f"(?:{_BY_KIND[k]})" for k in kinds) + ")"


#: All kinds in one pattern. A mention begins where no word goes on; cheap looks at the characters
#: around that place come before the longer patterns.
COMBINED = (
    r"(?<![\p{L}\p{N}])(?:(?<=[=:] {0,2}[\"']?)"
    + _one_of("secret")
    + "|(?=[0-9+(])"
    + _one_of("ip", "ssn", "phone", "card")
    + r"|(?=\p{Lu})"
    + _one_of("access", "iban", "person")
    + "|"
    + _one_of("email")
    + ")"
)
DIGIT_KINDS = ("phone", "card", "ssn")
ENDING = "((?:ов|ев|ин)а?|ск(?:ий|ая))?$"
_MENTION = "array<struct<kind:string,canonical:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits, the last one taken as it is and every second before it doubled."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _title(token: Column) -> Column:
    return F.regexp_replace(token, r"\.$", "").isin(TITLES)


def _stem(token: Column) -> Column:
    return F.regexp_extract(token, f"(?s)^(.*?){ENDING}", 1)


def _kind(mention: Column) -> Column:
    """A secret is known by what stands before it; every other kind by its own pattern."""
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS):
        if kind != "secret":
            out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def entities_of(mention: Column) -> Column:
    """The entities in a mention as an array of (kind, canonical); none in a number that is no card."""

    def one(kind: Column, canonical: Column) -> Column:
        return F.array(F.struct(kind.alias("kind"), canonical.alias("canonical")))

    none = F.array().cast(_MENTION)

    def of(kind: Column) -> Column:
        names = F.filter(F.split(mention, " "), lambda t: ~_title(t) & ~t.isin(_ALL_FIRST))
        return (
            F.when(kind == "email", one(kind, ascii_lower(mention)))
            .when(kind == "person", F.transform(names, lambda t: F.struct(F.lit("name").alias("kind"), F.lower(_stem(t)).alias("canonical"))))
            .when(kind == "card", let(_digits(mention), lambda d: F.when(_luhn_sum(d) % 10 == 0, one(kind, d)).otherwise(none)))
            .when(kind == "phone", one(kind, F.concat(F.when(F.startswith(mention, F.lit("+")), "+").otherwise(""), _digits(mention))))
            .when(kind.isin(*DIGIT_KINDS), one(kind, _digits(mention)))
            .when(kind == "iban", one(kind, F.replace(mention, F.lit(" "), F.lit(""))))
            .when((kind == "secret") & mention.rlike(MASK), none)
            .otherwise(one(kind, mention))
        )

    return let(_kind(mention), of)


def _draw(stream: Column, i: Column) -> Column:
    """The i-th byte of a stream of 128 hexadecimal digits."""
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), at % len(items) + 1)


def _scrambled(text: Column, stream: Column, hexadecimal: Column | bool = False) -> Column:
    """Digits and letters in place of digits and letters, the rest as it is."""

    def char(c: Column, i: Column) -> Column:
        v = _draw(stream, i)
        low = F.when(F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal, v % 6).otherwise(v % 26)
        return (
            F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(97 + low))
            .when(c.rlike("[A-Z]"), F.char(65 + low))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), char), "")


def candidate(kind: Column, canonical: Column, turn: Column, key: str = KEY) -> Column:
    """The surrogate, in canonical form, that the keyed hash gives an entity in a round."""

    def digest(*parts: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)

    wide = turn >= WIDE_ROUNDS

    def longer(s: Column) -> Column:
        return F.when(wide, F.substring(s, 1, 16)).otherwise(F.lit(""))

    def email(s: Column) -> Column:
        local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
        top = F.substring_index(domain, ".", -1)
        labels = F.translate(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), ".", "-")
        host = _scrambled(labels, digest(F.lit("domain"), domain))
        return F.concat(_scrambled(local, s), longer(s), F.lit("@"), host, F.lit(".example"), F.when(top.isin("com", "net", "org"), F.concat(F.lit("."), top)).otherwise(F.lit("")))

    def phone(s: Column) -> Column:
        fixed = F.length(F.regexp_extract(canonical, COUNTRY, 0))

        def digit(c: Column, i: Column) -> Column:
            v, d = _draw(s, i), c.cast("int")
            return F.when(i < fixed, c).when(wide, (v % 10).cast("string")).when(d >= 2, (2 + v % 8).cast("string")).otherwise((v % 2).cast("string"))

        return F.array_join(F.transform(F.split(canonical, ""), digit), "")

    def card(s: Column) -> Column:
        body = F.concat(F.substring(canonical, 1, 1), _scrambled(F.substring(canonical, F.lit(2), F.length(canonical) - 2), s))
        return let(body, lambda b: F.concat(b, (F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10))).cast("string")))

    def ssn(s: Column) -> Column:
        return F.concat(F.lit("9"), F.substring(_scrambled(canonical, s), F.lit(2), F.length(canonical)))

    def ip(s: Column) -> Column:
        same = F.when(canonical.rlike(r"^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."), 2).when(canonical.rlike(r"^(?:10|127)\."), 1).otherwise(0)
        octets = F.transform(
            F.split(canonical, r"\."),
            lambda o, i: F.when(i < same, o).otherwise(F.when(i == 0, 11 + _draw(s, i) % 100).otherwise(1 + _draw(s, i) % 254).cast("string")),
        )
        first = F.when((turn < WIDEST_ROUNDS) & (same > 0), "10").otherwise((240 + _draw(s, F.lit(0)) % 15).cast("string"))
        others = F.transform(octets, lambda o, i: F.when(i == 0, first).otherwise((1 + _draw(s, i) % 254).cast("string")))
        return F.array_join(F.when(wide, others).otherwise(octets), ".")

    def iban(s: Column) -> Column:
        country, body = F.substring(canonical, 1, 2), _scrambled(F.substring(canonical, F.lit(5), F.length(canonical)), s)

        def check(b: Column) -> Column:
            codes = F.transform(F.split(F.concat(b, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
            rest = F.aggregate(codes, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
            return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), b)

        return let(body, check)

    def access(s: Column) -> Column:
        return F.concat(F.substring(canonical, 1, 4), _scrambled(F.substring(canonical, F.lit(5), F.length(canonical)), s))

    def name(s: Column) -> Column:
        script = F.when(canonical.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canonical.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        parts = F.sequence(F.lit(0), 1 + turn + _draw(s, F.lit(60)) % 2)

        def joined(syllables: list[str]) -> Column:
            return F.array_join(F.transform(parts, lambda i: _pick(syllables, _draw(s, i))), "")

        return F.when(script == "cyrillic", joined(SYLLABLES["cyrillic"])).when(script == "greek", joined(SYLLABLES["greek"])).otherwise(joined(SYLLABLES["latin"]))

    def secret(s: Column) -> Column:
        def other(c: Column, i: Column) -> Column:
            out = F.when(~canonical.rlike(r"[\p{L}\p{N}]"), F.substring(F.lit(MARKS), _draw(s, i) % len(MARKS) + 1, F.lit(1))).otherwise(c)
            for kind_of, alphabet in reversed(ALPHABETS):
                out = F.when(c.rlike(kind_of), F.substring(F.lit(alphabet), _draw(s, i) % len(alphabet) + 1, F.lit(1))).otherwise(out)
            return F.when(c.rlike("[0-9A-Za-z]"), c).otherwise(out)

        plain = _scrambled(canonical, s, canonical.rlike("^[0-9a-f]+$"))
        rest = F.when(canonical.rlike("[^ -~]") | ~canonical.rlike("[0-9A-Za-z]"), F.array_join(F.transform(F.split(plain, ""), other), "")).otherwise(plain)
        return F.concat(rest, longer(s))

    made = {"email": email, "phone": phone, "card": card, "ssn": ssn, "ip": ip, "iban": iban, "access": access, "name": name}

    def of(s: Column) -> Column:
        out = secret(s)
        for k, make in made.items():
            out = F.when(kind == k, make(s)).otherwise(out)
        return out

    return let(digest(kind, canonical, turn.cast("string")), of)


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canonical, surrogate) for the distinct entities (kind, canonical), all distinct by kind."""
    originals = durable(entities.select("kind", "canonical").distinct())
    pending, settled = originals, None
    for turn in range(MAX_ROUNDS):
        drawn = durable(pending.withColumn("surrogate", candidate(F.col("kind"), F.col("canonical"), F.lit(turn), key)))
        own = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        good = own.join(originals.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = good.select("kind", "canonical", "surrogate")
        settled = durable(good if settled is None else settled.union(good))
        pending = durable(pending.join(settled, ["kind", "canonical"], "left_anti"))
        if pending.isEmpty():
            return settled
    raise ValueError(f"some formats have too few values for {MAX_ROUNDS} rounds to keep their entities apart")


def first_name_map(key: str = KEY) -> dict[str, str]:
    """A keyed permutation of each list of first names, without fixed points."""
    out = {}
    for names in FIRST_NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def written(mention: Column, surrogates: Column, key: str = KEY) -> Column:
    """The mention rewritten. surrogates: a map of kind and canonical, joined by a colon."""
    firsts = F.create_map(*[F.lit(x) for pair in first_name_map(key).items() for x in pair])

    def refit(digits: Column) -> Column:
        """The mention's separators between new digits."""
        parts = F.split(mention, "")
        counted = F.transform(parts, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.array_join(F.slice(parts, 1, i + 1), ""))), F.lit(1))).otherwise(c))
        return F.array_join(counted, "")

    def spaced(letters: Column) -> Column:
        parts = F.split(mention, "")
        counted = F.transform(parts, lambda c, i: F.when(c != " ", F.substring(letters, F.length(F.replace(F.array_join(F.slice(parts, 1, i + 1), ""), F.lit(" "), F.lit(""))), F.lit(1))).otherwise(c))
        return F.array_join(counted, "")

    def address(new: Column) -> Column:
        """Capitals before the @ where the mention has only capitals there."""
        local = F.substring_index(mention, "@", 1)
        upper = local.rlike("[A-Z]") & ~local.rlike("[a-z]")
        return F.when(upper, F.concat_ws("@", F.upper(F.substring_index(new, "@", 1)), F.substring_index(new, "@", -1))).otherwise(new)

    def person(token: Column) -> Column:
        new = surrogates[F.concat(F.lit("name:"), F.lower(_stem(token)))]
        cased = F.when((token == F.upper(token)) & (F.length(token) > 1), F.upper(new)).otherwise(F.initcap(new))
        return F.when(_title(token), token).when(token.isin(_ALL_FIRST), firsts[token]).otherwise(F.concat(cased, F.regexp_extract(token, f"(?s)^.*?{ENDING}", 1)))

    def of(e: Column) -> Column:
        kind = e["kind"]
        new = surrogates[F.concat(kind, F.lit(":"), e["canonical"])]
        return (
            F.when(kind == "email", address(new))
            .when(kind.isin(*DIGIT_KINDS), refit(_digits(new)))
            .when(kind == "iban", spaced(new))
            .otherwise(new)
        )

    is_person = _kind(mention) == "person"
    single = let(entities_of(mention), lambda e: F.when(F.size(e) > 0, of(e[0])).otherwise(mention))
    return F.when(is_person, F.array_join(F.transform(F.split(mention, " "), person), " ")).otherwise(single)


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in the text and ``_n_entities``, the number of mentions replaced."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(COMBINED), F.lit(0))
    base = stored(docs.select(row, found.alias("mentions"), F.monotonically_increasing_id().alias("rid")))
    mentions = F.col("mentions")
    each = base.where(F.size(mentions) > 0).select(
        "rid", F.explode(F.array_distinct(F.flatten(F.transform(mentions, entities_of)))).alias("e")
    ).select("rid", "e.*")
    each = durable(each)
    known = surrogate_table(each, key)
    pairs = each.join(known, ["kind", "canonical"]).select("rid", F.struct(F.concat("kind", F.lit(":"), "canonical").alias("k"), F.col("surrogate").alias("v")).alias("pair"))
    maps = pairs.groupBy("rid").agg(F.map_from_entries(F.collect_list("pair")).alias("surrogates"))
    columns = docs.columns

    def out(df: DataFrame, text: Column, n: Column) -> DataFrame:
        df = df.select("row", text.alias("_text"), n.cast("long").alias("_n_entities"))
        return df.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns], "_n_entities")

    plain = out(base.where(F.size(mentions) == 0), F.col("row.text"), F.lit(0))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    marked = base.where(F.size(mentions) > 0).join(maps, "rid", "left").withColumn("surrogates", F.coalesce("surrogates", empty))
    new = F.transform(mentions, lambda m: written(m, F.col("surrogates"), key))
    gaps = F.split("row.text", COMBINED, -1)
    text = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    changed = F.aggregate(F.zip_with(mentions, new, lambda m, s: (m != s).cast("int")), F.lit(0), lambda a, x: a + x)
    return plain.union(out(marked, text, changed))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs).select("doc_id", F.col("_n_entities").alias("n_entities"), "text")
