from pyspark.sql import functions as F

from quillwork.llm.surrogates import candidate, replace_entities, surrogate_table


def test_secrets_without_ascii_letters_or_digits(spark):
    texts = ["password: ********", "secret=......", "password: пароль", "password=!#!#!$", "token=密码密码密码"]
    out = {r["doc_id"]: r["text"] for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[0], out[1]] == texts[:2]
    assert all(out[i] != texts[i] and len(out[i]) == len(texts[i]) for i in (2, 3, 4))


def test_full_formats_get_a_wider_one(spark):
    """All 26 values of one format, so that none is free."""
    rows = [("secret", f"{chr(97 + i)}*****") for i in range(26)]
    out = surrogate_table(spark.createDataFrame(rows, "kind string, canonical string")).collect()
    made = {r["surrogate"] for r in out}
    assert len(out) == len(made) == 26 and not made & {c for _, c in rows}


def test_ips_of_a_full_network_leave_it(spark):
    df = spark.createDataFrame([("ip", "192.168.1.2", 0), ("ip", "192.168.1.2", 20), ("ip", "192.168.1.2", 40), ("ip", "8.8.8.8", 20)], "kind string, canonical string, turn int")
    got = [r[0].split(".") for r in df.select(candidate(F.col("kind"), F.col("canonical"), F.col("turn"))).collect()]
    assert got[0][:2] == ["192", "168"] and got[1][0] == "10" and int(got[2][0]) >= 240 and int(got[3][0]) >= 240


def test_long_runs_of_labels_and_local_parts(spark):
    """Addresses of many labels and long runs that only look like some take no recursion."""
    texts = ["mail a.b@" + "x." * 30_000 + "com end", "a." * 30_000 + " end", "a" * 300_000 + "@b.com", "token=" + "é" * 200_000]
    out = {r["doc_id"]: r["text"] for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[1] == texts[1] and out[0].startswith("mail ") and out[0].endswith(" end") and len(out[3]) == len(texts[3])


def test_against_a_plain_version(spark):
    """Equal entities in equal places get equal surrogates everywhere, others different ones, and nothing else changes."""
    import random
    import re

    rng = random.Random(3)
    mails = [f"{a}.{b}@{c}.com" for a in ("ann", "bob", "cid") for b in ("lee", "ray") for c in ("mill", "hill")]
    ips = [f"8.{i}.{j}.9" for i in range(3) for j in range(3)]
    words = "the quick brown fox runs over it".split()
    docs = [(i, " ".join(rng.choice(rng.choice([mails, ips, words, words])) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    out = {r["doc_id"]: r for r in replace_entities(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    seen = {}
    for i, text in docs:
        old, new = text.split(" "), out[i]["text"].split(" ")
        assert len(old) == len(new) and out[i]["_n_entities"] == sum(w in mails or w in ips for w in old)
        for a, b in zip(old, new, strict=True):
            assert (a == b) == (a not in mails and a not in ips)
            assert seen.setdefault(a, b) == b and bool(re.fullmatch(r"[a-z]+\.[a-z]+@[a-z-]+\.example\.com", b)) == (a in mails)
    assert len(set(seen.values())) == len(seen) and not {seen[x] for x in seen if seen[x] != x} & set(seen)


def test_phones_keep_their_country(make_docs):
    numbers = ["+49 30 123456", "+44 20 7946 0958", "+1 (988) 555-2485", "+7 495 123-45-67", "+352 26 12 34 56", "+491711234567", "(988) 555-2485"]
    docs = make_docs([(i, f"call {n} now") for i, n in enumerate(numbers)] + [(9, "call +49-30-123456 now")])
    got = {r["doc_id"]: r["text"][5:-4] for r in replace_entities(docs).collect()}
    for i, code in enumerate(["+49 ", "+44 ", "+1 (", "+7 ", "+352 ", "+49", "("]):
        new = got[i]
        assert new.startswith(code) and new != numbers[i]
        assert [c for c in new if not c.isdigit()] == [c for c in numbers[i] if not c.isdigit()] and len(new) == len(numbers[i])
    assert got[9].replace("-", "") == got[0].replace(" ", "")
    assert len({got[i].replace(" ", "") for i in range(7)}) == 7
