import pytest

from quillwork.llm.url_trust import RULES, judge_urls, propagate

PAGES = "page_id long, url string, html string"


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute_rule(host, path):
    best = None
    for verdict, rule in RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def test_rules(spark):
    urls = [
        "http://a.example.com/en/1", "https://EXAMPLE.com/en/77?x", "http://b.net/de/1#t", "http://example.net/de/88", "http://x.example.net/de/8", "http://org/es/",
        "http://notorg/es/", "http://a.org/es", "http://com?en/", "ftp://q://com/en/", "nothing", "", None, "http://Ä.com/en/x", "://example.com/en/7", "http://a.com/fr/\n?x",
    ]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], ""), (3, urls[3], "<p>")]
    out = judge_urls(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(out) == len(rows)
    by_id = {r["page_id"]: r for r in out if r["page_id"] is not None}
    for i, u in enumerate(urls):
        r, (host, path) = by_id[i], brute_host_path(u)
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1]), u
        if rule:
            assert r["verdict"] == rule[0]
        if not host:
            assert r["verdict"] == "allow"


def test_propagation_against_brute_force(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 5), ("e", "d", 1)]
    seeds = [("a", 1.0, 0.0), ("c", 0.0, 0.5), ("z", 0.25, 0.0)]

    def flow(start, ways, steps):
        total, now = dict(start), dict(start)
        for _ in range(steps):
            new = {}
            for s, d, part in ways:
                if s in now:
                    new[d] = new.get(d, 0) + now[s] * 0.85 * part
            now = new
            for h, v in new.items():
                total[h] = total.get(h, 0) + v
        return total

    shares = [(s, d, n / sum(k for x, _, k in edges if x == s)) for s, d, n in edges]
    trust = flow({h: t for h, t, _ in seeds if t}, shares, 200)
    distrust = flow({h: b for h, _, b in seeds if b}, [(d, s, part) for s, d, part in shares], 200)
    out = propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"), tolerance=1e-3).collect()
    got = {r["host"]: (r["trust"], r["distrust"]) for r in out}
    assert set(got) == set(trust) | set(distrust)
    for h, (t, d) in got.items():
        assert trust.get(h, 0) - 1e-3 <= t <= trust.get(h, 0) + 1e-9 and distrust.get(h, 0) - 1e-3 <= d <= distrust.get(h, 0) + 1e-9


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    rows = [(i, "http://bad.org/es/%d" % i, "") for i in range(3)]
    rows += [(10, "http://farm.info/x", '<a href="http://bad.org/es/1">x</a>'), (11, "http://fine.info/x", '<a href="http://good.net/de/">x</a>'), (12, "http://good.net/de/1", "")]
    rows += [(13, "http://alone.info/", None), (14, "http://bad.org/other", "")]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 10: "block", 11: "allow", 12: "allow", 13: "allow", 14: "block"}


def test_many_hosts_that_link_to_one_blocked_host(spark):
    """All of them are blocked, however many; one with few of its links there isn't."""
    rows = [(0, "http://bad.org/es/1", "")]
    rows += [(i, f"http://farm{i}.info/", '<a href="http://bad.org/es/1">x</a>') for i in range(1, 9)]
    rows += [(10, "http://portal.info/", '<a href="http://bad.org/es/1">x</a>' + "".join(f'<a href="http://site{k}.info/">y</a>' for k in range(9)))]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == dict.fromkeys(range(9), "block") | {10: "allow"}


def test_against_the_sql_on_pages_with_links(spark, tmp_path):
    """A small graph without cycles beyond two hosts, a long page and columns with names used inside."""
    import duckdb

    from quillwork.llm.url_trust import ORACLE

    link = '<a href="http://%s/x">t</a>'
    rows = [(1, "http://bad.org/es/1", link % "farm.info"), (2, "http://farm.info/", link % "bad.org" * 3 + link % "good.net"), (3, "http://good.net/de/1", link % "near.info"), (4, "http://near.info/", "x" * 300_000 + link % "far.info"), (5, "http://far.info/q", None), (6, None, link % "bad.org")]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], PAGES + ", host string, kind string")
    names = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    got = sorted((tuple(r[n] for n in names) for r in judge_urls(df).collect()), key=str)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({ORACLE})").fetchall(), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) <= 2e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g[5:], w[5:], strict=True))


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], PAGES)).count() == 0
