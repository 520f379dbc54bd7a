import random
import re

from tidewell.llm import urlfilter


def slow(glob, url):
    return re.fullmatch("".join({"*": ".*", "+": "[^/]*", "?": "."}.get(c, re.escape(c)) for c in glob), url, re.S) is not None


def test_automaton_matches_regular_expressions():
    r = random.Random(6)
    globs = ["".join(r.choice("ab/*+?.") for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["", "*", "a" * 150 + "*"]
    urls = ["".join(r.choice("ab/.") for _ in range(r.randrange(0, 14))) for _ in range(400)] + ["a" * 400, ""]
    found = urlfilter.ShiftAnd(globs).match([u.encode() for u in urls])
    for i, u in enumerate(urls):
        for j, g in enumerate(globs):
            assert found[i, j] == slow(g, u), (g, u)


def test_edge_cases(spark):
    rows = [
        (1, "http://Sub.EXAMPLE.net/en/x?q", "sub.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://example.net/de/", "example.net", "/de/", "net/", "block"),
        (3, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (4, "https://example.com/de", "example.com", "/de", None, "allow"),
        (5, "ftp://example.net", "example.net", "", None, "allow"),
        (6, "https://x.org/a.net/fr/", "x.org", "/a.net/fr/", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "a://b://c.net/", "b:", "//c.net/", None, "allow"),
        (10, "http://é.org/fr/ü#://", "é.org", "/fr/ü", "org/fr/", "allow"),
        (11, "http://best-casino.example.com/", "best-casino.example.com", "/", None, "block"),
        (11, "http://best-casino.example.com/", "best-casino.example.com", "/", None, "block"),
        (12, "http://a.example.com/s?q=CASINO", "a.example.com", "/s", None, "block"),
        (13, "http://a.example.com/CaSiNo/#x", "a.example.com", "/CaSiNo/", None, "block"),
        (14, "http://a.example.com/s#/cgi-bin/", "a.example.com", "/s", None, "block"),
        (15, "http://a.org/fr/?q=casino", "a.org", "/fr/", "org/fr/", "allow"),
        (16, "casino without a scheme", "", "", None, "allow"),
        (None, "http://x.example.com/" + "y" * 50_000, "x.example.com", "/" + "y" * 50_000, None, "allow"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "'clash' rule", "'clash' host")
    got = sorted(map(tuple, urlfilter.op6_url_filter(pages).collect()), key=repr)
    assert got == sorted(((r[0], *r[2:]) for r in rows), key=repr)
    assert urlfilter.op6_url_filter(pages.limit(0)).count() == 0


def test_thousands_of_rules_from_a_table(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(2, 5)))
    site = sorted({f"{word()}.{r.choice(['com', 'net'])}/{r.choice(['', word() + '/'])}" for _ in range(2500)})
    verdict = {s: r.choice(["allow", "block"]) for s in site}
    globs = sorted({f"*{word()}{r.choice(['', '?', '*'])}{word()}*" for _ in range(1200)})
    table = spark.createDataFrame([("site", verdict[s], s) for s in site] + [("keyword", "block", g) for g in globs], "kind string, verdict string, rule string")
    rules = urlfilter.rules_of(table)
    urls = [(k, f"http://{word()}.{word()}.{r.choice(['com', 'net', 'org'])}/{word()}/{word()}?{word()}") for k in range(300)]
    got = {x["page_id"]: x for x in urlfilter.judged(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    seen = set()
    for k, url in urls:
        host, _, path = url[7:].partition("/")
        path = "/" + path.split("?")[0]
        fits = [s for s in site if (host == s.split("/")[0] or host.endswith("." + s.split("/")[0])) and path.startswith(s[s.index("/") :])]
        rule = max(fits, key=lambda s: (len(s), [-ord(c) for c in s])) if fits else None
        want = verdict[rule] if rule else "block" if any(slow(g, "." + url[7:]) for g in globs) else "allow"
        assert (got[k]["rule"], got[k]["verdict"]) == (rule, want), url
        seen.add((rule is None, want))
    assert len(seen) >= 3


def test_fifty_thousand_rules_stay_below_a_gigabyte():
    import tracemalloc

    r = random.Random(3)
    site = sorted({"".join(r.choice("abcdefghij") for _ in range(9)) + f".com/{k % 7}/" for k in range(urlfilter.MAX_RULES)})
    rules = urlfilter.Filter([("block", s) for s in site])
    asked = [r.choice(site) for _ in range(40)] + ["other.com/x/"] * 40
    tracemalloc.start()
    got, verdicts = rules.judge([s.split("/")[0] for s in asked], ["/" + s.split("/", 1)[1] + "y" for s in asked], [""] * 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(site) > 49_000 and got[:40] == asked[:40] and set(got[40:]) == {None} and verdicts[:40] == ["block"] * 40
    assert peak + 2 * rules.sites.enter.nbytes < 1e9
