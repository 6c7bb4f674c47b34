import random
import re

from tests.llm.helpers import ordered, sql_rows

from turnwise.llm import oracles
from turnwise.llm.urls import LIMIT, SOFT, SOFT_TERMS, STRICT, UrlRule, judge_urls

SCHEMA = "page_id long, url string, html string, host string, verdict string, scanned string"
FIXED = [
    None,
    "",
    "no scheme at all",
    "http://",
    "https://A.Example.NET/en/1?x=casino",
    "https://example.net",
    "https://example.net?q=/en/",
    "https://example.network/en/",
    "https://sub.EXAMPLE.com/de/x#y://z",
    "https://example.com/fr/free-bets",
    "https://notexample.com/de/casino/casino",
    "https://x.org/fr/porn",
    "https://x.org/en/porn%20porn",
    "https://x.org/en/pornography/winter",
    "https://x.org/%2Fadult%2Dx",
    "https://x.org/free?win=free",
    "https://é.org/écasino/xxxé",
    "https://org/fr/",
    "mailto:a@b.c",
    "a://b://net/",
    "https://x.com/" + "a/" * 50_000 + "casino",
    "https://line\nbreak.net/x\ny?z",
]


def plain(url):
    """The contract and the vocabulary rule, term by term."""
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    text = re.sub("%[0-9a-f]{2}", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in url or ""))
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text)
    strict, soft = [w for w in words if w in STRICT], [w for w in words if w in SOFT]
    weight = sum(SOFT[w] for w in set(soft))
    bad = strict or (len(set(soft)) >= SOFT_TERMS and weight >= LIMIT)
    _, rule, verdict = max(fits, default=(0, None, "block" if bad else "allow"))
    return host, path, rule, verdict, len(strict), len(soft), len(set(soft)), weight, ",".join(sorted({*strict, *soft}))


def made_urls(n):
    rng = random.Random(5)
    pieces = [*STRICT[:4], *list(SOFT)[:8], "x", "en", "de", "fr", "winter", "é", "%41", "%zz", "9"]
    hosts = ["example.net", "example.com", "a.example.com", "org", "b.org", "net", "EXAMPLE.net:80", "me@example.com"]
    return [
        rng.choice(["http://", "https://", "", "x:/"])
        + rng.choice(hosts)
        + "".join(rng.choice("/-._?#=&") + rng.choice(pieces) + rng.choice(["", rng.choice(pieces)]) for _ in range(rng.randrange(6)))
        for _ in range(n)
    ]


def test_as_the_contract_says(spark):
    urls = FIXED + made_urls(600)
    pages = spark.createDataFrame([(i, u, None, "h", "v", "s") for i, u in enumerate(urls)], SCHEMA)
    found = {r.page_id: tuple(r)[1:] for r in judge_urls(pages).collect()}
    assert found == {i: plain(u) for i, u in enumerate(urls)}
    assert {v[3] for v in found.values()} == {"block", "allow"}


def test_sql_says_the_same(spark):
    rows = [(i, u) for i, u in enumerate(FIXED + made_urls(300))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    result = judge_urls(pages)
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    ours = ordered([r[i] for i in order] for r in result.collect())
    wrapped = f"SELECT {', '.join(sorted(result.columns))} FROM ({oracles.URLS})"
    assert ours == ordered(sql_rows(wrapped, pages=(["page_id", "url"], rows)))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None), (None, "https://a.net/", "x", "", "", ""), (1, "u", "", "", "", ""), (1, "u", "", "", "", "")]
    found = judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ordered((r.page_id, r.host, r.rule, r.verdict) for r in found) == ordered(
        [(None, "", None, "allow"), (None, "a.net", "net/", "block"), (1, "", None, "allow"), (1, "", None, "allow")]
    )
    assert judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_own_rules_and_terms(spark):
    pages = spark.createDataFrame([(1, "https://a.b.c/d"), (2, "https://b.c/"), (3, "https://z/one-two"), (4, "https://z/one")], "page_id long, url string")
    rules = [UrlRule("block", "b.c", "/"), UrlRule("allow", "a.b.c", "/"), UrlRule("block", "c", "/d")]
    found = judge_urls(pages, rules, strict=(), soft={"one": 1, "two": 1}, limit=2).collect()
    assert [(r.page_id, r.rule, r.verdict) for r in found] == [
        (1, "a.b.c/", "allow"),
        (2, "b.c/", "block"),
        (3, None, "block"),
        (4, None, "allow"),
    ]
