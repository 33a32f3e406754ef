import random

from ledgerline.llm.queries import URL_RULES
from ledgerline.llm.url_filter import judge_urls, rule_frame


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([len(rest), *(rest.index(c) for c in "?#" if c in rest)])]
    fit = [(len(h.split(".")), len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def urls():
    rng = random.Random(2)
    hosts = ["com", "example.com", "WWW.example.COM", "a.www.example.com", "xexample.com", "net", "b.net", "org", "example.org", "", "com.", ".com", "É.net", "example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/fr/", "/es/2#top", "/fr/", "/x/en/", "?q", "#f", "//en/"]
    rows = [(1, None), (2, ""), (3, "example.com/en/"), (4, "http://"), (None, "http://net/es/"), (5, "a://b://c/en/"), (5, "a://b://c/en/"), (6, "http://example.com/en/" + "y" * 100_000)]
    rows += [(10 + i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)]
    return rows + [(1000 + i, "http://www.example.com/en/same") for i in range(300)]


def judged(spark, rows, rules, partitions):
    pages = spark.createDataFrame([(a, b, "clash", "x", "y") for a, b in rows], "page_id long, url string, host string, key string, part string")
    return sorted(map(repr, judge_urls(pages, rule_frame(spark, rules), partitions=partitions).collect()))


def expected(rows, rules):
    from pyspark.sql import Row

    out = []
    for i, u in rows:
        host, path, rule, verdict = plain(u, rules)
        out.append(repr(Row(page_id=i, host=host, path=path, rule=rule, verdict=verdict)))
    return sorted(out)


def test_contract_rules(spark):
    for partitions in (1, 7):
        assert judged(spark, urls(), URL_RULES, partitions) == expected(urls(), URL_RULES)


def test_deep_nesting(spark):
    rules = [("com", "/", "block"), ("example.com", "/", "allow"), ("www.example.com", "/", "block"), ("www.example.com", "/en", "allow"), ("www.example.com", "/en/1", "block"), ("b.net", "/", "block"), ("a.www.example.com", "/zz", "block")]
    assert judged(spark, urls(), rules, 9) == expected(urls(), rules)


def test_no_rules_and_no_urls(spark):
    assert judged(spark, urls()[:20], [("nowhere", "/", "block")], 3) == expected(urls()[:20], [])
    none = rule_frame(spark, URL_RULES).limit(0)
    pages = spark.createDataFrame(urls()[:20], "page_id long, url string")
    assert {r.verdict for r in judge_urls(pages, none).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rule_frame(spark, URL_RULES)).collect() == []


def test_one_host_with_many_nested_paths(spark):
    rng = random.Random(4)
    paths = {"".join(rng.choices(["/a", "/b", "/", "c"], k=rng.randrange(0, 7))) for _ in range(500)}
    rules = [(h, p, rng.choice(["allow", "block"])) for p in paths for h in ("big.org", "org")] + [("x.big.org", "/a", "allow")]
    rows = [(i, f"http://{rng.choice(['big.org', 'x.big.org', 'y.z.big.org', 'org', 'small.org', 'gorg'])}{''.join(rng.choices(['/a', '/b', '/', 'c'], k=rng.randrange(0, 9)))}") for i in range(600)]
    for partitions in (2, 11):
        assert judged(spark, rows, rules, partitions) == expected(rows, rules)
