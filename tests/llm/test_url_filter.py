import re

from strandloom.llm.queries import URL_RULES
from strandloom.llm.url_filter import judge_urls

URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "https://Example.COM/en/7", "https://www.example.com/en/70?x#y", "https://www.example.com/en/8",
    "http://badexample.com/en/7", "http://a.b.example.net/de/81", "http://example.net/de/9", "http://x.net/de/8", "http://x.org/es/", "http://x.org/es",
    "http://x.org?a=/es/", "ftp://y.org#/es/", "http://ÉCOLE.com/en/é", "a://b://com/en/", "http://com./en/", "http://.com/en/1", "http://x.org/es/" + "p" * 5000,
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def table(spark, urls):
    return spark.createDataFrame([(k, u, "h", u) for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_against_brute_force(spark):
    rules = [*URL_RULES, ("com", "/en/", "allow")][:5]
    urls = URLS + [f"http://{s}{d}{p}" for s in ("", "www.", "a.b.") for d in ("example.com", "example.net", "org", "com") for p in ("/en/7", "/de/8", "/es/1", "/en/", "")]
    got = judge_urls(table(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_hot_url_many_ranges_and_nulls(spark):
    rows = [(None if k % 9 == 0 else k, "http://www.example.com/en/70") for k in range(3000)] + [(k, f"http://h{k % 40}.example.net/de/{k}") for k in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("com", "", "block")], "host string, path string, verdict string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for r in got:
        want = ("example.com/en/7", "allow") if r.host == "www.example.com" else brute("http://" + r.host + r.path, URL_RULES)[2:]
        assert (r.rule, r.verdict) == tuple(want)


def test_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert judge_urls(table(spark, ["http://a.com/en/"]).limit(0), rules).count() == 0
    assert judge_urls(table(spark, ["http://a.com/en/"]), rules.limit(0)).first().verdict == "allow"
