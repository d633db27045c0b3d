from pyspark.sql import functions as F

from marginalia.llm import url_filter

URLS = [
    None, "", "no scheme", "https://Example.ORG/es/1", "http://a.example.org/es", "https://b.example.org/en/17?x#y", "http://xexample.org/es/1",
    "https://org/", "http://org", "https://x.com/fr/1", "https://x.com/de/1", "https://x.com/en/1", "http://x.net/1.html", "https://www.x.net/1/",
    "http://m.x.net/1#top", "ftp://y://z/de/", "https://a.b.c.com/de/?q=/fr/", "://com/fr/", "https://x.com\n/fr/",
]


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, None))
    bare = host.split(".", 1)[1] if host.startswith(("www.", "m.")) else host
    path_ = path[:-1] if path.endswith("/") else path[:-5] if path.endswith(".html") else path
    hit = bool(host) and bare + path_ in listed
    return host, path, rule[1], rule[2] or ("block" if hit else "allow"), hit


def judge(spark, urls, listed, **params):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = url_filter.judge_urls(pages, rules, spark.createDataFrame([(u,) for u in listed], "canonical string")).collect()
    return {r.page_id: tuple(r)[1:] for r in rows}


def test_verdicts_equal_brute_force(spark):
    for listed in ([], ["x.net/1", "x.com/fr/1", "x.net/1"]):
        got = judge(spark, URLS * 2, listed)
        assert got == {i: brute(u, listed) for i, u in enumerate(URLS * 2)}


def test_shuffled_lists_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SMALL_LIST", 0)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 16)  # an overfull filter only passes more
    listed = [f"h{i}.net/p" for i in range(20_000)] + ["x.net/1"]
    assert judge(spark, URLS, listed) == {i: brute(u, listed) for i, u in enumerate(URLS)}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("_key"))
    bloom, blocks = url_filter.bloom_filter(keys, 5000)
    assert url_filter.passes_filter(keys, bloom, blocks).count() == 5000
    others = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("_key"))
    assert url_filter.passes_filter(others, bloom, blocks).count() < 100


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    none = spark.createDataFrame([], "canonical string")
    assert url_filter.judge_urls(pages, rules, none).count() == 0
    some = spark.createDataFrame([(1, "https://x.com/fr/1")], "page_id long, url string")
    assert url_filter.judge_urls(some, rules, none).first().verdict == "allow"


def test_long_urls_and_clashing_columns(spark):
    urls = ["https://x.com/fr/" + "a" * 100_000, "https://" + "h." * 2000 + "com/de/", "https://x.net/" + "b" * 70_000] * 2 + ["https://x.com/de/1"] * 200
    rows = [(i, u, "clash", "clash", 1, True) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _host string, _key string, _rows int, _listed boolean")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    listed = ["x.net/" + "b" * 70_000]
    got = url_filter.judge_urls(pages, rules, spark.createDataFrame([(u,) for u in listed], "canonical string")).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: brute(u, listed) for i, u in enumerate(urls)}
