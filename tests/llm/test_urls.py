from oracle import rows
from entailis.llm.queries import RULES, op4_urls
from entailis.llm.urls import filter_urls
from pyspark.sql import functions as F


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def rule(host, path):
    best = None
    for said, r in RULES:
        name, _, tail = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(r) > len(best[1])):
            best = said, r
    return best


def check(got, urls):
    assert sorted(g[0] for g in got) == sorted(urls)
    for page, host, path, r, verdict, *_ in got:
        assert (host, path) == parse(urls[page])
        best = rule(host, path)
        assert r == (best and best[1])
        assert verdict in ("allow", "block") and (best is None or verdict == best[0])


def test_query(spark, data):
    check(rows(op4_urls(spark, data)), {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()})


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.B/c?d#e", "x://h?q/p", "x://h#f", "http://com/en/", "http://evilcom/en/1", "http://x.COM/en/1", "http://EXAMPLE.com/en/7/8", "http://example.com/en/70", "a://b://c/d", "http://h/" + "d/" * 40, "http://ÄÖ.com/en/", "http://example.net/de/8", "http://example.net/de/9", "http://h/é//x/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    check(rows(filter_urls(df, RULES)), dict(enumerate(urls)))
    assert filter_urls(df.limit(0), RULES).count() == 0


def test_templates_reject_by_purity(spark):
    pages = [(f"http://h/item/{i}/spam", 1 if i < 30 else None) for i in range(60)]  # labelled bad for half, generalised to the rest
    pages += [(f"http://h/item/{i}/news", 0 if i < 30 else None) for i in range(60)]
    pages += [(f"http://h/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/bad", 1 if i < 40 else None) for i in range(80)]  # a variable segment of names
    pages += [(f"http://other/item/{i}/spam", None) for i in range(20)] + [("http://h/one/spam", 1)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pages)], "page_id long, url string, label int")
    got = {pages[r.page_id][0]: r for r in filter_urls(df, [], F.col("label")).collect()}
    assert all(got[f"http://h/item/{i}/spam"].verdict == "block" and got[f"http://h/item/{i}/news"].verdict == "allow" for i in range(60))
    users = [r for u, r in got.items() if "/user/" in u]
    assert {r.template for r in users} == {"/user/*/bad"} and {r.verdict for r in users} == {"block"}
    assert all(got[f"http://other/item/{i}/spam"].verdict == "allow" for i in range(20))
    assert got["http://h/one/spam"].verdict == "allow"  # one label is too little


def test_deep_branches_are_told_apart(spark):
    pages = [(f"http://h/a/b/c/d/e/f/{k}/{s}", int(k == "spam")) for k in ("spam", "news") for s in ("x", "y/z") for _ in range(30)]
    pages += [("http://g/" + "q/" * 300, None), ("http://h/a/b/c/d/e/f/only/" + "r/" * 300, None)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pages)], "page_id long, url string, label int")
    got = {pages[r.page_id][0]: (r.template, r.verdict) for r in filter_urls(df, [], F.col("label")).collect()}
    assert got["http://h/a/b/c/d/e/f/spam/x"] == ("/a/b/c/d/e/f/spam/x", "block") and got["http://h/a/b/c/d/e/f/news/x"] == ("/a/b/c/d/e/f/news/x", "allow")
    assert got["http://h/a/b/c/d/e/f/spam/y/z"] == ("/a/b/c/d/e/f/spam/y/z", "block") and got["http://h/a/b/c/d/e/f/news/y/z"][1] == "allow"
    assert got[pages[-2][0]][0] == "/q" * 300 and got[pages[-1][0]][0] == "/a/b/c/d/e/f/only" + "/r" * 300


def test_similar_branches_merge(spark):
    pages = [(f"http://h/{s}/{i}", i % 2) for s in ("a", "b", "c") for i in range(40)] + [(f"http://h/z/{i}", 1) for i in range(40)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(pages)], "page_id long, url string, label int")
    got = {pages[r.page_id][0]: r.template for r in filter_urls(df, [], F.col("label")).collect()}
    assert got["http://h/a/1"] == got["http://h/b/1"] == got["http://h/c/1"] != got["http://h/z/1"]


def test_rules_win_over_templates(spark):
    df = spark.createDataFrame([(i, f"http://x.com/en/{i}") for i in range(40)] + [(99, "http://example.com/en/7")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, RULES).collect()}
    assert got[3] == ("com/en/", "block") and got[99] == ("example.com/en/7", "allow")
