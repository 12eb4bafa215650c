from itertools import combinations

from assayframe.llm import url_filter

URLS = ["http://a.org/x", "https://EXAMPLE.org/es/1?q=1", "https://sub.example.org/en/12", "http://example.org", "http://example.com/de/3#t", "ftp://x.com/fr/2", "http://notorg/x", "http://a.net/de/9", "no scheme", "", None, "://h.org/é/ /\n", "http://b.org:80/z"]
RULE = [
    ("a.org", "/x", "org/", "allow"), ("example.org", "/es/1", "example.org/es/", "block"), ("sub.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "", None, None),
    ("example.com", "/de/3", "com/de/", "block"), ("x.com", "/fr/2", "com/fr/", "allow"), ("notorg", "/x", None, None), ("a.net", "/de/9", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None),
    ("h.org", "/é/ /\n", "org/", "allow"), ("b.org:80", "/z", None, None),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")


def test_listed_rules(spark):
    got = url_filter.judge(pages(spark, URLS), url_filter.rule_table(spark)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [r[:3] for r in RULE]
    assert all(r["verdict"] == want[3] for r, want in zip(got, RULE) if want[3])
    assert all(r["verdict"] in ("allow", "block") for r in got)


def brute_rules(examples, support, confidence):
    """Every combination of tokens, counted one by one."""
    n, stands = len(examples), {}
    for i, (tokens, _) in enumerate(examples):
        for t in tokens:
            stands.setdefault(t, set()).add(i)
    least = -int(-support * n // 1)
    kept = {min(t for t in stands if stands[t] == own) for own in stands.values() if len(own) >= least}
    counts = {}
    for tokens, verdict in examples:
        own = sorted(kept & set(tokens))
        for size in range(1, len(own) + 1):
            for chosen in combinations(own, size):
                counts.setdefault(chosen, {}).setdefault(verdict, 0)
                counts[chosen][verdict] += 1
    return {(c, v): m for c, by in counts.items() for v, m in by.items() if m >= least and m / sum(by.values()) >= confidence}


def test_mined_rules_match_brute_force(spark):
    urls = [(f"http://{'www.' if i % 3 else ''}s{i % 4}.org/{'es' if i % 5 == 0 else 'en'}/{i}{'?a=1&b=2' if i % 2 else ''}", "block" if i % 5 == 0 or i % 7 == 0 else "allow") for i in range(80)]
    labelled = spark.createDataFrame(urls, "url string, verdict string")
    tokens = {r["url"]: r["t"] for r in labelled.select("url", url_filter.tokens_of(labelled["url"]).alias("t")).collect()}
    for support, confidence in ((0.05, 0.75), (0.2, 0.5)):
        rules = url_filter.mine(labelled, support, confidence).collect()
        assert {(tuple(r["tokens"]), r["verdict"]): r["n"] for r in rules} == brute_rules([(tokens[u], v) for u, v in urls], support, confidence)
        assert all(r["token"] in r["tokens"] for r in rules) and len(rules) > 5


def test_mined_rules_judge_what_no_rule_lists(spark):
    urls = [f"http://h{i}.org/es/{i}" for i in range(10)] + [f"http://h{i}.org/en/{i}" for i in range(10)] + ["http://other.net/es/7", "http://other.net/en/7", "http://other.net/it/7"]
    rules = url_filter.rule_table(spark, [("org", "/es/", "block"), ("org", "/en/", "allow")])
    got = {r["url"]: (r["rule"], r["verdict"], r["tokens"]) for r in url_filter.judge(pages(spark, urls * 2), rules).collect()}
    assert got["http://other.net/es/7"] == (None, "block", ["p:es"])
    assert got["http://other.net/en/7"] == (None, "allow", ["p:en"])
    assert got["http://h3.org/es/3"][:2] == ("org/es/", "block")


def test_shuffled_index_gives_the_same(spark, monkeypatch, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    few = sorted(map(str, url_filter.judge(table, url_filter.rule_table(spark)).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(str, url_filter.judge(table, url_filter.rule_table(spark)).collect())) == few


def test_odd_tables(spark):
    rules = url_filter.rule_table(spark)
    assert url_filter.judge(pages(spark, URLS).limit(0), rules).collect() == []
    assert [r["verdict"] for r in url_filter.judge(pages(spark, [None, "x"]), rules).collect()] == ["allow", "allow"]
    assert [r["rule"] for r in url_filter.judge(pages(spark, ["http://a.org/"] * 3), rules).collect()] == ["org/"] * 3
    long = "http://" + "a." * 3000 + "org/" + "w/" * 20_000
    got = url_filter.judge(pages(spark, [long, "http://b.org/w/"]), rules).collect()
    assert {r["rule"] for r in got} == {"org/"} and max(len(r["path"]) for r in got) == 40_001
    twice = url_filter.rule_table(spark, [("org", "/", "allow"), ("org", "/", "block"), ("org", "/", "allow")])
    assert url_filter.judge(pages(spark, ["http://a.org/"]), twice).first()["verdict"] == "block"
