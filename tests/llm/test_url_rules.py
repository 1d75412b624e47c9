import random
import re

from pyspark.sql import functions as F

from paddyframe.llm import url_rules
from paddyframe.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = []
    for h, p, v in rules:
        if h is None or v not in ("allow", "block"):
            continue
        h, p = re.sub("[A-Z]", lambda c: c[0].lower(), h), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((len(h + p), len(h), v == "block", h + p, v))
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")


def told(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_given_rules(spark):
    urls = ["http://a.net/x", "http://net/", "http://net", "http://net?x=/", "https://EXAMPLE.net/en/1", "http://b.example.net/en",
            "http://b.example.net/en/?q#f", "http://xexample.net/en/1", "http://example.com/de/#a", "http://example.com/dex", "http://w.org/fr/",
            "http://w.org/FR/", "http://net.org/fr", "x://y://z.net/", "://q.net/", "no scheme.net/", "", None, "http:///en/", "http://example.net./en/",
            "http://.net/", "http://a.net:80/", "HTTP://Ä.NET/", "http://a.net/\nb?c", "http://a.net#/", "http://" + "a." * 5000 + "net/" + "p/" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = told(url_rules.judge(df, spark.createDataFrame(URL_RULES, RULES)))
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}
    assert got[4][2:] == ("example.net/en/", "allow") and got[0][2:] == ("net/", "block") and got[16] == ("", "", None, "allow")


def test_many_rules_against_brute_force(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "net", "co", "x-y", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "b", "//", ""]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), rng.choice(["", "/"]) + path(), rng.choice(["allow", "block"])) for _ in range(300)]
    rules += [(None, "/", "block"), ("a", None, "block"), ("b", "/", "maybe"), ("b", "/", None), ("NET", "a", "block"), ("a", "/a", "allow"), ("a", "/a", "block")]
    urls = [f"h://{host()}{rng.choice(['/', '', '?', '#'])}{path()}" for _ in range(600)]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    assert told(url_rules.judge(df, spark.createDataFrame(rules, RULES))) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_short_prefix_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PREFIX_DIGITS", 1)
    test_many_rules_against_brute_force(spark)


def test_hot_host_is_expanded_once(spark):
    df = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.net/"), "id").alias("url"))
    out = url_rules.judge(df, spark.createDataFrame(URL_RULES, RULES))
    assert out.filter("verdict = 'block'").count() == 5000
    sites = df.select(url_rules.host_of(F.col("url")).alias("host"), F.substring(url_rules.path_of(F.col("url")), 1, 1).alias("head")).distinct()
    assert url_rules._expanded(sites, [1, 2], [1]).count() == 2


def test_nothing(spark):
    none = spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(pages, none).collect()] == [(1, "a.net", "/", None, "allow")] * 2 + [(None, "", "", None, "allow")]
    given = spark.createDataFrame(URL_RULES, RULES)
    assert url_rules.judge(pages.limit(0), given).count() == 0 and url_rules.judge(pages, given).count() == 3


def test_no_python_on_the_main_path(spark):
    from paddyframe.llm.queries import op13_url_filter
    out = op13_url_filter(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString()
    assert out.count() and not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
