import math

from cohortspan.llm import url_filter
from cohortspan.llm.queries import URL_RULES
from pyspark.sql import functions as F
from tests.llm.conftest import with_clashes

URLS = {
    None: ("", "", None),
    "no scheme": ("", "", None),
    "http://Sub.NET/x?y#z": ("sub.net", "/x", "net/"),
    "http://net": ("net", "", None),
    "http://net/": ("net", "/", "net/"),
    "http://planet/": ("planet", "/", None),
    "http://example.net/en/1": ("example.net", "/en/1", "example.net/en/"),
    "http://a.example.net/en/": ("a.example.net", "/en/", "example.net/en/"),
    "http://a.example.net/EN/": ("a.example.net", "/EN/", "net/"),
    "http://example.com/de/?q": ("example.com", "/de/", "example.com/de/"),
    "http://x.org/fr/#a": ("x.org", "/fr/", "org/fr/"),
    "a://b://c?d": ("b:", "//c", None),
    "http://ÄB.Com?x/y": ("Äb.com", "", None),
    "http://h/" + "p" * 50_000: ("h", "/" + "p" * 50_000, None),
    "": ("", "", None),
}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://net/", None)], "page_id long, url string, html string")
    found = url_filter.judge(with_clashes(pages), URL_RULES).collect()
    verdicts = {n + p: v for v, n, p in URL_RULES}
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(URLS) + 1 and by_id[None].rule == "net/"
    for i, (host, path, rule) in enumerate(URLS.values()):
        row = by_id[i]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdicts[rule] if rule else "allow")
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.example.com": "example.com", "x.co.uk": "x.co.uk", "a.x.co.uk": "x.co.uk", "localhost": "", "example.de": "example.de"}
    frame = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r[0]: r[1] for r in frame.select("h", url_filter.registered_domain(F.col("h"))).collect()} == hosts


def test_posterior(spark):
    """Two bad pages condemn a host of a bad domain, not one of a good domain."""
    rows = [("one.bad.com", 1)] * 2 + [("many.bad.com", 1)] * 200 + [("one.good.org", 1)] * 2 + [("many.good.org", 0)] * 200
    rows += [(f"h{i}.mixed.net", int(i % 5 == 0)) for i in range(50) for _ in range(20)] + [("", 1), (None, 1), ("h0.mixed.net", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    found = {r.host: r for r in url_filter.host_reputation(url_filter.outcomes_by_host(outcomes)).collect()}
    assert set(found) == {h for h, _ in rows if h}
    assert found["many.bad.com"].lower >= found["one.bad.com"].lower > 0.5 > found["one.good.org"].lower
    assert found["many.good.org"].mean < 0.1 and found["h5.mixed.net"].mean > 0.5 > found["h6.mixed.net"].mean
    for r in found.values():
        assert 0 <= r.mean <= 1 and r.lower <= r.mean and not math.isnan(r.lower)


def test_given_outcomes_judge(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/x"), (2, "http://good.com/x")], "page_id long, url string")
    rows = [("bad.com", 1)] * 90 + [("good.com", 0)] * 90
    found = url_filter.judge(pages, (), spark.createDataFrame(rows, "host string, bad int")).collect()
    assert {r.page_id: r.verdict for r in found} == {1: "block", 2: "allow"}


def page(words, spam=0, links=0):
    return "<html><body>" + '<a href="/x">more</a> ' * links + "<p class='casino'>" + "word " * words + "casino " * spam + "</p></body></html>"


def test_pages_are_evidence(spark):
    clean, wordy, farm = page(200), page(60, spam=5), page(5, links=30)
    html = [clean, wordy, farm, None, "", page(200, spam=2), page(1000, spam=5), page(200, links=30), "<a" * 9 + "< casino " * 4]
    urls = ["http://h/x"] * len(html) + ["http://h/free-pills/1", "http://h/pillship", "http://casino.com/"]
    pages = spark.createDataFrame([(i, u, h, "s") for i, (u, h) in enumerate(zip(urls, [*html, None, None, None]))], "page_id long, url string, html string, host string")
    found = [r[0] for r in pages.orderBy("page_id").select(url_filter.page_is_bad(pages)).collect()]
    assert found == [False, True, True, False, False, False, False, False, False, True, False, True]


def test_reputation_against_the_word_list(spark):
    """Shrinkage decides both ways: a host named like spam is allowed, and clean pages of a bad host are blocked."""
    clean, bad = page(200), page(60, spam=5)
    rows = [("http://good%d.site.org/%d" % (i % 20, i), clean) for i in range(400)]
    rows += [("http://one-casino.site.org/a", clean)]
    rows += [("http://farm%d.junk.info/%d" % (i % 10, i), bad) for i in range(200)]
    rows += [("http://new.junk.info/%d" % i, bad if i % 10 else clean) for i in range(40)]
    rows += [("http://large.site.org/%d" % i, bad if i % 10 == 0 else clean) for i in range(200)]
    rows += [("http://silent.junk.info/", None)]
    rows *= 2  # Repeated rows are counted each.
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    verdicts = {}
    for r in url_filter.judge(pages, ()).collect():
        verdicts.setdefault(r.host, set()).add(r.verdict)
    assert verdicts["one-casino.site.org"] == {"allow"} == verdicts["large.site.org"] == verdicts["silent.junk.info"]
    assert verdicts["new.junk.info"] == {"block"} == verdicts["farm3.junk.info"]
    assert verdicts["good3.site.org"] == {"allow"}


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/x")], "page_id long, url string")
    plan = url_filter.judge(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
