import pytest
from pyspark.sql import functions as F

from pathloom.functions.arrow import resolve_reference
from pathloom.functions.urls import canonical_url, resolved_urls
from pathloom.operators import urls

BASE = "https://example.com/a/b/c?x=1"
RESOLVED = [
    ("HTTPS://Example.com:443/c d?x=ü#f", None, "https://example.com/c%20d?x=%C3%BC"),
    ("https://example.com", None, "https://example.com/"),
    ("https://example.com/a b|c", None, "https://example.com/a%20b|c"),
    ("https://example.com/plain?q=1#frag", None, "https://example.com/plain?q=1"),
    ("/für", BASE, "https://example.com/f%C3%BCr"),
    ("/plain/x.html?q=1#z", BASE, "https://example.com/plain/x.html?q=1"),
    ("../d", BASE, "https://example.com/a/d"),
    ("./", BASE, "https://example.com/a/b/"),
    ("/../../x", BASE, "https://example.com/x"),
    ("/a/./b/../c", BASE, "https://example.com/a/c"),
    ("?q", BASE, "https://example.com/a/b/c?q"),
    ("", BASE, BASE),
    ("#z", BASE, BASE),
    ("//Other.org\\x", BASE, "https://other.org/x"),
    ("https:foo", BASE, "https://example.com/a/b/foo"),
    ("http:foo", BASE, "http://foo/"),
    ("mailto:a@b", BASE, None),
    ("javascript:void(0)", BASE, None),
    ("foo", None, None),
    ("https://bücher.de/", None, "https://xn--bcher-kva.de/"),
    ("http://2130706433/", None, "http://127.0.0.1/"),
    ("http://0x7f.1/", None, "http://127.0.0.1/"),
    ("http://1.2.3.400/", None, None),
    ("http://a b/", None, None),
    ("http://h:99999/", None, None),
    ("http://h.x:8080/%2e%2E/p", None, "http://h.x:8080/p"),
    ("http://[::1]/", None, "http://[::1]/"),
    ("http://u:p@h.com/", None, "http://u:p@h.com/"),
    (" /a\tb ", BASE, "https://example.com/ab"),
    ("https://example.com?x", None, "https://example.com/?x"),
    ("https://e.com/a.b/c..d/.e?", None, "https://e.com/a.b/c..d/.e?"),
    ("https://e.com/q?a='b'", None, "https://e.com/q?a=%27b%27"),
]


def test_references_resolve_like_in_browsers(spark):
    rows = [(i, *case) for i, case in enumerate(RESOLVED)]
    df = spark.createDataFrame(rows, "i int, href string, base string, want string")
    got = canonical_url(df, "href", "got", "base").orderBy("i").collect()
    assert [row.got for row in got] == [case[2] for case in RESOLVED]


def test_array_form_equals_single_form(spark):
    hrefs = [case[0] for case in RESOLVED]
    df = spark.createDataFrame([(hrefs, BASE)], "hrefs array<string>, base string")
    got = resolved_urls(df, "hrefs", "out", "base").first().out
    assert got == [resolve_reference(href, BASE) for href in hrefs]


def test_short_path_agrees_with_the_full_rules(spark, corpus):
    from pathloom.operators.contents import link_edges

    urls_ = [row.url for row in corpus["pages"].select("url").collect()]
    for row in canonical_url(corpus["pages"], "url", "out").select("url", "out").collect():
        assert row.out == resolve_reference(row.url, None)
    assert len(urls_) == 50
    assert link_edges(corpus["site_pages"]).filter("dst RLIKE '[^ -~]'").count() == 0


@pytest.mark.parametrize(
    "host,refused",
    [("127.9.8.7", True), ("10.77.1.2", True), ("169.254.3.3", True), ("[fe80::9]", True), ("100.99.0.1", True), ("0.1.2.3", True), ("localhost", True),
     ("db.localhost.", True), ("printer.local", True), ("wiki", True), ("mill.example", False), ("8.8.4.4", False), ("a.b.example", False)],
)
def test_host_screening(spark, host, refused):
    row = urls.screen_hosts(spark.createDataFrame([(host,)], "host string")).first()
    assert (row.reason is not None) == refused


def test_domains_typed_by_people(spark):
    typed = [" Example.com/path ", "http://example.com:8080/x", "", "ftp://example.com", "localhost", "exa mple.com"]
    df = spark.createDataFrame([(i, text) for i, text in enumerate(typed)], "i int, domain string")
    rows = urls.sites_from_input(df).orderBy("i").collect()
    assert [row.origin for row in rows] == ["https://example.com", "http://example.com:8080", None, None, None, None]
    assert [row.reject_reason is None for row in rows] == [True, True, False, False, False, False]


def test_slugs(spark):
    cases = ["https://mill.example/Trees/Old_Oak!/?leaf=2", "https://mill.example/", "https://mill.example/" + "oak/" * 40]
    got = urls.capture_slug(spark.createDataFrame([(c,) for c in cases], "url string")).collect()
    assert [row.slug for row in got] == ["trees-old-oak-leaf-2", "home", "-".join(["oak"] * 40)]
    assert urls.capture_slug(spark.createDataFrame([(cases[2],)], "url string"), most=7).first().slug == "oak-oak"


def test_no_item_of_a_job_is_left_out(spark):
    long = "https://mill.example/" + "x" * 700
    rows = [("j", "mill.example", i, f"https://mill.example/{i}", "/" + "y" * 600) for i in range(6000)] + [("j", "mill.example", 9000, long.replace("mill", "bank"), "/")]
    items, rejected = urls.site_scope_items(spark.createDataFrame(rows, "job_id string, site string, seq long, url string, pattern string"))
    assert items.count() == 6000 and items.filter("length(pattern) = 601").count() == 6000
    assert rejected.first().reject_reason.endswith("x" * 700)


def test_first_seen_keeps_order_and_reports_the_cap(spark):
    rows = [("s", 1, "b"), ("s", 2, "a"), ("s", 3, "b"), ("s", 9, "c"), ("t", 1, "x")]
    df = spark.createDataFrame(rows, "site string, seq long, url string")
    got = urls.first_seen_urls(df, cap=3, width=2).orderBy("site", "position").collect()
    assert [(r.site, r.position, r.url, r.truncated) for r in got] == [
        ("s", 1, "b", True), ("s", 2, "a", True), ("s", 3, "c", True), ("t", 1, "x", False)]


def test_job_items_stay_on_the_site(spark):
    rows = [
        ("j", "tips.example", 0, "https://www.tips.example/a#x", "/a"),
        ("j", "tips.example", 1, "https://tips.example/a", "bad"),
        ("j", "tips.example", 2, "https://www.tips.example/a", "/z"),
        ("j", "tips.example", 3, "https://other.example/", "/"),
        ("j", "tips.example", 4, "nonsense", "/"),
        ("j", "tips.example", 5, "https://tips.example/b", "/b"),
    ]
    items, rejected = urls.site_scope_items(spark.createDataFrame(rows, "job_id string, site string, seq long, url string, pattern string"), cap=2)
    assert [(r.idx, r.url, r.pattern) for r in items.orderBy("idx").collect()] == [
        (0, "https://www.tips.example/a", "/a"), (1, "https://tips.example/a", "/")]
    assert [r.seq for r in rejected.orderBy("seq").collect()] == [3, 4]


def test_common_origin_prefers_the_fallback_on_ties(spark):
    rows = [("s", 1, "http://s/a"), ("s", 2, "https://s/b"), ("t", 1, "http://t/a"), ("t", 2, "http://t/b"), ("t", 3, "https://t/c")]
    df = spark.createDataFrame(rows, "site string, seq long, url string")
    fallback = spark.createDataFrame([("s", "https://s"), ("t", "https://t")], "site string, fallback_origin string")
    got = {r.site: r.origin for r in urls.common_origin(df, fallback).collect()}
    assert got == {"s": "https://s", "t": "http://t"}


def test_partner_and_asset_paths(spark):
    cases = {"https://a.b/go/x": (True, True), "https://a.b/GOTO/": (True, True), "https://a.b/go": (False, True),
             "https://a.b/i/x.JPG": (False, False), "https://a.b/x.jpg/": (False, True), "https://a.b/x?y=.jpg": (False, True)}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    flags = {r.url: r.affiliate for r in urls.screen_affiliate(df).collect()}
    kept = {r.url for r in urls.screen_assets(df).collect()}
    assert {u: (flags[u], u in kept) for u in cases} == cases


def test_compact_and_back(spark):
    df = spark.createDataFrame([("https://a.b/x",), ("https://a.bc/x",), ("https://a.b/",)], "url string").withColumn("site_origin", F.lit("https://a.b"))
    rows = urls.compact_urls(df).collect()
    assert [r.compact for r in rows] == ["/x", "https://a.bc/x", "/"] and all(r.restored == r.url for r in rows)
