"""robots texts, sitemaps, crawls and redirects."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pathloom.functions.text import iso_text
from pathloom.operators import graph, robots, sitemaps

ROBOTS = """# kept short
User-agent: Archiver
Disallow: /

User-agent: *
Crawl-delay: 2.5
Disallow: /attic
Allow: /attic/open
Disallow: /*.cgi$
Disallow: /find*sort=
Sitemap: /map/all.xml"""


def texts(spark, **named):
    return spark.createDataFrame([(site, f"https://{site}", text) for site, text in named.items()], "site string, origin string, text string")


def allowed(spark, text, urls, agent=robots.OWN_AGENT):
    df = spark.createDataFrame([("s", i, url) for i, url in enumerate(urls)], "site string, seq long, url string")
    return [r.allowed for r in robots.robots_allowed(df, texts(spark, s=text), agent).orderBy("seq").collect()]


def test_longest_rule_wins(spark):
    b = "https://mill.example"
    wanted = {"/attic/box": False, "/attic/open/door": True, "/count.cgi": False, "/count.cgi?n=2": True, "/find?w=oak&sort=age": False, "/oak": True, "/robots.txt": True}
    assert dict(zip(wanted, allowed(spark, ROBOTS, [b + path for path in wanted]))) == wanted
    assert allowed(spark, ROBOTS, [f"{b}/oak"], "archiver") == [False]
    row = robots.scan_robots_sitemaps(texts(spark, **{"mill.example": ROBOTS})).collect()
    assert [r.url for r in row] == [f"{b}/map/all.xml"]
    assert robots.robots_groups(texts(spark, s=ROBOTS)).filter("group_id = 2").first().crawl_delay == 2.5


def test_rules_far_down_a_long_text_count(spark):
    text = "User-agent: *\n" + "Disallow: /never/seen\n" * 6000 + "Disallow: /last\n"
    answers = spark.createDataFrame([("s", 200, "text/plain", text)], "site string, status int, content_type string, body string")
    kept = robots.scan_robots(answers).withColumn("origin", F.lit("https://s"))
    df = spark.createDataFrame([("s", 0, "https://s/last/x")], "site string, seq long, url string")
    assert len(text) > 100_000 and robots.robots_allowed(df, kept).first().allowed is False
    assert robots.scan_robots(answers, most=14).first().text == "User-agent: *\n"


def test_wildcards_between_and_at_the_end(spark):
    text = "User-agent: *\nDisallow: /a*b*c\nDisallow: /x*$\nDisallow: /e*end$\nDisallow: *mid\nDisallow: /q$\nAllow: /same\nDisallow: /same"
    b = "https://s"
    cases = {"/a1b2c3": False, "/acb": True, "/xyz?q": False, "/e-end": False, "/e-end-end": False, "/e-end-": True, "/zzmidzz": False,
             "/q": False, "/qq": True, "/same": True, "/e": True, "/eend": False}
    assert dict(zip(cases, allowed(spark, text, [b + p for p in cases]))) == cases


def test_group_boundaries(spark):
    text = "User-agent: a\nSitemap: /x\nunknown: 1\nUser-agent: b\nDisallow:\nUser-agent: c\nCrawl-delay:\nUser-agent:\nDisallow: /d # why\n"
    rows = {r.group_id: r for r in robots.robots_groups(texts(spark, s=text)).collect()}
    assert [rows[i].agents for i in (1, 2, 3)] == [["a", "b"], ["c"], [""]]
    assert [[(r.allow, r.path) for r in rows[i].rules] for i in (1, 2, 3)] == [[], [], [(False, "/d")]]
    assert rows[2].crawl_delay == 0.0
    # An empty name is the beginning of every name.
    assert [r.group_id for r in robots.robots_agent_groups(texts(spark, s=text), "zbot").collect()] == [3]


def test_ai_crawlers(spark):
    text = "User-agent: gptbot\nDisallow: /\n\nUser-agent: CCBot\nAllow: /oak\nDisallow: /attic\n\nUser-agent: *\nDisallow:"
    got = {(r.site, r.bot): (r.access, r.own_group) for r in robots.ai_bot_access(texts(spark, s=text, empty="")).collect()}
    assert got["s", "GPTBot"] == ("blocked", True) and got["s", "CCBot"] == ("partly blocked", True)
    assert got["s", "ClaudeBot"] == ("allowed", False) and got["empty", "GPTBot"] == ("allowed", False) and len(got) == 12


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "site string, sitemap_url string, xml string")


DATES = {
    "2019-03-04": "2019-03-04T00:00:00.000Z",
    "2019-03": "2019-03-01T00:00:00.000Z",
    "2019-03-04T05:06Z": "2019-03-04T05:06:00.000Z",
    "2019-03-04T05:06+02:00": "2019-03-04T03:06:00.000Z",
    "2019-03-04T05:06:07.5-01:30": "2019-03-04T06:36:07.500Z",
    "2019/03/04": "2019-03-04T00:00:00.000Z",
    "2019-3-4": "2019-03-04T00:00:00.000Z",
    "March 4, 2019": "2019-03-04T00:00:00.000Z",
    "04 Mar 2019": "2019-03-04T00:00:00.000Z",
    "Mon, 04 Mar 2019 05:06:07 GMT": "2019-03-04T05:06:07.000Z",
    "last week": None,
}


def test_sitemap_documents(spark):
    entry = lambda i, day: f"<url><loc>https://mill.example/oak/{i}</loc><lastmod>{day}</lastmod><video:video><video:thumbnail_loc>https://mill.example/t.png</video:thumbnail_loc></video:video></url>"
    given = docs(
        spark,
        ("s", "u", f'<?xml version="1.0"?><urlset xmlns:video="v">{"".join(entry(i, d) for i, d in enumerate(DATES))}</urlset>'),
        ("s", "same", "<urlset>" + "".join(f"<url><loc>https://mill.example/{i}</loc><lastmod>{'2019-03-04' if i else '2020-01-01'}</lastmod></url>" for i in range(12)) + "</urlset>"),
        ("s", "i", "<sitemapindex><sitemap><loc><![CDATA[https://mill.example/part.xml?n=1&amp;m=2]]></loc></sitemap></sitemapindex>"),
        ("s", "h", "<html><p>no list</p></html>"),
        ("s", "bare", "<urlset><loc>https://mill.example/elm</loc><loc>tel:1</loc></urlset>"),
    )
    rows = sitemaps.sitemap_entries(given)
    assert {r.sitemap_url: r["count"] for r in rows.groupBy("sitemap_url").count().collect()} == {"u": len(DATES), "same": 12, "i": 1, "bare": 1}
    assert rows.filter("sitemap_url = 'i'").first().loc == "https://mill.example/part.xml?n=1&m=2"
    read = rows.filter("sitemap_url = 'u'").orderBy("pos").select(iso_text(F.col("lastmod")).alias("day")).collect()
    assert dict(zip(DATES, [r.day for r in read])) == DATES
    stats = {r.sitemap_url: r for r in sitemaps.sitemap_stats(given).collect()}
    assert (stats["u"].urls, stats["u"].with_lastmod, stats["u"].video, stats["u"].image, stats["u"].auto_lastmod) == (11, 10, True, False, False)
    assert (stats["same"].distinct_lastmod, stats["same"].auto_lastmod) == (2, True)


def test_element_texts_as_the_plain_pattern_finds_them(spark):
    rng = random.Random(5)
    bits = ["<url>", "<URL a='1'>", "</url>", "</url >", "<urlset>", "<loc>", "</loc>", "x", " ", "\n", "<", ">", "url", "</urlset>"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, xml string").select("i", sitemaps.inner_texts(F.col("xml"), "url").alias("found"))
    assert {r.i: r.found for r in frame.collect()} == {i: re.findall(r"(?is)<url(?:\s[^<>]*)?>(.*?)</url\s*>", text) for i, text in enumerate(cases)}


@pytest.mark.parametrize("broken", ["<url><loc>", "<url ", "<loc><![CDATA[", "<url><loc></loc><lastmod>", "</url "])
def test_unclosed_tags_take_linear_time(spark, broken):
    given = docs(spark, ("s", "u", "<urlset>" + broken * (3_000_000 // len(broken))), ("s", "v", "<urlset><url>" + broken * 100_000 + "</url>"))
    begin = time.monotonic()
    sitemaps.sitemap_entries(given).collect()
    assert time.monotonic() - begin < 10


def test_sitemaps_from_robots_and_index(spark):
    o = "https://mill.example"
    text = f"Sitemap: {o}/map/all.xml\nSitemap: https://store.internal/x.xml\nUser-agent: *\nDisallow: /attic"
    listed = robots.scan_robots_sitemaps(texts(spark, **{"mill.example": text}))
    origins = spark.createDataFrame([("mill.example", o)], "site string, origin string")
    seeds = sitemaps.sitemap_seeds(listed, origins, origins.select("site")).select("site", "pos", "url")
    assert [r.url for r in seeds.collect()] == [f"{o}/map/all.xml"]
    given = docs(
        spark,
        ("mill.example", f"{o}/map/all.xml", f"<sitemapindex><sitemap><loc>http://192.168.7.7/in.xml</loc></sitemap><sitemap><loc>{o}/map/trees.xml</loc></sitemap></sitemapindex>"),
        ("mill.example", f"{o}/map/trees.xml", f"<urlset><url><loc>{o}/oak</loc></url><url><loc>{o}/elm</loc><lastmod>2019-03</lastmod></url></urlset>"),
        ("mill.example", "http://192.168.7.7/in.xml", f"<urlset><url><loc>{o}/hidden</loc></url></urlset>"),
    )
    urls, read, summary = graph.expand_sitemaps(seeds, given)
    rows = urls.orderBy("position").collect()
    assert [r.url for r in rows] == [f"{o}/oak", f"{o}/elm"]
    assert rows[0].lastmod is None and rows[1].lastmod is not None and read.count() == 2
    assert (summary.first().urls, summary.first().truncated) == (2, False)
    capped, _, cut = graph.expand_sitemaps(seeds, given, max_sitemaps=1, max_urls=1)
    assert capped.count() == 0 and (cut.first().skipped, cut.first().truncated) == (1, True)


def test_many_sitemaps_are_all_read(spark):
    o = "https://mill.example"
    names = [f"{o}/map/{i}.xml" for i in range(75)]
    rows = [("s", f"{o}/map/all.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>")]
    rows += [("s", n, f"<urlset><loc>{o}/tree/{i}</loc></urlset>") for i, n in enumerate(names)]
    seeds = spark.createDataFrame([("s", 0, f"{o}/map/all.xml")], "site string, pos long, url string")
    urls, _, summary = graph.expand_sitemaps(seeds, docs(spark, *rows))
    assert [r.url for r in urls.orderBy("position").collect()] == [f"{o}/tree/{i}" for i in range(75)]
    assert (summary.first().sitemaps, summary.first().skipped, summary.first().truncated) == (76, 0, False)


def test_later_lastmod_wins_and_order_is_first_seen(spark):
    given = docs(
        spark,
        ("s", "https://s.example/1.xml", "<urlset><url><loc>https://s.example/a</loc><lastmod>2026-01-01</lastmod></url><url><loc>https://s.example/b</loc></url></urlset>"),
        ("s", "https://s.example/2.xml", "<urlset><url><loc>https://s.example/c</loc></url><url><loc>https://s.example/a</loc><lastmod>2025-01-01</lastmod></url></urlset>"),
    )
    seeds = spark.createDataFrame([("s", 0, "https://s.example/1.xml"), ("s", 1, "https://s.example/2.xml")], "site string, pos long, url string")
    for width in (None, 1):
        urls, _, _ = graph.expand_sitemaps(seeds, given, width=width)
        rows = urls.orderBy("position").collect()
        assert [r.url[-1] for r in rows] == ["a", "b", "c"] and rows[0].lastmod.year == 2025
    urls, _, summary = graph.expand_sitemaps(seeds, given, max_urls=2)
    assert urls.count() == 2 and summary.first().truncated


def test_crawl_keeps_to_the_site(spark):
    o, away = "https://mill.example", "https://bank.example"
    reads = {"/": "/", "/oak": "/oak", "/left": away + "/x", "/visit/bank": away + "/", "/same-oak": "/oak", "/broken": "/broken"}
    full = lambda place: place if place.startswith("http") else o + place
    pages = spark.createDataFrame([("mill.example", full(a), full(b), a != "/broken") for a, b in reads.items()], "site string, url string, final_url string, ok boolean")
    links = ["/oak", "/visit/bank", "/refer/y", "/left", "/leaf.jpeg", "/same-oak", "/broken", "/attic/x"]
    edges = spark.createDataFrame([("mill.example", f"{o}/", i, o + link) for i, link in enumerate(links)], "site string, src string, pos long, dst string")
    origins = spark.createDataFrame([("mill.example", o)], "site string, origin string")
    text = texts(spark, **{"mill.example": ROBOTS})
    found, summary = graph.crawl_frontier(origins, pages, edges, text)
    assert [r.url for r in found.orderBy("position").collect()] == [f"{o}/", f"{o}/oak"]
    assert (summary.first().attempted, summary.first().truncated) == (5, False)
    _, cut = graph.crawl_frontier(origins, pages, edges, text, cap=2)
    assert (cut.first().attempted, cut.first().truncated) == (2, True)
    closed = texts(spark, **{"mill.example": "User-agent: *\nDisallow: /"})
    assert graph.crawl_frontier(origins, pages, edges, closed)[0].count() == 0


def test_redirects(spark):
    b = "https://mill.example"
    hops = [(f"{b}/old", 308, "/older"), (f"{b}/older", 302, "now"), *[(f"{b}/step{i}", 307, f"/step{i + 1}") for i in range(9)],
            (f"{b}/ring1", 302, "/ring2"), (f"{b}/ring2", 302, "/ring3"), (f"{b}/ring3", 302, "/ring1"), (f"{b}/self", 301, "/self"),
            (f"{b}/visit/bank", 302, "https://bank.example/?from=mill"), (f"{b}/inside", 302, "http://172.16.3.4/keys"), (f"{b}/empty", 302, "http://"),
            (f"{b}/fine", 200, "/nowhere")]
    df = spark.createDataFrame(hops, "url string, status int, location string")
    starts = df.select("url").unionByName(spark.createDataFrame([(f"{b}/unknown",)], "url string"))
    rows = {r.url[len(b):]: r for r in graph.resolve_redirects(starts, df).collect()}
    assert len(rows) == len(hops) + 1
    assert rows["/old"].final_url == f"{b}/now" and [h.status for h in rows["/old"].chain] == [308, 302] and rows["/old"].error is None
    assert (rows["/step0"].final_url, rows["/step0"].hops, rows["/step0"].error) == (f"{b}/step9", 9, None)
    assert (rows["/ring1"].error, rows["/ring1"].hops) == ("redirect-loop", 3) and (rows["/self"].error, rows["/self"].hops) == ("redirect-loop", 1)
    assert (rows["/inside"].error, rows["/inside"].final_url, rows["/inside"].hops) == ("private", f"{b}/inside", 1)
    assert rows["/empty"].error == "invalid-url" and rows["/fine"].hops == 0 and rows["/unknown"].final_url == f"{b}/unknown"
    short = {r.url[len(b):]: r for r in graph.resolve_redirects(starts, df, max_hops=5).collect()}
    assert (short["/step0"].error, short["/step0"].hops) == ("too-many-redirects", 5) and short["/step5"].error is None
    kept = {r.url: r for r in graph.resolve_redirects(starts, df, stay_on_site=True).collect()}[f"{b}/visit/bank"]
    assert kept.off_site == "https://bank.example/?from=mill" and kept.final_url == f"{b}/visit/bank"


def followed(url, step, max_hops):
    """One chain, hop by hop: final URL, URLs that were left, error."""
    chain = []
    while url in step:
        chain.append(url)
        if max_hops is not None and len(chain) >= max_hops:
            return url, chain, "too-many-redirects"
        if step[url] in chain:
            return url, chain, "redirect-loop"
        url = step[url]
    return url, chain, None


@pytest.mark.parametrize("max_hops", [None, 3])
def test_redirect_graphs(spark, max_hops):
    """Trees, circles with tails and one URL that most others lead to; repeated and null starts."""
    rng = random.Random(5)
    name = lambda i: f"https://mill.example/n{i}"
    step = {name(i): name(rng.choice([0, i // 2, rng.randrange(300)])) for i in range(1, 250)}
    step |= {name(400 + i): name(400 + (i + 1) % 37) for i in range(37)} | {name(500 + i): name(501 + i) for i in range(20)} | {name(520): name(411)}
    starts = [*step, name(0), name(299), name(1), name(1), None]
    hops = spark.createDataFrame([(a, 301, b) for a, b in step.items()], "url string, status int, location string")
    got = graph.resolve_redirects(spark.createDataFrame([(u,) for u in starts], "url string"), hops, max_hops=max_hops)
    found = [(r.url, r.final_url, [h.url for h in r.chain], [h.location for h in r.chain], r.error, r.hops) for r in got.collect()]
    want = [(u, end, chain, [step[c] for c in chain], error, len(chain)) for u in starts for end, chain, error in [followed(u, step, max_hops)]]
    order = lambda row: (row[0] is None, row[0] or "")
    assert sorted(found, key=order) == sorted(want, key=order)


def test_long_redirect_chain_takes_few_rounds(spark):
    from pathloom.plans.jump import doubled

    steps = spark.createDataFrame([(f"https://mill.example/{i}", f"https://mill.example/{i + 1}") for i in range(1000)], "node string, next string")
    tables, endless = doubled(steps)
    assert len(tables) == 11 and endless == 0
    hops = steps.selectExpr("node AS url", "302 AS status", "next AS location")
    row = graph.resolve_redirects(steps.filter("node LIKE '%/0'").selectExpr("node AS url").limit(1), hops).first()
    start = int(row.url.rsplit("/", 1)[1])
    assert (row.final_url, row.hops, row.error) == ("https://mill.example/1000", 1000 - start, None)
    assert [h.url for h in row.chain] == [f"https://mill.example/{i}" for i in range(start, 1000)]
    none = graph.resolve_redirects(hops.select("url"), hops.limit(0))
    assert none.filter("hops > 0 OR error IS NOT NULL OR final_url <> url").isEmpty()


def test_second_mapping_only_when_it_found_more(spark):
    rows = [("one", 0, "a"), ("one", 1, "a"), ("one", 1, "b"), ("many", 0, "a"), ("many", 0, "b"), ("many", 1, "a"), ("many", 1, "b"), ("many", 1, "c"),
            ("same", 0, "a"), ("same", 1, "b"), ("late", 1, "x")]
    got = {r.site: r.attempt for r in graph.remap_choice(spark.createDataFrame(rows, "site string, attempt int, url string")).collect()}
    assert got == {"one": 1, "many": 0, "same": 0, "late": 1}
