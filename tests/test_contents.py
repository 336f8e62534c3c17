import time

import pytest
from pyspark.sql import functions as F

from pathloom.functions.text import decoded_text, parsed_date, word_count
from pathloom.operators import contents

PAGE = """<!DOCTYPE html><html LANG='en-GB' lang="de"><head>
<!-- <title>hidden</title> --><title>  Tips &amp; Odds
 | Site</title>
<meta name="" property="og:title" content="not used"><meta name="DESCRIPTION" content="">
<meta property="og:description" content="From &quot;og&quot;"><meta name=robots content='noindex, follow'>
<link rel="stylesheet" href="/s.css"><link href="../canon?x=ü" rel="Alternate CANONICAL">
<script type="application/ld+json">{"@type":["WebPage","Thing"],"@graph":[{"@type":"Article","mainEntity":{"@type":"Person"}}],"other":{"@type":"No"}}</script>
<script type='application/ld+json'><![CDATA[ [{"@type":"Thing"},{"@type":"Event"}] ]]></script>
<script type="application/ld+json">{broken</script><style>h1{}</style></head>
<body><header>Top <a href="/top">top</a></header><svg><a href="/drawn">x</a></svg>
<h2>First &lt;b&gt;</h2><h1> Main <i>title</i></h1><h3> </h3>
<p>One<br>two   three</p><table><tr><td>a</td><td>b</td></tr></table><aside>side</aside>
<a href="mailto:x@y.z">m</a><a href="#x">f</a><a href="/in">i</a><a href="https://www.site.example/w">w</a>
<a href='https://other.example/'>o</a><a name="n">n</a><a HREF=http://third.example/a>t</a><a href="ftp://f/">f</a></body></html>"""


@pytest.fixture(scope="module")
def record(spark):
    rows = [(1, "https://site.example/dir/page", PAGE)]
    return contents.page_contents(spark.createDataFrame(rows, "page_id long, url string, html string")).first()


def test_head_of_a_page(record):
    assert record.lang == "de"
    assert record.title == "hidden"  # the title is looked for in the raw page, comments included
    assert record.description == 'From "og"'
    assert record.robots == "noindex, follow"
    assert record.canonical == "https://site.example/canon?x=%C3%BC"
    assert record.schema_types == ["WebPage", "Thing", "Article", "Person", "Event"]


def test_body_of_a_page(record):
    assert [(h.level, h.text) for h in record.headings] == [(2, "First <b>"), (1, "Main title")]
    assert record.h1 == "Main title"
    assert (record.internal_links, record.external_links) == (3, 2)
    assert record.text.split("\n") == ["First <b>", "Main title", "One", "two three", "a b", "m f i w", "o n t f"]
    assert record.word_count == 17 and record.text_truncated is False and record.needs_render is False


def test_jobs_agree_with_the_record(spark, record):
    pages = spark.createDataFrame([(1, "https://site.example/dir/page", PAGE)], "page_id long, url string, html string")
    meta = contents.page_meta(pages).first()
    assert all(meta[name] == record[name] for name in ("lang", "title", "description", "canonical", "robots"))
    links = contents.page_links(pages).first()
    assert (links.internal_links, links.external_links) == (record.internal_links, record.external_links)
    assert contents.page_text(pages).first().text == record.text
    assert contents.page_word_count(pages).first().word_count == record.word_count
    assert contents.page_schema_types(pages).first().schema_types == record.schema_types


def test_crawl_links_use_the_base_element_and_the_raw_page(spark):
    html = '<base href="/deep/"><!-- <a href="in-comment">x</a> --><a href="a">a</a><a class=x href=\'b?c=1&amp;d=2\'>b</a><a href="data:1">d</a><a href="https://o.example">o</a>'
    pages = spark.createDataFrame([("s", "https://s.example/x", html)], "site string, url string, html string")
    got = [r.dst for r in contents.link_edges(pages).orderBy("pos").collect()]
    assert got == ["https://s.example/deep/in-comment", "https://s.example/deep/a", "https://s.example/deep/b?c=1&d=2", "https://o.example/"]


def test_main_then_articles_then_body(spark):
    long = "word " * 60
    pages = [
        (1, f"<body><nav>n</nav><main>{long}</main><article>other {long}</article></body>", "word"),
        (2, f"<body><main>short</main><article>one {long}</article>x<article>two</article></body>", "one"),
        (3, "<body><nav>n</nav><main>short</main><p>rest</p></body>", "short"),
    ]
    df = spark.createDataFrame([(i, "https://s.example/", html) for i, html, _ in pages], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in contents.page_text(df).collect()}
    assert all(texts[i].startswith(first) for i, _, first in pages)
    assert texts[2].split("\n")[-1] == "two" and texts[3] == "short\nrest"


def test_long_texts_are_whole_unless_a_limit_is_given(spark):
    html = "<body>" + "ab " * 20_000 + "</body>"
    df = spark.createDataFrame([(1, "https://s.example/", html)], "page_id long, url string, html string")
    row = contents.page_contents(df).first()
    assert row.text == ("ab " * 20_000).strip() and not row.text_truncated and row.word_count == 20_000
    row = contents.page_contents(df, most_text=32_000).first()
    assert len(row.text) == 32_000 and row.text_truncated and row.word_count == 20_000
    assert contents.page_text(df).first().text == ("ab " * 20_000).strip()


def test_all_headings_are_kept(spark):
    df = spark.createDataFrame([(1, "https://s.example/", "".join(f"<h2>t{i}</h2>" for i in range(450)))], "page_id long, url string, html string")
    assert contents.page_headings(df).count() == 450 and contents.page_headings(df, most=3).count() == 3
    assert len(contents.page_contents(df).first().headings) == 450


def test_script_shells_by_both_rules(spark):
    shell = '<body><nav>' + "menu " * 100 + '</nav><div id="root"></div><script src="/a.js"></script></body>'
    df = spark.createDataFrame([(1, "https://s.example/", shell), (2, "https://s.example/", "<p>few</p>")], "page_id long, url string, html string")
    rows = contents.js_shell_pages(df).orderBy("page_id").collect()
    assert [(r.shell_for_crawl, r.needs_render) for r in rows] == [(False, True), (False, False)]


@pytest.mark.parametrize(
    "text,want",
    [("&amp;lt;", "&lt;"), ("&#38;lt;", "&lt;"), ("a&nbsp;b", "a b"), ("&#x1F600;&#128512;", "😀😀"), ("&AMP;&unknown;&#0;", "&&unknown;&#0;"),
     ("&#1114112;", "&#1114112;"), ("&copy;&euro;&hellip;", "©€…"), ("&apos;", "'"), ("plain & simple", "plain & simple"), ("&#99999999999999999999;", "&#99999999999999999999;"),
     ("&#x" + "0" * 60 + "41;", "A"), ("&#xFFFFFFFFFFFF;", "&#xFFFFFFFFFFFF;")],
)
def test_entities_are_decoded_once(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decoded_text(F.col("t"))).first()[0] == want


def test_words(spark):
    df = spark.createDataFrame([("Don't über-cool x2 — ’no é",)], "t string")
    assert df.select(word_count(F.col("t"))).first()[0] == 5


@pytest.mark.parametrize(
    "text,want",
    [("2026-10-01", "2026-10-01 00:00:00"), ("2026-10", "2026-10-01 00:00:00"), ("2026-10-06T10:00:00+02:00", "2026-10-06 08:00:00"),
     (" 2026-10-06T10:00:00.123456Z ", "2026-10-06 10:00:00.123"), ("Tue, 06 Oct 2026 10:00:30 GMT", "2026-10-06 10:00:30"), ("soon", None), ("", None)],
)
def test_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parsed_date(F.col("t")).cast("string")).first()[0] == want


def test_long_broken_pages_take_linear_time(spark):
    """Three megabytes of tags that are never closed, after one of each that is."""
    names = ["script", "style", "svg", "article", "main", "title", "nav"]
    start = "<!-- c --><h1>T</h1>" + "".join(f"<{n}>x</{n}>" for n in names)
    filler = "".join(f"<{n} a=1>y &amp; " for n in names) + "<!-- "
    html = "<body>" + start + filler * 30_000 + "</body>"
    assert len(html) > 3_000_000
    df = spark.createDataFrame([(1, "https://s.example/", html)], "page_id long, url string, html string")
    row = contents.page_contents(df).first()
    assert row.h1 == "T" and row.title == "x" and row.word_count == 4 + 7 * 30_000


def test_long_pages_give_what_short_ones_give(spark):
    filler = "".join(f"<p>{i} <b>word</b></p><script>var a='</p>';</script>" for i in range(600))
    html = PAGE.replace("<h2>First", filler + "<h2>First")
    df = spark.createDataFrame([(1, "https://site.example/dir/page", html)], "page_id long, url string, html string")
    row = contents.page_contents(df).first()
    lines = row.text.split("\n")
    assert len(html) > 16_384 and lines[:600] == [f"{i} word" for i in range(600)] and lines[600] == "First <b>"


@pytest.mark.parametrize("html", ["<h1>a " * 40_000 + "</h2>", "<script>x " * 24_000 + "</style>", "<" * 240_000, "<a " * 80_000, "<title " * 30_000 + "</title>", "<p>a" + " " * 240_000 + "b"])
def test_tags_that_never_end_take_linear_time(spark, html):
    df = spark.createDataFrame([(1, "https://s.example/", html)], "page_id long, url string, html string")
    started = time.time()
    assert contents.page_contents(df).first().title == ""
    contents.page_visible_words(df).collect()
    contents.link_edges(df, keep=()).count()
    assert time.time() - started < 60  # quadratic search takes many minutes


def test_unclosed_elements_hide_nothing(spark):
    html = "<h1>one<h2>two</h2><h1>three</h1><h1>four<style>a</style>x<script>y<style>z"
    df = spark.createDataFrame([(1, "https://s.example/", html)], "page_id long, url string, html string")
    assert [(r.level, r.text) for r in contents.page_headings(df).orderBy("pos").collect()] == [(1, "one two three")]
    assert contents.page_visible_words(df).first().visible_words == 7


def test_headings_are_worked_out_once(spark):
    """A row per heading must not put the array that holds them into a filter as well."""
    given = spark.createDataFrame([(1, "https://a.example/", "<h1>x</h1>")], "page_id long, url string, html string")
    plan = contents.page_headings(given)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 1
