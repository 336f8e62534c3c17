from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pathloom.operators import fetchlog, jobs

SEEN = datetime(2026, 10, 6, 10, 0, 0)


def bodies(spark, *rows, cap=None):
    df = spark.createDataFrame(list(rows), "i int, body binary, content_type string")
    return fetchlog.decode_bodies(df, **({"max_bytes": cap} if cap else {})).orderBy("i").collect()


def test_bodies(spark):
    rows = bodies(
        spark,
        (0, bytes([0x63, 0x61, 0x66, 0xE9]), "text/html; charset=iso-8859-1"),
        (1, bytes([0x80, 0x93, 0x41, 0x94, 0x81]), 'text/html; charset="windows-1252"'),
        (2, "﻿übung".encode(), "text/html"),
        (3, b"a\xffb", "text/html; charset=utf-8"),
        (4, "日本".encode("shift_jis"), "text/html; charset=Shift_JIS"),
        (5, "né".encode(), "text/html; charset=made-up"),
        (6, "né".encode("utf-16-le"), "text/html; charset=utf-16le"),
    )
    assert [r.text for r in rows] == ["café", "€“A”\x81", "übung", "a�b", "日本", "né", "né"]
    cut = bodies(spark, (0, b"x" * 5000, None), (1, b"x" * 1000, None), cap=1000)
    assert [(len(r.text), r.truncated) for r in cut] == [(1000, True), (1000, False)]


def test_challenges(spark):
    rows = [
        (403, "challenge", "<html></html>", True), (200, "challenge", "<html></html>", False), (200, None, "<title>\n Just a moment... </title>", True),
        (503, None, "x _cf_chl_opt y", True), (200, None, "x cf-challenge y", False), (200, None, "<title>Attention Required</title> challenge-platform", True),
        (200, None, " " * 20_000 + "<title>Just a moment...</title>", True), (403, None, "plain", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status int, cf_mitigated string, body string, want boolean")
    assert [r.bot_protection == r.want for r in fetchlog.detect_bot_protection(df).orderBy("i").collect()] == [True] * len(rows)


def test_waiting_times(spark):
    cases = [("120", 120.0), ("-5", 0.0), ("1.5", 1.5), ("Tue, 06 Oct 2026 10:00:30 GMT", 30.0), ("Tue, 06 Oct 2026 09:00:00 GMT", 0.0), ("later", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, v, SEEN) for i, (v, _) in enumerate(cases)], "i int, retry_after string, fetched_at timestamp")
    assert [r.retry_after_seconds for r in fetchlog.retry_after_seconds(df).orderBy("i").collect()] == [w for _, w in cases]


LOG = "i int, url string, final_url string, status int, error_kind string, content_type string, cf_mitigated string, retry_after string, fetched_at timestamp, body string"


def log(spark, *rows):
    full = [(i, "https://s.example/x", r.get("final", "https://s.example/x"), r.get("status", 200), r.get("kind"), r.get("type", "text/html"), r.get("cf"),
             r.get("wait"), SEEN, r.get("body", "<p>x</p>")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def test_outcomes_in_order(spark):
    rows = [dict(kind="private"), dict(kind="timeout"), dict(kind="too-many-redirects"), dict(status=403, cf="challenge"), dict(status=429, wait="7"),
            dict(status=401), dict(status=502, wait="3"), dict(status=404), dict(type="application/pdf; a=b"), dict(type=None), dict(type="application/xhtml+xml")]
    got = [r.outcome for r in fetchlog.fetch_outcome(log(spark, *rows)).orderBy("i").collect()]
    assert [o.ok for o in got] == [False] * 10 + [True]
    assert [o.retryable for o in got] == [False, True, True, False, True, False, True, False, False, False, False]
    assert [o.blocked for o in got] == [False] * 3 + [True, False, True] + [False] * 5
    assert [o.retry_after for o in got] == [None] * 4 + [7.0, None, 3.0] + [None] * 4
    assert got[8].error == "Not an HTML page (application/pdf)." and got[9].error == "Not an HTML page." and got[4].rate_limited


def test_crawl_reads_are_judged_more_strictly(spark):
    rows = [dict(kind="timeout"), dict(kind="private"), dict(final="https://other.example/"), dict(final="https://www.s.example/"), dict(status=500), dict(type="image/png")]
    got = fetchlog.crawl_read_outcome(log(spark, *rows)).orderBy("i").collect()
    assert [r.ok for r in got] == [False, False, False, True, False, False]
    assert got[2].detail == "it redirects to another site (other.example)"


PRIVATE = ["::1", "::", "fc12::9", "fdab:c::7", "fe9f::2", "::ffff:127.44.0.9", "::ffff:10.8.8.8", "::ffff:7f00:9", "10.200.0.7", "0.9.9.9", "192.0.0.77", "198.18.5.5", "239.1.1.1", "fe80::77%en1", "ff05::3"]
PUBLIC = ["2001:4860::8844", "8.8.4.4", "::ffff:8.8.4.4", "172.15.9.9", "100.63.0.1", "192.0.1.9", "not an address", "1:2:3", "1::2::3", "256.1.1.1", "12345::1", "1:2:3:4:5:6:7:8"]


@pytest.mark.parametrize("addresses,private", [(PRIVATE, True), (PUBLIC, False)])
def test_addresses(spark, addresses, private):
    df = spark.createDataFrame([(a, a) for a in addresses], "host string, address string")
    assert {r.host: r.refused for r in fetchlog.dns_screen(df).collect()} == {a: private for a in addresses}


def test_any_private_answer_refuses_the_host(spark):
    rows = [("two-faced.example", "8.8.4.4"), ("two-faced.example", "10.200.0.7"), ("mill.example", "8.8.4.4"), ("silent.example", None)]
    got = fetchlog.dns_screen(spark.createDataFrame(rows, "host string, address string")).collect()
    assert {r.host: r.refused for r in got} == {"two-faced.example": True, "mill.example": False, "silent.example": False}


def test_a_whole_job(spark):
    """73 pages: one limited and then read, one closed by robots, one partner path."""
    urls = [f"https://s.example/{i}" for i in range(73)]
    items = spark.createDataFrame([("j", i, u) for i, u in enumerate(urls)], "job_id string, idx long, url string")
    marks = ["r"] + ["o"] * 70 + ["x", "x"]
    rows = [("j", i, u, m) for i, (u, m) in enumerate(zip(urls, marks))]
    schema = "job_id string, off long, url string, mark string"
    first = spark.createDataFrame(rows, schema)
    queue = jobs.second_read_queue(items, first).collect()
    assert [(r.queue, r.position, r.url) for r in queue] == [("retry", 1, urls[0])]
    done = jobs.job_progress(items, spark.createDataFrame(rows + [("j", 73, urls[0], "o")], schema)).first()
    assert (done.total, done.done, done.failed, done.results, done.status) == (73, 73, 2, 74, "done")
    page = jobs.results_lookup(spark.createDataFrame(rows + [("j", 73, urls[0], "o")], schema), 50)
    assert page.count() == 24 and page.filter(F.col("url") == urls[0]).first().mark == "o"


def test_retries_end_after_two_rounds(spark):
    schema = "job_id string, off long, url string, mark string"
    items = spark.createDataFrame([("j", 0, "a"), ("j", 1, "b")], "job_id string, idx long, url string")
    rows = [("j", i, "a", "r") for i in range(3)] + [("j", 3, "b", "b")]
    got = [(r.queue, r.url) for r in jobs.second_read_queue(items, spark.createDataFrame(rows, schema)).collect()]
    assert got == [("render", "b")]


def test_merging_a_second_reading(spark):
    schema = "job_id string, url string, ok boolean, error string, text string, needs_render boolean"
    earlier = spark.createDataFrame([("j", "a", True, None, "old", True), ("j", "b", False, "first", None, None), ("j", "c", True, None, "old", True)], schema)
    later = spark.createDataFrame([("j", "a", False, "no browser", None, None), ("j", "b", False, "second", None, None), ("j", "c", True, None, "new", False),
                                   ("j", "d", False, "alone", None, None)], schema)
    got = {r.url: r for r in jobs.merge_reads(later, earlier).collect()}
    assert (got["a"].ok, got["a"].text, got["a"].render_error, got["a"].needs_render) == (True, "old", "no browser", False)
    assert got["b"].error == "second" and got["c"].text == "new" and got["d"].error == "alone" and got["c"].render_error is None
    kept = {r.url: r for r in jobs.merge_reads(later, earlier, keep_failure=True).collect()}
    assert kept["b"].error == "first" and kept["a"].needs_render is True and kept["b"].render_error is None and kept["d"].error == "alone"


def test_targets_and_what_is_left(spark):
    sample = spark.createDataFrame([("s", i, f"u{i}") for i in range(6)], "site string, seq long, url string")
    results = spark.createDataFrame([("s", "u1", True), ("s", "u2", False)], "site string, url string, ok boolean")
    for width in (None, 2):
        chosen, counts = jobs.job_targets(sample, results, cap=3, width=width)
        assert [(r.idx, r.url) for r in chosen.orderBy("idx").collect()] == [(0, "u0"), (1, "u2"), (2, "u3")]
        assert (counts.first().targets, counts.first().skipped) == (3, 2)


def test_pauses(spark):
    rows = [("s", SEEN, 429, 0.0), ("s", SEEN, 429, 90.0), ("t", SEEN, 429, 0.0), ("u", SEEN, 200, 5.0)]
    got = jobs.rate_limit_pauses(spark.createDataFrame(rows, "site string, fetched_at timestamp, status int, wait double")).collect()
    assert {r.site: (r.pause_until - SEEN).seconds for r in got} == {"s": 60, "t": 10}
