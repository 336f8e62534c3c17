"""Licences, toxicity, URL filters, decontamination."""

from pathlib import Path

import pytest
from brute import overlaps

from pathloom.llm import toxicity
from pathloom.llm.decontamination import clean_documents, find_overlaps, overlap_report, without_spans
from pathloom.llm.licenses import KNOWN, known_digests, scan_licenses
from pathloom.llm.queries import QUERIES, URL_RULES
from pathloom.llm.url_filter import Rule, filter_urls

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, verdict string, row int, items int"


def test_licences(spark):
    mit = KNOWN[0][1]
    rows = [
        (1, mit, "x", 1, 1),
        (2, "Copyright (c) 2019 Some One\r\n\r\n" + mit.upper().replace(",", " ,").replace("'", "`"), None, 2, 2),
        (3, mit + " More.", "x", 3, 3),
        (4, "text\nlicensed under the APACHE licence, version 2.0\n(Released under the MIT License)", "x", 4, 4),
        (5, None, "x", 5, 5),
        (5, "", "x", 5, 5),
    ]
    found = scan_licenses(spark.createDataFrame(rows, DOCS), known_digests(spark)).collect()
    got = sorted((r["doc_id"], r["licenses"], r["statements"], r["n_statements"]) for r in found)
    assert got == [(1, ["MIT"], [], 0), (2, ["MIT"], [], 0), (3, [], [], 0), (4, [], ["Apache-2.0", "MIT"], 2), (5, [], [], 0), (5, [], [], 0)]
    assert len({r["digest"] for r in found}) == 4


@pytest.mark.parametrize("line", ["Copyright Jane Doe", "copyright: Jane van Doe 2019", "Copyright by Example, Inc.", "# Copyright Jane Doe <jane@example.org>,", "Copyright \u00c9mile Zola"])
def test_copyright_lines_do_not_count(spark, line):
    docs = spark.createDataFrame([(1, f"{line}\n\n{KNOWN[0][1]}"), (2, line)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in scan_licenses(docs, known_digests(spark)).collect()}
    assert found[1]["licenses"] == ["MIT"] and found[2]["licenses"] == [] and found[2]["digest"] != found[1]["digest"]


@pytest.mark.parametrize("line", ["copyright notice and this list of conditions", "Copyright holders may not be named", "Copyright is not claimed here", "COPYRIGHT HOLDERS BE LIABLE"])
def test_sentences_on_copyright_count(spark, line):
    docs = spark.createDataFrame([(1, f"{line}\n\n{KNOWN[0][1]}")], "doc_id long, text string")
    assert scan_licenses(docs, known_digests(spark)).first()["licenses"] == []


def test_licences_of_empty_and_very_long_texts(spark):
    known = known_digests(spark)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string"), known).isEmpty()
    long_ = "Copyright " + "Jane " * 200_000 + "\n" + "x" * 1_000_000 + "\n" + "Licensed under CC BY 4.0.\n" * 3
    row = scan_licenses(spark.createDataFrame([(1, long_, "clash", "clash")], "doc_id long, text string, license string, digest string"), known).first()
    assert (row["licenses"], row["statements"], row["n_statements"]) == ([], ["CC-BY-4.0"], 3)


def test_licences_where_the_known_ones_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "Licensed under CC BY 4.0.") for i in range(50)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {tuple(r["licenses"]) for r in scan_licenses(docs, known_digests(spark)).collect()} == {("CC-BY-4.0",)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("license, file", [("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0")])
def test_whole_standard_licences(spark, license, file):
    whole = (Path("/usr/share/common-licenses") / file).read_text("utf-8")
    rows = [(1, whole), (2, whole.upper().replace("\n", "\r\n")), (3, whole[: len(whole) // 2])]
    if "END OF TERMS AND CONDITIONS" in whole:
        rows.append((4, whole.split("END OF TERMS AND CONDITIONS")[0]))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {i: [] if i == 3 else [license] for i, _ in rows}


def test_overlaps_match_brute_force(spark):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect()]
    found = sorted(map(tuple, QUERIES["op10_decontamination"](spark, FOLDER).collect()))
    assert found == overlaps(read("documents"), read("benchmark"))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_overlaps_with_odd_rows(spark, block_bytes):
    """In one block and in many."""
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item!"), (2, "ÉTÉ"), (3, None), (4, "..."), (5, "short-item")]
    texts = [
        "zero ONE two, three four five six seven eight nine ten; eleven twelve",
        "two three four five six seven eight nine ten eleven",
        "one two three four five six seven eight nine",
        "a short item, and SHORT   item; ÉTÉ x",
        None,
        "",
        "one two three four five six seven eight nine",
        "ten eleven",
    ]
    rows = [(i // 2, t, "x", i, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_overlaps(docs, bench, block_bytes=block_bytes)
    got = sorted(map(tuple, overlap_report(found).collect()))
    assert got == overlaps([(r[0], r[1]) for r in rows], items)
    kept = clean_documents(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [2, 4, 5, 6, 7]
    cut = {r["rest"]["row"]: r["text"] for r in without_spans(found).collect()}
    assert cut[0] == "zero  twelve" and cut[3] == "a , and  x" and cut[4] is None and cut[2] == texts[2]
    assert overlap_report(find_overlaps(docs, bench.limit(0))).filter("contaminated").count() == 0


def test_toxicity_on_held_out_labels(spark):
    found = QUERIES["op5_toxicity"](spark, FOLDER.replace("0.01", "0.1"))
    labels = spark.read.parquet(FOLDER.replace("0.01", "0.1") + "/labels.parquet")
    assert found.count() == 10_000
    rows = [r for r in found.join(labels, "doc_id").filter("held_out").collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    toxic, other = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum(x >= 0.7 for x in toxic) >= 0.85 * len(toxic) and sum(x >= 0.7 for x in other) <= 0.01 * len(other)


def test_toxicity_learns_from_training_labels_only(spark):
    docs = spark.createDataFrame([(i, f"plain words number{i} here" + (" grobulent fellow" if i % 4 == 0 else ""), "x", i, i) for i in range(400)] + [(None, None, None, None, None)], DOCS)
    right = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (5000, 1)]
    import zlib

    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = [(i, 1 - y if i in held else y) for i, y in right if i is not None and y is not None]
    scores = []
    for labels in (right, wrong):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append({r["doc_id"]: (r["held_out"], r["score"]) for r in toxicity.score_documents(docs, model).collect()})
    assert scores[0] == scores[1] and {i for i, x in scores[0].items() if x[0]} == held
    assert all((x[1] >= 0.7) == (i % 4 == 0) for i, x in scores[0].items() if i is not None) and scores[0][None][1] < 0.7
    assert model.rates.shape == (2, len(model.voters)) and all(0 < x <= 1 for x in model.shares)


def test_toxicity_counts_labels_beyond_the_fitted_rows(spark):
    """"wumblefit" is in 24 toxic texts of 3,000, and the fit reads 100 rows."""
    rude = lambda i: " wumblefit" if i % 125 == 0 else " grobulent" if i % 10 == 0 else ""
    docs = spark.createDataFrame([(i, f"plain words number here{rude(i)}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rude(i) != "")) for i in range(3000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, fit_rows=100)
    assert {"wumblefit", "grobulent"} <= set(model.typical)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert all((score >= 0.7) == (rude(i) != "") for i, score in scores.items())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you pathetic person"), (2, "you nice person"), (3, "")], "doc_id long, text string")
    for labels in ([], [(2, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["doc_id"] for r in toxicity.score_documents(docs, model).filter("score >= 0.7").collect()] == [1]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_correlated_voters_share_their_weight():
    import numpy as np

    bits, rates = np.array([[1, 1, 0], [0, 0, 1.0]]), np.array([[0.01, 0.01, 0.01], [0.5, 0.5, 0.5]])
    alone = toxicity._posterior(bits, 0.1, rates, np.ones(3))
    shared = toxicity._posterior(bits, 0.1, rates, np.array([0.5, 0.5, 1]))
    assert alone[0] > alone[1] and abs(shared[0] - shared[1]) < 1e-9


PAGES = "page_id long, url string, html string, verdict string"


def test_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "https://blog.example.com/de/1": ("blog.example.com", "/de/1", "example.com/de/", "block"),
        "https://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "https://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
        "no scheme/net/": ("", "", None, "allow"),
        "x://h.net/a://b": ("h.net", "/a://b", "net/", "block"),
        "http://n.net/": ("n.net", "/", "net/", "block"),
        "http://h?a/b": ("h", "", None, "allow"),
    }
    rows = [(i, url, None, "x") for i, url in enumerate(urls)] + [(99, None, None, None), (99, None, None, None)]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert [found[i] for i in range(len(urls))] == list(urls.values()) and found[99] == ("", "", None, "allow")


def test_distrust_goes_back_along_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [
        (1, "http://bad.test1/", "", "x"),
        (2, "http://farm.test2/", link("BAD.test1", "bad.test1"), "x"),
        (3, "http://good.test3/", link("friend.test4"), "x"),
        (4, "http://friend.test4/", "<p>//bad.test1</p>", "x"),
        (5, "http://mixed.test5/", link("bad.test1") + link("good.test3"), "x"),
        (6, "http://sub.farm.test2/", None, "x"),
    ]
    rules = [Rule("block", "bad.test1"), Rule("allow", "good.test3")]
    found = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert {i: r["verdict"] for i, r in found.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block"}
    assert found[4]["trust"] > 0 == found[4]["distrust"] and found[6]["rule"] is None
    assert filter_urls(spark.createDataFrame([], PAGES), rules).count() == 0
