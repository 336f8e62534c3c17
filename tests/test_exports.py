import gzip
import json
from pathlib import Path

from pathloom import catalog
from pathloom.sinks import exports
from pathloom.sources.pages import robots_texts, sitemap_dump

PAGE = dict(site="s", seq=1, ok=True, url="https://s/a", pattern="/a", status=200, final_url="https://s/a", lang="en", title='Say "hi"', description="d,e",
            h1="H", canonical="", robots="", word_count=2, internal_links=1, external_links=0, schema_types=["A", "B"],
            headings=[(1, "H"), (2, "two")], read_from="html", text="line\none", text_truncated=False)
SCHEMA = """site string, seq long, ok boolean, url string, pattern string, status int, final_url string, lang string, title string, description string,
    h1 string, canonical string, robots string, word_count long, internal_links long, external_links long, schema_types array<string>,
    headings array<struct<level:int,text:string>>, read_from string, text string, text_truncated boolean"""


def joined(spark, folder: Path, site: str) -> bytes:
    """A site's export, cut from the files by the manifest; the same as what the reader gives."""
    cut = b""
    for piece in exports.site_pieces(spark, str(folder), site).orderBy("piece").collect():
        cut += (folder / piece.file).read_bytes()[piece.start : piece.start + piece.length]
    assert cut == b"".join(exports.site_export(spark, str(folder), site))
    return cut


def files(folder: Path) -> list[Path]:
    return sorted((folder / "data").glob("bucket=*/part-*"))


def test_contents_lines_and_bytes(spark, tmp_path):
    df = spark.createDataFrame([tuple(PAGE.values()), tuple({**PAGE, "seq": 0, "ok": False}.values())], SCHEMA)
    lines = exports.contents_csv(df)
    want = '"https://s/a","/a","200","Say ""hi""","d,e","H","","","2","1","0","A; B","H1: H | H2: two","html","line\none"'
    assert [r.line for r in lines.collect()] == [want]
    exports.write_lines(lines, str(tmp_path / "out"), exports.header_line(exports.CONTENT_COLUMNS))
    header = "﻿" + ",".join(exports.CONTENT_COLUMNS)
    assert joined(spark, tmp_path / "out", "s") == f"{header}\r\n{want}\r\n".encode()


def test_large_sites_become_parts_in_order(spark, tmp_path):
    rows = [("s", i, f"line {i}") for i in range(2000)] + [("t", 0, "only")]
    exports.write_lines(spark.createDataFrame(rows, "site string, seq long, line string").repartition(4), str(tmp_path / "out"), "head")
    assert joined(spark, tmp_path / "out", "s").decode().split("\r\n") == ["head", *[f"line {i}" for i in range(2000)], ""]
    assert joined(spark, tmp_path / "out", "t") == b"head\r\nonly\r\n"


def test_json_records(spark, tmp_path):
    df = spark.createDataFrame([tuple(PAGE.values())], SCHEMA)
    exports.write_json(exports.contents_json(df), str(tmp_path / "out"))
    record = json.loads(joined(spark, tmp_path / "out", "s"))
    assert list(record) == ["url", "pattern", "status", "finalUrl", "lang", "title", "description", "h1", "canonical", "robots", "wordCount",
                            "internalLinks", "externalLinks", "schemaTypes", "headings", "readFrom", "text", "textTruncated"]
    assert record["headings"] == [{"level": 1, "text": "H"}, {"level": 2, "text": "two"}]


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([tuple({**PAGE, "title": None, "lang": None, "pattern": None}.values())], SCHEMA)
    record = json.loads(exports.contents_json(df).first().record)
    assert len(record) == 18 and record["title"] is None and record["lang"] is None and record["pattern"] is None


def test_files_are_bounded_by_buckets_not_by_sites(spark, tmp_path):
    """A third of all rows in one site, hundreds of small sites, odd names, nulls, repeated rows, non-ASCII and many-line texts."""
    rows = [("hot", i, f"row {i} \u00e9\u4e16\n{'x' * (i % 50)}") for i in range(600)]
    rows += [(f"s{i % 300:03d}", i, f"\u00df {i}") for i in range(1200)] + [("a=b/c d", 1, None), ("twice", 1, "same"), ("twice", 1, "same"), ("\u00fc", 1, "")]
    lines = spark.createDataFrame(rows, "site string, seq long, line string").repartition(5)
    exports.write_lines(lines, str(tmp_path / "out"), "head", buckets=7)
    assert 1 < len(files(tmp_path / "out")) <= 7
    want = {}
    for site, _, line in sorted(rows, key=lambda r: (r[0], r[1])):
        want.setdefault(site, ["head"]).append(line or "")
    for site in ["hot", "s000", "s299", "a=b/c d", "twice", "\u00fc"]:
        assert joined(spark, tmp_path / "out", site).decode() == "".join(line + "\r\n" for line in want[site])
    pieces = exports.site_pieces(spark, str(tmp_path / "out")).collect()
    assert {p.site for p in pieces} == set(want) and len({p.piece for p in pieces if p.site == "hot"}) > 1
    assert sum(p.length for p in pieces) == sum(f.stat().st_size for f in files(tmp_path / "out"))
    exports.write_lines(lines.filter("site = 'twice'"), str(tmp_path / "out"), "head", buckets=7)  # replaces the export
    assert {p.site for p in exports.site_pieces(spark, str(tmp_path / "out")).collect()} == {"twice"}
    assert joined(spark, tmp_path / "out", "twice") == b"head\r\nsame\r\nsame\r\n"
    exports.write_json(lines.limit(0).withColumnRenamed("line", "record"), str(tmp_path / "none"))
    assert exports.site_pieces(spark, str(tmp_path / "none")).isEmpty() and list(exports.site_export(spark, str(tmp_path / "none"), "x")) == []


def test_failures_and_manifest(spark):
    failed = spark.createDataFrame([("s", 0, "u", "/", False, "why"), ("s", 1, "v", "/", True, None)], "site string, seq long, url string, pattern string, ok boolean, error string")
    assert [r.line for r in exports.failures_csv(failed).collect()] == ['"u","/","why"']
    assert exports.header_line(exports.CAPTURE_COLUMNS, quote=True).startswith('﻿"file","url"')


def test_files_on_disk(spark, tmp_path):
    for site, text in (("a.example", "User-agent: *\nDisallow: /x"), ("b.example", "")):
        (tmp_path / "robots" / site).mkdir(parents=True)
        (tmp_path / "robots" / site / "robots.txt").write_text(text)
    got = {r.site: r.text for r in robots_texts(spark, str(tmp_path / "robots" / "*" / "robots.txt")).collect()}
    assert got["a.example"] == "User-agent: *\nDisallow: /x"
    xml = "<urlset><url><loc>https://s/1</loc><lastmod>2026-01-01</lastmod></url><url><loc>https://s/2</loc></url></urlset>"
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "a.xml").write_text(xml)
    with gzip.open(tmp_path / "maps" / "b.xml.gz", "wt") as out:
        out.write(xml.replace("/1", "/3").replace("/2", "/4"))
    rows = sitemap_dump(spark, str(tmp_path / "maps")).collect()
    assert sorted(r.loc for r in rows) == [f"https://s/{i}" for i in (1, 2, 3, 4)]


def test_scans_push_down_and_prune(spark):
    from pathloom.operators.patterns import url_patterns
    from pathloom.operators.urls import url_dimension
    from pathloom.sources.pages import table

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    plan = url_dimension(pages.filter("page_id > 3")).select("url")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan
    assert len(catalog.QUERIES) >= 76 and url_patterns is not None
