from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom import catalog
from pathloom.operators import jobs
from pathloom.operators.contents import page_contents
from pathloom.streaming import jobs as streams

START = datetime(2026, 10, 1)
SCHEMA = "job_id string, off long, url string, mark string, written_at timestamp"


@pytest.fixture(scope="module")
def log_folder(spark, tmp_path_factory):
    """Three files that arrive one after the other; re-reads change marks, also to what they were."""
    folder = tmp_path_factory.mktemp("log")
    off = 0
    for arrival in range(3):
        rows = []
        for job in ("a", "b"):
            for page in range(6):
                mark = "orsbx"[(page + arrival * (page % 3)) % 5]
                rows.append((job, off, f"{job}{page}", mark, START + timedelta(seconds=off * 7 + arrival * 200 * (job == "a"))))
                off += 1
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return str(folder / "in")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest(spark, log_folder, tmp_path):
    for _ in range(2):  # a second run over the same checkpoint adds nothing
        streams.stream_latest(stream(spark, log_folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = streams.read_latest(spark, str(tmp_path / "out"))
    assert rows(got) == rows(jobs.latest_results(spark.read.parquet(log_folder)).select(got.columns))


def test_progress_takes_marks_back(spark, log_folder, tmp_path):
    streams.stream_progress(stream(spark, log_folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = streams.read_progress(spark, str(tmp_path / "out"))
    assert rows(got) == rows(streams.batch_progress(spark.read.parquet(log_folder)).select(got.columns))
    stored = spark.read.parquet(*map(str, (tmp_path / "out" / "counts" / "rows").glob("version=*/bucket=*")))
    assert stored.count() == got.count()  # as many rows as jobs and marks, whatever was read


def test_snapshot_holds_one_row_per_key(spark, tmp_path):
    """20 batches with re-reads and late rows, each of them given twice; the fifth one fails between its two tables and is repeated."""
    folder, every = str(tmp_path / "s"), []
    snapshot = streams._readings(spark, folder)
    for number in range(20):
        batch = [(f"j{i % 3}", f"u{(i * 7 + number) % 40}", (number * 13 + i * 5) % 97 * 100 + number, "orb"[(i + number) % 3]) for i in range(12)]
        every += batch
        frame = streams.latest_results(spark.createDataFrame(batch, streams.READINGS))
        snapshot.apply(frame, number)
        if number % 5 == 0:
            snapshot.apply(frame, number)
    got = snapshot.read(streams.READINGS)
    want = {}
    for job, url, off, mark in every:
        want[job, url] = max(want.get((job, url), (-1, "")), (off, mark))
    assert rows(got) == sorted((*key, *value) for key, value in want.items())
    stored = spark.read.parquet(*map(str, (tmp_path / "s" / "rows").glob("version=*/bucket=*")))
    assert stored.count() == len(want) and snapshot.batches() == [19]


def test_progress_survives_a_failure_between_counts_and_marks(spark, log_folder, tmp_path, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    apply, failed = streams.Snapshot.apply, []

    def failing(self, frame, number):
        if number == 1 and self.folder.endswith("/marks") and not failed:
            failed.append(number)
            raise RuntimeError("lost")
        return apply(self, frame, number)

    monkeypatch.setattr(streams.Snapshot, "apply", failing)
    with pytest.raises(Exception, match="lost"):
        streams.stream_progress(stream(spark, log_folder), out, checkpoint)
    streams.stream_progress(stream(spark, log_folder), out, checkpoint)
    got = streams.read_progress(spark, out)
    assert failed and rows(got) == rows(streams.batch_progress(spark.read.parquet(log_folder)).select(got.columns))


def test_results_are_deleted_a_week_after_their_last_write(spark, tmp_path):
    """One batch a day: two new pages, a page that is read again each day, a late row and one without a time. What is stored stays flat."""
    snapshot, every, sizes = streams._results(spark, str(tmp_path / "s"), streams.WEEK), [], []
    for day in range(12):
        at = START + timedelta(days=day)
        batch = [("j", f"new{day}", day * 10, "o", at), ("j", f"more{day}", day * 10 + 1, "o", at), ("j", "again", day * 10 + 2, "o", at),
                 ("k", "late", day * 10 + 3, "r", at - timedelta(days=9)), ("k", "edge", 4, "o", START), ("k", "timeless", 5, "o", None)]
        every += batch
        for _ in range(2):
            snapshot.apply(spark.createDataFrame(batch, streams.RESULTS), day)
        if day in (7, 8, 11):
            want = streams.kept_results(spark.createDataFrame(every, streams.RESULTS))
            names = {r.url for r in want.collect()}
            assert ("edge" in names) == (day == 7) and "late" not in names and {"again", "timeless"} <= names
            got = streams.read_results(spark, str(tmp_path / "s"))
            order = lambda df: sorted(map(str, df.select("job_id", "url", "off", "mark", "written_at").collect()))
            assert order(got) == order(want)
            stored = spark.read.parquet(*map(str, (tmp_path / "s" / "rows").glob("version=*/bucket=*")))
            sizes.append(stored.count())
            assert sizes[-1] == got.count()  # nothing else lies on disk
    assert sizes[1] == sizes[2] == 2 * 8 + 2


@pytest.mark.parametrize("gap", [streams.STALL, "30001 milliseconds"])
def test_quiet_jobs(spark, log_folder, tmp_path, gap):
    log = spark.read.parquet(log_folder)
    streams.stream_spells(stream(spark, log_folder), gap, "0 seconds", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(streams.closed_spells(log, gap))
    assert streams.closed_spells(log, gap).count() > 0


def test_late_rows_count_and_ended_jobs_do_not_stall(spark, tmp_path):
    """The second file holds older rows than the first; the third moves the watermark past all spells."""
    at = lambda s: START + timedelta(seconds=s)
    arrivals = [[("a", 0), ("a", 400), ("b", 400), ("c", 400)], [("a", 50), ("a", 350), ("b", 0), ("c", 60)], [("z", 5000)]]
    schema = "job_id string, written_at timestamp"
    for rows_in in arrivals:
        spark.createDataFrame([(job, at(s)) for job, s in rows_in], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # b ended within its last gap, c long after its last stall.
    ended = spark.createDataFrame([("b", at(410)), ("c", at(4000))], "job_id string, ended_at timestamp")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_spells(live, streams.STALL, "10 minutes", str(tmp_path / "out"), str(tmp_path / "cp"), ended)
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == [("a", at(50), 2), ("a", at(400), 2), ("b", at(0), 1), ("c", at(60), 1), ("c", at(400), 1)]
    assert got == rows(streams.closed_spells(spark.read.parquet(str(tmp_path / "in")), streams.STALL, ended))


def test_a_stream_needs_a_delay(spark, log_folder):
    with pytest.raises(ValueError, match="delay"):
        streams.quiet_spells(stream(spark, log_folder), streams.STALL)


def test_a_gap_of_exactly_90_seconds_is_not_a_stall(spark):
    at = lambda s: START + timedelta(seconds=s)
    log = spark.createDataFrame([("j", at(0)), ("j", at(90)), ("k", at(0)), ("k", at(91)), ("z", at(5000))], "job_id string, written_at timestamp")
    got = [(r.job_id, r.writes) for r in streams.closed_spells(log, streams.STALL).collect()]
    assert sorted(got) == [("j", 2), ("k", 1), ("k", 1)]


def test_expiry(spark):
    now = START + timedelta(days=8)
    log = spark.createDataFrame([("old", START), ("kept", START), ("kept", START + timedelta(days=2))], "job_id string, written_at timestamp")
    assert [r.job_id for r in streams.expired_results(log, F.lit(now)).collect()] == ["old"]


def test_pauses(spark, tmp_path):
    reads = [(f"s{i % 3}", START + timedelta(seconds=i), 429 if i % 4 else 200, float(i % 7) * 20) for i in range(40)]
    schema = "site string, fetched_at timestamp, status int, wait double"
    df = spark.createDataFrame(reads, schema)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.stream_rate_limit(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(streams.read_pauses(spark, str(tmp_path / "out"))) == rows(jobs.rate_limit_pauses(df))


def test_contents_of_arriving_pages(spark, corpus, tmp_path):
    live = catalog.arriving(corpus, "pages_rich")
    streams.stream_page_contents(live, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = page_contents(corpus["pages_rich"])
    got = spark.read.parquet(str(tmp_path / "out")).select(batch.columns)
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def stored_in_parts(spark, place):
    """The same own pages as one file and as a folder of several: the two corpus folders."""
    page = "<html><head><title>T{0}</title></head><body><h1>H{0}</h1><p>some words {0}</p></body></html>"
    pages = spark.createDataFrame([(i, f"https://s{i % 3}.example.org/p/{i}", page.format(i)) for i in range(48)], catalog.PAGES)
    pages.coalesce(1).write.parquet(f"{place}/written")
    (place / "one").mkdir()
    next((place / "written").glob("part-*.parquet")).rename(place / "one" / "pages.parquet")
    pages.repartition(3).write.parquet(f"{place}/many/pages.parquet")
    pages.limit(1).write.parquet(f"{place}/many/pages.parquet.old")
    return str(place / "one"), str(place / "many")


def test_contents_of_pages_stored_as_a_folder(spark, tmp_path):
    one, many = (rows(catalog.QUERIES["stream_page_contents"](spark, folder)) for folder in stored_in_parts(spark, tmp_path))
    assert len(many) == 48 and many == one


def test_pauses_of_pages_stored_as_a_folder(spark, tmp_path):
    one, many = (rows(catalog.QUERIES["stream_rate_limit"](spark, folder)) for folder in stored_in_parts(spark, tmp_path))
    assert len(many) == 1 and many == one
