"""One query per operator, over the stored tables of a folder and what is derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .corpora import Corpus
from .functions.text import iso_text
from .functions.urls import url_path
from .operators import contents, fetchlog, graph, jobs, patterns, robots, sitemaps, urls
from .plans.scale import rank_in_group
from .session import cut_lineage, shared_folder
from .sinks import exports
from .sources.pages import scan_pages, spread_out
from .streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def flat(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, timestamps as ISO text, text arrays joined by ``|``: comparable across engines."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            column = iso_text(column)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            column = F.array_join(column, "|")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: flat(build(Corpus(spark, folder)))
    return build


# ---- scans and sinks ---------------------------------------------------------------------------


@query
def scan_pages_(c):
    return scan_pages(c["fetch_log"]).select("page_id", "url", F.length("html").alias("n_chars"))


@query
def scan_robots(c):
    return robots.scan_robots(c["robots_responses"])


@query
def scan_robots_sitemaps(c):
    return robots.scan_robots_sitemaps(c["robots_txt"])


@query
def robots_rules(c):
    return robots.robots_rules(c["robots_txt"])


@query
def sitemap_entries(c):
    return sitemaps.sitemap_entries(c["sitemap_docs"])


def read_pages(c) -> DataFrame:
    """Pages that were read, with contents and template: judged and extracted in the row, then one join."""
    log = spread_out(c["rich_log"], "page_id").withColumn("fetched_at", F.col("fetched_text").cast("timestamp"))
    good = fetchlog.fetch_outcome(log).withColumn("ok", F.col("outcome.ok")).filter("ok")
    record = contents.page_contents(good, keep=("site", "seq", "status", "ok"))
    named = c["patterned"].select("site", "seq", "pattern")
    return (
        record.join(named, ["site", "seq"], "left")
        .withColumn("final_url", F.col("url"))
        .withColumn("read_from", F.lit("html"))
    )


@query
def sink_contents_csv(c):
    return exports.contents_csv(read_pages(c))


@query
def sink_contents_json(c):
    return exports.contents_json(read_pages(c))


@query
def sink_links_csv(c):
    return exports.links_csv(c["patterned"])


@query
def sink_failures_csv(c):
    failed = fetchlog.fetch_outcome(with_fetch_time(c)).select("site", "seq", "url", "outcome.ok", "outcome.error")
    return exports.failures_csv(failed.join(c["patterned"].select("site", "seq", "pattern"), ["site", "seq"]))


@query
def sink_capture_manifest(c):
    numbered = jobs.capture_numbering(c["captures"])
    return exports.capture_manifest(numbered.join(c["patterned"].select("site", "seq", "pattern"), ["site", "seq"]))


# ---- URLs --------------------------------------------------------------------------------------


@query
def sites_from_input(c):
    typed = c["pages"].select(
        "page_id",
        F.expr(
            """CASE page_id % 6
                 WHEN 0 THEN '  ' || upper(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || '/some/page '
                 WHEN 1 THEN url
                 WHEN 2 THEN 'ftp://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
                 WHEN 3 THEN '10.0.0.' || CAST(page_id % 250 AS STRING)
                 WHEN 4 THEN ' '
                 ELSE 'intranet' || CAST(page_id AS STRING) END"""
        ).alias("domain"),
    )
    return urls.sites_from_input(typed).select("page_id", "origin", "reject_reason")


@query
def url_dimension(c):
    links = contents.link_edges(spread_out(c["site_pages"], "page_id"), keep=("page_id",))
    parts = urls.url_dimension(links.withColumnRenamed("dst", "url"))
    return parts.select("page_id", "pos", "url", "origin", "host", "bare_host", "path", "query", "depth", "segments")


@query
def screen_hosts(c):
    hosts = c["pages"].select(
        "page_id",
        F.expr(
            """CASE page_id % 9
                 WHEN 0 THEN 'LOCALHOST' WHEN 1 THEN 'db' || CAST(page_id AS STRING) || '.internal'
                 WHEN 2 THEN '10.0.0.' || CAST(page_id % 250 AS STRING) WHEN 3 THEN '[::1]'
                 WHEN 4 THEN '100.' || CAST(page_id % 250 AS STRING) || '.1.1' WHEN 5 THEN 'printer'
                 WHEN 6 THEN '172.' || CAST(page_id % 40 AS STRING) || '.0.9'
                 ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '.' END"""
        ).alias("host"),
    )
    return urls.screen_hosts(hosts)


def marked_urls(c) -> DataFrame:
    """Page URLs, some moved under partner paths or given a file ending."""
    return c["site_pages"].select(
        "page_id",
        "site",
        "seq",
        F.expr(
            """CASE page_id % 8
                 WHEN 0 THEN 'https://' || site || '/Go/' || CAST(page_id AS STRING)
                 WHEN 1 THEN 'https://' || site || '/click/' || CAST(page_id AS STRING) || '?x=1'
                 WHEN 2 THEN 'https://' || site || '/img/' || CAST(page_id AS STRING) || '.JPEG'
                 WHEN 3 THEN 'https://' || site || '/files/a.pdf?page=' || CAST(page_id AS STRING)
                 WHEN 4 THEN 'https://' || site || '/gopher/' || CAST(page_id AS STRING)
                 ELSE url END"""
        ).alias("url"),
    )


@query
def screen_affiliate(c):
    return urls.screen_affiliate(marked_urls(c)).select("page_id", "url", "affiliate")


@query
def screen_assets(c):
    return urls.screen_assets(marked_urls(c)).select("page_id", "url")


@query
def screen_targets(c):
    targets = c["site_pages"].select(
        "site",
        "seq",
        F.expr(
            """CASE page_id % 9
                 WHEN 0 THEN 'not a url' WHEN 1 THEN 'http://192.168.0.' || CAST(page_id % 250 AS STRING) || '/x'
                 WHEN 2 THEN 'https://' || site || '/out/' || CAST(page_id AS STRING) ELSE url END"""
        ).alias("raw_url"),
    )
    parsed = urls.canonical_url(targets, "raw_url", "url")
    judged = robots.robots_allowed(parsed, c["robots_by_origin"], by_origin=True)
    return judged.select("site", "seq", "raw_url", urls.target_error(F.col("url"), F.col("allowed")).alias("error"))


@query
def site_scope_items(c):
    offered = c["site_pages"].select(
        F.col("site").alias("job_id"),
        "site",
        F.explode(F.expr("array(seq * 2, seq * 2 + 1)")).alias("seq"),
        "url",
        "page_id",
    )
    shaped = offered.select(
        "job_id",
        "site",
        "seq",
        F.expr("CASE WHEN page_id % 11 = 5 THEN 'https://other.example.org/' || page_id WHEN page_id % 11 = 7 THEN 'no url' ELSE url || '#part' END").alias("url"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN 'none' ELSE '/p/*' END").alias("pattern"),
    )
    items, rejected = urls.site_scope_items(shaped)
    kept = items.select("job_id", "idx", "url", "pattern", F.lit(None).cast("string").alias("reject_reason"))
    return kept.unionByName(
        rejected.select("job_id", F.col("seq").alias("idx"), F.col("raw_url").alias("url"), F.lit(None).cast("string").alias("pattern"), "reject_reason")
    )


@query
def compact_urls(c):
    origins = urls.common_origin(c["site_urls"], fallback_origins(c)).select("site", F.col("origin").alias("site_origin"))
    placed = patterns.attach(c["site_urls"], origins, ["site"], ["seq"])
    return urls.compact_urls(placed).select("site", "seq", "compact", "restored")


@query
def capture_slug(c):
    return urls.capture_slug(c["site_urls"]).select("seq", "slug")


@query
def first_seen_urls(c):
    twice = c["site_urls"].withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    listed = twice.select("site", F.expr("seq + again * 1000000").alias("seq"), "url")
    return urls.first_seen_urls(listed).select("site", "position", "url", "truncated")


def fallback_origins(c) -> DataFrame:
    return c["site_urls"].groupBy("site").agg(F.concat(F.lit("https://"), F.first("site")).alias("fallback_origin"))


@query
def common_origin(c):
    return urls.common_origin(c["site_urls"], fallback_origins(c))


# ---- fetch log ---------------------------------------------------------------------------------


def with_fetch_time(c) -> DataFrame:
    return c["fetch_log"].withColumn("fetched_at", F.col("fetched_text").cast("timestamp"))


@query
def detect_bot_protection(c):
    return fetchlog.detect_bot_protection(c["fetch_log"]).select("page_id", "bot_protection")


@query
def retry_after_seconds(c):
    return fetchlog.retry_after_seconds(with_fetch_time(c)).select("page_id", "retry_after", "retry_after_seconds")


@query
def fetch_outcome(c):
    return fetchlog.fetch_outcome(with_fetch_time(c)).select("page_id", "outcome.*")


@query
def crawl_read_outcome(c):
    return fetchlog.crawl_read_outcome(c["fetch_log"]).select("page_id", "ok", "detail")


@query
def result_mark(c):
    shells = contents.js_shell_pages(rich_pages(c)).select("page_id", "needs_render")
    outcome = fetchlog.fetch_outcome(with_fetch_time(c)).select("page_id", "outcome.*")
    return fetchlog.result_mark(outcome.join(shells, "page_id")).select("page_id", "mark")


@query
def decode_bodies(c):
    bodies = c["pages"].select(
        "page_id",
        F.expr(
            """CASE WHEN page_id % 4 = 1 AND NOT html RLIKE '[^\\\\x{00}-\\\\x{7F}\\\\x{A0}-\\\\x{FF}]' THEN encode(html, 'ISO-8859-1')
                    WHEN page_id % 4 = 2 THEN encode(html, 'UTF-16LE')
                    ELSE encode(html, 'UTF-8') END"""
        ).alias("body"),
        F.expr(
            """CASE WHEN page_id % 4 = 1 AND NOT html RLIKE '[^\\\\x{00}-\\\\x{7F}\\\\x{A0}-\\\\x{FF}]' THEN 'text/html; charset=ISO-8859-1'
                    WHEN page_id % 4 = 2 THEN 'text/html; charset="utf-16le"'
                    WHEN page_id % 4 = 3 THEN 'text/html; charset=x-unheard-of' ELSE 'text/html' END"""
        ).alias("content_type"),
    )
    return fetchlog.decode_bodies(bodies).select("page_id", "text", "truncated")


@query
def dns_screen(c):
    return fetchlog.dns_screen(c["dns_answers"])


# ---- contents ----------------------------------------------------------------------------------


def rich_pages(c) -> DataFrame:
    return spread_out(c["pages_rich"], "page_id")


@query
def page_meta(c):
    return contents.page_meta(rich_pages(c)).drop("url")


@query
def page_headings(c):
    return contents.page_headings(rich_pages(c))


@query
def page_links(c):
    return contents.page_links(rich_pages(c))


@query
def link_edges(c):
    return contents.link_edges(rich_pages(c), keep=("page_id",)).drop("src")


@query
def page_text(c):
    return contents.page_text(rich_pages(c))


@query
def page_word_count(c):
    return contents.page_word_count(rich_pages(c))


@query
def page_visible_words(c):
    return contents.page_visible_words(rich_pages(c))


@query
def page_schema_types(c):
    return contents.page_schema_types(rich_pages(c))


@query
def js_shell_pages(c):
    return contents.js_shell_pages(rich_pages(c))


@query
def page_contents(c):
    record = contents.page_contents(rich_pages(c))
    return record.withColumn("headings", F.size("headings"))


# ---- templates ---------------------------------------------------------------------------------


@query
def url_patterns(c):
    return c["patterned"].select("site", "seq", "pattern")


@query
def pattern_groups(c):
    return patterns.pattern_groups(c["dated_patterned"])


@query
def pattern_placeholders(c):
    return patterns.pattern_placeholders(c["patterned"])


@query
def segment_kinds(c):
    linked = contents.link_edges(spread_out(c["site_pages"], "page_id"), keep=("page_id",)).select(F.col("page_id"), F.col("dst").alias("url"))
    both = linked.unionByName(c["site_pages"].select("page_id", "url"))
    cells = both.select("page_id", F.posexplode(F.split(url_path(F.col("url")), "/")).alias("pos", "value"), F.split(url_path(F.col("url")), "/").alias("_all"))
    cells = cells.filter("value <> ''").withColumn("previous", F.when(F.col("pos") > 1, F.get("_all", F.col("pos") - 1)))
    dated = cells.withColumn(
        "value",
        F.expr("""CASE page_id % 7 WHEN 0 THEN value || '-12-10-2026' WHEN 1 THEN '2026-10-1' || (page_id % 10)
                    WHEN 2 THEN 'page-' || page_id WHEN 3 THEN '20' || (10 + page_id % 90) ELSE value END"""),
    )
    return patterns.segment_kinds(dated).groupBy("value", "previous", "kind").agg(F.count(F.lit(1)).alias("n"))


def group_sizes(c) -> DataFrame:
    return c["patterned"].groupBy("site", "pattern").agg(F.count(F.lit(1)).alias("count"))


@query
def ranked_groups(c):
    return patterns.ranked_groups(group_sizes(c))


@query
def group_preview(c):
    return patterns.group_preview(c["patterned"], k=3)


@query
def group_bar(c):
    return patterns.group_bar(group_sizes(c))


def ranked_patterns(c) -> DataFrame:
    return patterns.ranked_groups(group_sizes(c)).select("site", F.col("rank").alias("pos"), "pattern")


@query
def match_pattern(c):
    return patterns.match_pattern(c["site_urls"], ranked_patterns(c)).select("site", "seq", "pattern")


@query
def page_pattern_lookup(c):
    known = c["patterned"].withColumn("url", F.expr("CASE WHEN seq % 5 = 0 THEN url || '#moved' ELSE url END"))
    return jobs.page_pattern_lookup(c["site_urls"], known).select("site", "seq", "url", "pattern")


@query
def spread_sample(c):
    return patterns.spread_sample(c["patterned"], ["site", "pattern"], "seq", 3).select("site", "pattern", "seq")


@query
def title_template(c):
    """Only pages of the sample have their titles read."""
    sample = cut_lineage(patterns.spread_sample(c["patterned"], ["site", "pattern"], "seq", 10).select("site", "pattern", "seq"))
    pages = c["site_pages"].join(sample.select(F.col("seq").alias("page_id")), "page_id", "left_semi")
    titles = contents.page_meta(spread_out(pages, "page_id")).select(F.col("page_id").alias("seq"), "title")
    return patterns.template_of_sample(sample.join(titles, "seq"))


# ---- robots ------------------------------------------------------------------------------------


@query
def robots_agent_groups(c):
    both = [robots.robots_agent_groups(c["robots_txt"], agent).withColumn("agent", F.lit(agent)) for agent in ("gptbot", "otherbot")]
    return both[0].unionByName(both[1])


@query
def robots_allowed(c):
    return robots.robots_allowed(c["site_urls"], c["robots_txt"]).select("site", "seq", "allowed")


@query
def ai_bot_access(c):
    return robots.ai_bot_access(c["robots_txt"])


# ---- sitemaps and graphs -----------------------------------------------------------------------


@query
def sitemap_stats(c):
    return sitemaps.sitemap_stats(c["sitemap_docs"])


def positioned_entries(c) -> DataFrame:
    """Urlset entries twice: the second listing of a page has a later date, or none."""
    entries = sitemaps.sitemap_entries(c["sitemap_docs"]).filter("kind = 'urlset'")
    doc = F.regexp_extract("sitemap_url", "/sm([0-9]+)", 1).cast("long")
    first = entries.select("site", "loc", "lastmod", doc.alias("doc_pos"), "pos")
    later = F.when(F.col("pos") % 2 == 0, F.expr("lastmod + INTERVAL 1 DAY"))
    return first.unionByName(first.select("site", "loc", later.alias("lastmod"), (F.col("doc_pos") + 1_000_000).alias("doc_pos"), "pos"))


@query
def lastmod_lookup(c):
    return sitemaps.lastmod_lookup(c["site_urls"], positioned_entries(c)).select("site", "seq", "lastmod")


@query
def sitemap_seeds(c):
    listed = robots.scan_robots_sitemaps(c["robots_txt"])
    served = c["robots_txt"].filter("first_id % 3 = 0").select("site")
    return sitemaps.sitemap_seeds(listed, c["robots_txt"].select("site", "origin"), served)


def index_seeds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site", F.col("index_url").alias("url")).agg(F.min("seq").alias("pos"))


@query
def expand_sitemaps(c):
    listed, _, summary = graph.expand_sitemaps(index_seeds(c["sitemap_rows"]), c["sitemap_docs"])
    return patterns.attach(listed, summary.select("site", "sitemaps", "truncated"), ["site"], ["url"])


def crawl_inputs(c):
    texts = c["robots_txt"]
    home = F.concat(F.col("origin"), F.lit("/"))
    reads = c["site_pages"].select("site", "url", F.col("url").alias("final_url"), F.expr("page_id % 9 <> 8").alias("ok"))
    reads = reads.unionByName(texts.select("site", home.alias("url"), home.alias("final_url"), F.lit(True).alias("ok")))
    first = c["placed_pages"].filter("place = 1").select("site", F.col("url").alias("dst"))
    entry = texts.join(first, "site").select("site", home.alias("src"), F.lit(0).alias("pos"), "dst")
    return texts.select("site", "origin"), reads, c["edges"].unionByName(entry), texts


@query
def crawl_frontier(c):
    pages, _ = graph.crawl_frontier(*crawl_inputs(c))
    return pages.select("site", "url", "depth")


@query
def resolve_redirects(c):
    starts = c["site_pages"].select("url")
    return graph.resolve_redirects(starts, c["redirect_hops"]).select(
        "url", "final_url", "hops", "error", F.transform("chain", lambda hop: hop["location"]).alias("chain")
    )


@query
def map_site(c):
    """Sites with an even first page have a sitemap; only the others are crawled."""
    served = c["robots_txt"].filter("first_id % 2 = 0").select("site")
    rows = c["sitemap_rows"].join(served, "site", "left_semi")
    listed, _, _ = graph.expand_sitemaps(index_seeds(rows), c["sitemap_docs"])
    listed = cut_lineage(listed)
    crawled, _ = graph.crawl_frontier(*[table.join(listed.select("site").distinct(), "site", "left_anti") for table in crawl_inputs(c)])
    return graph.map_site(listed, crawled).select("site", "source", "url")


@query
def remap_choice(c):
    """Both tries name every page; what the first one did not find has no URL."""
    tries = c["site_pages"].select("site", "page_id", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    return graph.remap_choice(tries.withColumn("url", F.expr("CASE WHEN attempt = 1 OR page_id % 5 = 0 OR page_id % 7 = 1 THEN url END")))


# ---- jobs --------------------------------------------------------------------------------------


@query
def latest_results(c):
    return jobs.latest_results(c["job_results"].select("job_id", "url", "off", "mark"))


@query
def job_progress(c):
    return jobs.job_progress(c["job_items"].select("job_id", "idx", "url"), c["job_results"])


@query
def restored_groups(c):
    return jobs.restored_groups(c["job_items"])


def marked_results(c) -> DataFrame:
    last = jobs.latest_results(c["job_results"].select("job_id", "url", "off", "mark"))
    return last.select(F.col("job_id").alias("site"), "url", F.col("mark").isin("o", "s").alias("ok"))


@query
def read_summary(c):
    read = jobs.read_summary(c["site_urls"].select("site", "url"), marked_results(c))
    return read.join(jobs.capture_summary(c["captures"]), "site")


@query
def pending_pages(c):
    return jobs.pending_pages(c["site_urls"], marked_results(c))


@query
def merge_reads(c):
    reading = lambda attempt: c["job_results"].filter(F.col("attempt") == attempt).select(
        "job_id",
        "url",
        F.col("mark").isin("o", "s").alias("ok"),
        F.when(~F.col("mark").isin("o", "s"), F.concat(F.lit("failed "), "mark")).alias("error"),
        F.concat(F.lit("text "), F.col("attempt").cast("string")).alias("text"),
        (F.col("mark") == "s").alias("needs_render"),
    )
    strict = jobs.merge_reads(reading(1), reading(0)).withColumn("keep_failure", F.lit(False))
    return strict.unionByName(jobs.merge_reads(reading(1), reading(0), keep_failure=True).withColumn("keep_failure", F.lit(True)))


@query
def results_lookup(c):
    dense = rank_in_group(c["job_results"].select("job_id", F.col("off").alias("_seq"), "url", "mark"), ["job_id"], "_seq", "_rn")
    log = dense.select("job_id", (F.col("_rn") - 1).alias("off"), "url", "mark")
    return jobs.results_lookup(log, 5, 8)


@query
def second_read_queue(c):
    return jobs.second_read_queue(c["job_items"].select("job_id", "idx", "url"), c["job_results"])


@query
def capture_numbering(c):
    return jobs.capture_numbering(c["captures"]).select("site", "seq", "file")


@query
def job_targets(c):
    sample = patterns.spread_sample(c["patterned"], ["site", "pattern"], "seq", 10)
    chosen, counts = jobs.job_targets(sample, marked_results(c))
    return chosen.join(counts, "site").select("site", "idx", "url", "targets", "skipped")


# ---- streams -----------------------------------------------------------------------------------

PAGES = "page_id BIGINT, url STRING, html STRING"


def arriving(c: Corpus, name: str) -> DataFrame:
    """A derived table as a stream over the stored pages, one file or a folder of them.

    The stream's path has to be a folder or a pattern; in braces the name is a pattern that fits only itself.
    """
    stored = c.spark.readStream.schema(PAGES).parquet(f"{c.folder}/{{pages.parquet}}")
    live = Corpus(c.spark, c.folder)
    live._built["pages"] = stored
    return live[name]


def stream_place(c: Corpus) -> tuple[str, str]:
    place = f"{shared_folder(c.spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    return f"{place}/rows", f"{place}/checkpoint"


def timed(log: DataFrame) -> DataFrame:
    return log.withColumn("written_at", F.col("written_text").cast("timestamp"))


def in_files(c: Corpus, name: str, columns: list[str], files: int = 5) -> DataFrame:
    """A derived table as a stream of several files, one a micro-batch; its rows lie in them without any order, so many are late."""
    table = c[name].select(*columns)
    place = f"{shared_folder(c.spark).rstrip('/')}/streams/{uuid.uuid4().hex}/log"
    table.repartition(files, F.pmod(F.xxhash64("off"), F.lit(files))).write.parquet(place)
    return c.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(place)


@query
def stream_latest(c):
    rows, checkpoint = stream_place(c)
    streams.stream_latest(in_files(c, "job_results", ["job_id", "url", "off", "mark"]), rows, checkpoint)
    return streams.read_latest(c.spark, rows)


@query
def stream_progress(c):
    rows, checkpoint = stream_place(c)
    streams.stream_progress(in_files(c, "job_results", ["job_id", "url", "off", "mark"]), rows, checkpoint)
    return streams.read_progress(c.spark, rows)


#: Some writes arrive so many seconds after their time; the streams wait longer than that.
LATE, DELAY = 60, "2 minutes"


def in_turns(c: Corpus, log: DataFrame, run: Callable[[DataFrame, str, str], None], turns: int = 3) -> str:
    """Lets a log (written_at, off, ...) arrive in turns and runs the stream after each, from its checkpoint. Returns the folder it writes to.

    Turns are shares of the rows by time of arrival. Every seventh write arrives ``LATE`` seconds late, so each turn has rows
    older than some of the turn before.
    """
    rows, checkpoint = stream_place(c)
    place = f"{rows}-log"
    late = F.when(F.col("off") % 7 == 0, F.lit(LATE)).otherwise(F.lit(0))
    arrived = cut_lineage(log.withColumn("_at", F.unix_millis("written_at") + late * 1000))
    shares = F.array(*[F.lit(turn / turns) for turn in range(1, turns)])
    cuts = arrived.agg(F.percentile_approx("_at", shares)).first()[0] or [0] * (turns - 1)
    for turn, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        now = F.lit(True)
        now = now if low is None else now & (F.col("_at") > low)
        now = now if high is None else now & (F.col("_at") <= high)
        arrived.filter(now).drop("_at").write.parquet(f"{place}/turn={turn}")
        run(c.spark.readStream.schema(log.schema).parquet(f"{place}/turn=*"), rows, checkpoint)
    return rows


def written_spells(c: Corpus, folder: str) -> DataFrame:
    return c.spark.read.schema("job_id STRING, last_write TIMESTAMP, writes BIGINT").parquet(folder)


def spaced_results(c: Corpus) -> DataFrame:
    """The result log with the second readings a week and two minutes after the first ones."""
    log = timed(c["job_results"])
    return log.withColumn("written_at", F.expr("written_at + make_dt_interval(CAST(attempt * 7 AS INT), 0, CAST(attempt * 2 AS INT))"))


@query
def stream_stalled(c):
    ended = c["job_ends"].select("job_id", F.col("ended_text").cast("timestamp").alias("ended_at"))
    log = timed(c["job_results"]).select("job_id", "written_at", "off")
    return written_spells(c, in_turns(c, log, lambda live, rows, checkpoint: streams.stream_spells(live, streams.STALL, DELAY, rows, checkpoint, ended)))


@query
def stream_expiry(c):
    shown = spaced_results(c).select("job_id", "written_at", "off")
    return written_spells(c, in_turns(c, shown, lambda live, rows, checkpoint: streams.stream_spells(live, streams.KEPT, DELAY, rows, checkpoint)))


@query
def stream_results(c):
    log = spaced_results(c).select("job_id", "url", "off", "mark", "written_at")
    return streams.read_results(c.spark, in_turns(c, log, streams.stream_results))


@query
def stream_rate_limit(c):
    rows, checkpoint = stream_place(c)
    reads = arriving(c, "fetch_log").withColumn("fetched_at", F.col("fetched_text").cast("timestamp"))
    waits = fetchlog.retry_after_seconds(reads).withColumn("wait", F.coalesce("retry_after_seconds", F.lit(0.0)))
    streams.stream_rate_limit(waits, rows, checkpoint)
    return streams.read_pauses(c.spark, rows)


@query
def stream_page_contents(c):
    rows, checkpoint = stream_place(c)
    streams.stream_page_contents(arriving(c, "pages_rich"), rows, checkpoint)
    return c.spark.read.parquet(rows).withColumn("headings", F.size("headings"))


QUERIES["scan_pages"] = QUERIES.pop("scan_pages_")
