"""Reading jobs as tables: items, an append-only result log, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import attach, rank_in_group
from .urls import compact_url, slug_of

RESULTS_PAGE = 50
RETRY_ROUNDS = 2
DEFAULT_WAIT = 10.0
MAX_WAIT = 60.0


def latest_results(log: DataFrame) -> DataFrame:
    """The last reading per (job_id, url) of an append-only log with offsets ``off``; map-side combined."""
    values = [name for name in log.columns if name not in ("job_id", "url")]
    last = F.max_by(F.struct(*values), "off").alias("_last")
    return log.groupBy("job_id", "url").agg(last).select("job_id", "url", *[f"_last.{name}" for name in values])


def job_progress(items: DataFrame, log: DataFrame) -> DataFrame:
    """Per job: pages, pages read, failed, results written, kinds waiting, status.

    ``items`` (job_id, idx, url), ``log`` (job_id, url, off, mark).
    """
    written = log.groupBy("job_id").agg(F.count(F.lit(1)).alias("results"))
    marked = items.join(latest_results(log.select("job_id", "url", "off", "mark")), ["job_id", "url"], "left")
    mark = F.coalesce(F.col("mark"), F.lit("."))
    counts = marked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(mark != ".").alias("done"),
        F.count_if(mark.isin("r", "b", "x")).alias("failed"),
        F.count_if(mark == "r").alias("to_retry"),
        F.count_if(mark.isin("s", "b")).alias("to_render"),
    )
    status = F.when(F.col("done") < F.col("total"), F.lit("running")).otherwise("done")
    return counts.join(written, "job_id", "left").withColumn("results", F.coalesce("results", F.lit(0))).withColumn("status", status)


def restored_groups(items: DataFrame) -> DataFrame:
    """A job's pages under their stored templates: (job_id, pattern, count, idx, url), larger templates first
    when sorted by (count desc, pattern, idx). URLs on the job's origin are given as paths."""
    sizes = items.groupBy("job_id", "pattern").agg(F.count(F.lit(1)).alias("count"))
    return attach(items, sizes, ["job_id", "pattern"], ["idx"]).select(
        "job_id", "pattern", "count", "idx", compact_url(F.col("url"), F.col("origin")).alias("url")
    )


def read_summary(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Per site: pages read, failed and not read, from pages (site, url) and results (site, url, ok)."""
    marked = pages.join(results.select("site", "url", "ok"), ["site", "url"], "left")
    return marked.groupBy("site").agg(
        F.count_if(F.col("ok")).alias("ok"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok").isNull()).alias("skipped"),
    )


def capture_summary(captures: DataFrame) -> DataFrame:
    return captures.groupBy("site").agg(
        F.count_if(F.col("ok")).alias("captured"),
        F.count_if(~F.col("ok")).alias("missed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("image_bytes"),
    )


def pending_pages(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Targets without a good reading."""
    good = results.filter("ok").select("site", "url").distinct()
    return targets.join(good, ["site", "url"], "left_anti")


def job_targets(
    sample: DataFrame, results: DataFrame, cap: int | None = None, width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pages to read per site, all or the first ``cap`` still pending, and (site, targets, skipped)."""
    pending = pending_pages(sample, results)
    extra = {"width": width} if width else {}
    ranked = rank_in_group(pending, ["site"], "seq", "_rn", "_n", **extra)
    kept = ranked if cap is None else ranked.filter(F.col("_rn") <= cap)
    counts = kept.groupBy("site").agg(F.count(F.lit(1)).alias("targets"), (F.max("_n") - F.count(F.lit(1))).alias("skipped"))
    return kept.withColumn("idx", F.col("_rn") - 1).drop("_rn", "_n"), counts


def page_pattern_lookup(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds the template of each page, ``/`` when it has none."""
    known = patterns.groupBy("site", "url").agg(F.min("pattern").alias("pattern"))
    return pages.join(known, ["site", "url"], "left").withColumn("pattern", F.coalesce("pattern", F.lit("/")))


def merge_reads(rendered: DataFrame, earlier: DataFrame, keep_failure: bool = False) -> DataFrame:
    """A second reading merged with the one before: the new one when it is good or there was no good one,
    else the earlier one with the reason the second failed.

    Both have (job_id, url, ok, error, text, needs_render). With ``keep_failure`` an earlier failure is kept
    too and ``needs_render`` stays as it was.
    """
    before = earlier.select(
        "job_id",
        "url",
        *[F.col(name).alias(f"_{name}") for name in ("ok", "error", "text", "needs_render")],
    )
    both = rendered.join(before, ["job_id", "url"], "left")
    had_good = F.coalesce(F.col("_ok"), F.lit(False))
    keep = ~F.col("ok") & (F.col("_ok").isNotNull() if keep_failure else had_good)
    needs = F.col("_needs_render") if keep_failure else F.lit(False)
    pick = lambda name: F.when(keep, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
    return both.select(
        "job_id",
        "url",
        pick("ok"),
        pick("error"),
        pick("text"),
        F.when(keep, needs).otherwise(F.col("needs_render")).alias("needs_render"),
        F.when(keep & had_good, F.col("error")).alias("render_error"),
    )


def results_lookup(log: DataFrame, offset: int, page: int = RESULTS_PAGE) -> DataFrame:
    """Results written from ``offset`` on, one page of the log per job: each URL once, with its current result.

    ``log`` (job_id, off, url, mark) with dense offsets from 0.
    """
    start = max(0, offset)
    part = log.filter(F.col("off").between(start, start + page - 1)).groupBy("job_id", "url").agg(F.min("off").alias("first_off"))
    wanted = log.join(part.select("job_id", "url"), ["job_id", "url"], "left_semi")
    current = latest_results(wanted.select("job_id", "url", "off", "mark")).withColumnRenamed("off", "current_off")
    return part.join(current, ["job_id", "url"])


def second_read_queue(items: DataFrame, log: DataFrame, rounds: int = RETRY_ROUNDS, width: int | None = None) -> DataFrame:
    """Which pages are read again and where: temporary failures are retried at most ``rounds`` times, pages built
    by scripts and refused ones go to a browser. (job_id, queue, position, url) in item order."""
    last = latest_results(log.select("job_id", "url", "off", "mark"))
    tries = log.groupBy("job_id", "url").agg(F.count(F.lit(1)).alias("reads"))
    queue = F.when((F.col("mark") == "r") & (F.col("reads") <= rounds), F.lit("retry")).when(
        F.col("mark").isin("s", "b"), F.lit("render")
    )
    queued = (
        items.join(last, ["job_id", "url"]).join(tries, ["job_id", "url"]).withColumn("queue", queue)
        .filter(F.col("queue").isNotNull())
    )
    extra = {"width": width} if width else {}
    return rank_in_group(queued, ["job_id", "queue"], "idx", "position", **extra).select("job_id", "queue", "position", "url")


def capture_numbering(captures: DataFrame, width: int | None = None, most: int | None = None) -> DataFrame:
    """File names for good captures (site, seq, url, ok): number in list order, at least three digits, and a slug,
    whole or its first ``most`` characters."""
    extra = {"width": width} if width else {}
    numbered = rank_in_group(captures.filter("ok"), ["site"], "seq", "number", "_total", **extra)
    digits = F.greatest(F.lit(3), F.length(F.col("_total").cast("string")))
    name = F.concat(F.lpad(F.col("number").cast("string"), digits, F.lit("0")), F.lit("-"), slug_of(F.col("url"), most), F.lit(".jpg"))
    return numbered.withColumn("file", name).drop("_total")


def pause_end(seen_at: Column, wait: Column) -> Column:
    """When a site that asked for fewer requests may be read again: after the wait, or 10 s, at most 60 s."""
    seconds = F.least(F.when(wait > 0, wait).otherwise(F.lit(DEFAULT_WAIT)), F.lit(MAX_WAIT))
    return F.timestamp_millis(F.unix_millis(seen_at) + (seconds * 1000).cast("long"))


def rate_limit_pauses(reads: DataFrame) -> DataFrame:
    """(site, pause_until) from reads (site, fetched_at, status, wait)."""
    limited = reads.filter(F.col("status") == 429)
    return limited.groupBy("site").agg(F.max(pause_end(F.col("fetched_at"), F.col("wait"))).alias("pause_until"))


