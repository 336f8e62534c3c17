"""The append-only result log as a stream. Every operator has a batch twin that gives the same rows.

State is kept per (job, page) or as one running maximum per key, never as a whole job in one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contents import page_contents
from ..operators.jobs import latest_results, pause_end
from .snapshot import Snapshot

# A gap of more than 90 seconds; session windows are half open, hence the extra millisecond.
STALL = "90001 milliseconds"
KEPT = "604800001 milliseconds"


def run_available(stream: DataFrame, checkpoint: str, write: Callable, mode: str = "append", **options) -> None:
    """Process what is there and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    write(writer).trigger(availableNow=True).start().awaitTermination()


def to_folder(folder: str):
    return lambda writer: writer.format("parquet").option("path", folder)


def per_batch(folder: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Each micro-batch replaces its own subfolder, so a repeated batch changes nothing."""

    def save(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return lambda writer: writer.foreachBatch(save)


# ---- latest reading ----------------------------------------------------------------------------

READINGS = "job_id string, url string, off long, mark string"
COUNTS = "job_id string, mark string, pages long"


def _readings(spark: SparkSession, folder: str) -> Snapshot:
    return Snapshot(spark, folder, ["job_id", "url"], latest_results)


def stream_latest(log: DataFrame, folder: str, checkpoint: str) -> None:
    """Keeps the last reading per (job_id, url) as a table of one row per key, merged by every micro-batch."""

    def merge(batch: DataFrame, number: int) -> None:
        _readings(batch.sparkSession, folder).apply(latest_results(batch), number)

    run_available(log.select("job_id", "url", "off", "mark"), checkpoint, lambda writer: writer.foreachBatch(merge))


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _readings(spark, folder).read(READINGS)


# ---- results and their time to live ------------------------------------------------------------

RESULTS = "job_id string, url string, off long, mark string, written_at timestamp"
WEEK = 7 * 86_400_000


def _results(spark: SparkSession, folder: str, live: int) -> Snapshot:
    return Snapshot(spark, folder, ["job_id", "url"], latest_results, time="written_at", live=live)


def stream_results(log: DataFrame, folder: str, checkpoint: str, live: int = WEEK) -> None:
    """Keeps the last result per (job_id, url) until ``live`` milliseconds after it was written; a page read again stays longer.

    Results that are too old are deleted from disk by the next micro-batch, by the newest time in the log. A late row older than that is not kept.
    """

    def merge(batch: DataFrame, number: int) -> None:
        _results(batch.sparkSession, folder, live).apply(batch, number)

    run_available(log.select("job_id", "url", "off", "mark", "written_at"), checkpoint, lambda writer: writer.foreachBatch(merge))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder, WEEK).read(RESULTS)


def kept_results(log: DataFrame, live: int = WEEK) -> DataFrame:
    """Batch twin: the last results that were not too old at the time of the last write of all."""
    last = latest_results(log.select("job_id", "url", "off", "mark", "written_at"))
    now = log.agg(F.max(F.unix_millis("written_at")).alias("_now"))
    return last.crossJoin(F.broadcast(now)).filter(F.coalesce(F.unix_millis("written_at") >= F.col("_now") - live, F.lit(True))).drop("_now")


# ---- progress ----------------------------------------------------------------------------------


def _counts(spark: SparkSession, folder: str) -> Snapshot:
    summed = lambda rows: rows.groupBy("job_id", "mark").agg(F.sum("pages").alias("pages")).filter("pages <> 0")
    return Snapshot(spark, f"{folder}/counts", ["job_id", "mark"], summed)


def stream_progress(log: DataFrame, folder: str, checkpoint: str) -> None:
    """Keeps pages per (job_id, mark). A page read again takes its old mark back: each micro-batch adds +1 for a page's new mark and -1
    for the one it had, summed per job and mark before they reach the counts.

    The counts are written before the marks they follow from; a batch that failed in between is taken up there.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks, counts = _readings(spark, f"{folder}/marks"), _counts(spark, folder)
        new = latest_results(batch).persist()
        if number not in counts.batches():
            old = marks.before(number, new)
            touched = old.join(new.select("job_id", "url"), ["job_id", "url"], "left_semi")
            sign = lambda rows, n: rows.select("job_id", "mark", F.lit(n).cast("long").alias("pages"))
            changes = sign(touched, -1).unionByName(sign(latest_results(touched.unionByName(new)), 1))
            counts.apply(changes.groupBy("job_id", "mark").agg(F.sum("pages").alias("pages")).filter("pages <> 0"), number)
        marks.apply(new, number)
        new.unpersist()

    run_available(log.select("job_id", "url", "off", "mark"), checkpoint, lambda writer: writer.foreachBatch(merge))


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Pages per job and mark as of the last micro-batch; one row per job and mark is stored."""
    return _counts(spark, folder).read(COUNTS)


def batch_progress(log: DataFrame) -> DataFrame:
    return latest_results(log.select("job_id", "url", "off", "mark")).groupBy("job_id", "mark").agg(F.count(F.lit(1)).alias("pages"))


# ---- jobs without news -------------------------------------------------------------------------


def quiet_spells(log: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """(job_id, last_write, writes) once a job has written nothing for ``gap``; works on streams, which need a delay, and tables."""
    if log.isStreaming and delay is None:
        raise ValueError("a stream needs the delay up to which late rows are waited for")
    timed = log.withWatermark("written_at", delay) if log.isStreaming else log
    spells = timed.groupBy("job_id", F.session_window("written_at", gap).alias("_spell")).agg(
        F.max("written_at").alias("last_write"), F.count(F.lit(1)).alias("writes")
    )
    return spells.select("job_id", "last_write", "writes", F.col("_spell.end").alias("_end"))


def not_ended(spells: DataFrame, ended: DataFrame | None) -> DataFrame:
    """Without the spells in which the job had ended before the gap was over. ``ended``: (job_id, ended_at) of jobs that don't run any more."""
    if ended is None:
        return spells
    gone = ended.select(F.col("job_id").alias("_job"), F.col("ended_at").alias("_ended"))
    return spells.join(gone, (F.col("job_id") == F.col("_job")) & F.coalesce(F.col("_ended") < F.col("_end"), F.lit(True)), "left_anti")


def closed_spells(log: DataFrame, gap: str, ended: DataFrame | None = None) -> DataFrame:
    """Batch twin: the spells over by the time of the last write of all."""
    now = log.agg(F.max("written_at").alias("_now"))
    spells = not_ended(quiet_spells(log, gap), ended).crossJoin(F.broadcast(now))
    return spells.filter(F.col("_end") <= F.col("_now")).select("job_id", "last_write", "writes")


def stream_spells(log: DataFrame, gap: str, delay: str, folder: str, checkpoint: str, ended: DataFrame | None = None) -> None:
    """Writes each spell when the watermark passes its end: stalled jobs, or results past their keep time.

    Rows that come up to ``delay`` after newer rows of an earlier micro-batch are counted, later ones may be lost, and a spell is written that
    much later. For stalled jobs ``ended`` leaves out those that are done, stopped or failed (see ``not_ended``).
    """
    run_available(not_ended(quiet_spells(log, gap, delay), ended).drop("_end"), checkpoint, to_folder(folder))


def expired_results(log: DataFrame, now, days: int = 7) -> DataFrame:
    """Rows of jobs whose last write is more than ``days`` before ``now``."""
    last = log.groupBy("job_id").agg(F.max("written_at").alias("_last"))
    gone = last.filter(F.unix_millis("_last") + F.lit(days * 86_400_000) < F.unix_millis(now)).select("job_id")
    return log.join(gone, "job_id", "left_semi")


# ---- waiting times -----------------------------------------------------------------------------


def stream_rate_limit(reads: DataFrame, folder: str, checkpoint: str) -> None:
    """Running end of the pause per site; each micro-batch saves the sites it changed."""
    ends = (
        reads.filter(F.col("status") == 429)
        .groupBy("site")
        .agg(F.max(pause_end(F.col("fetched_at"), F.col("wait"))).alias("pause_until"))
    )
    run_available(ends, checkpoint, per_batch(folder), mode="update")


def read_pauses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("site").agg(F.max("pause_until").alias("pause_until"))


# ---- contents of arriving pages ----------------------------------------------------------------


def stream_page_contents(pages: DataFrame, folder: str, checkpoint: str) -> None:
    """The batch projection on a stream; stateless."""
    run_available(page_contents(pages), checkpoint, to_folder(folder))
