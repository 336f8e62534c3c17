"""A table with one row per key on disk, kept up to date by micro-batches.

Rows lie in buckets by the hash of their key. A micro-batch merges its rows into the buckets they belong to, writes those as files of a new
version, named after the batch, and then a manifest that says which version of each bucket holds. Readers only see whole versions. A
repeated batch finds its manifest and changes nothing. Files no manifest names are deleted, so the table holds as many rows as keys.

With a time column and a time to live, rows older than that are deleted. The clock is the newest time any batch has brought, not the time of
day, so a repeated run gives the same table. The manifest knows the oldest row of each bucket; buckets without old rows are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
ENTRIES = "bucket int, version long, time long"
#: Stands for the bucket in the entry that holds the clock.
CLOCK = -1


class Snapshot:
    """``merge`` makes one row per key out of the old and new rows of a bucket (same columns).

    ``time`` is a timestamp column, and ``live`` how many milliseconds a row stays after it. Rows without a time stay.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        keys: Sequence[str],
        merge: Callable[[DataFrame], DataFrame],
        buckets: int = BUCKETS,
        time: str | None = None,
        live: int = 0,
    ):
        self.spark, self.folder, self.keys, self.merge, self.buckets = spark, folder.rstrip("/"), list(keys), merge, buckets
        self.time, self.live = time, live

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _named(self, *pattern: str) -> list[str]:
        """Folders that match; as they are named in this class, the last part of a path is unique."""
        return [status.getPath().toString() for status in self._files().globStatus(self._path(*pattern)) or []]

    def batches(self) -> list[int]:
        """Numbers of the whole versions, ascending."""
        return sorted(int(path.split("/")[-2].split("=")[1]) for path in self._named("manifest", "batch=*", "_SUCCESS"))

    def _entries(self, batch: int) -> list:
        """(bucket, version, time) rows: the oldest time of each bucket with rows, and the clock under ``CLOCK``."""
        return self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/manifest/batch={batch}").collect()

    def manifest(self, batch: int) -> dict[int, int]:
        """The version of each bucket that has rows. At most one entry per bucket."""
        return {row["bucket"]: row["version"] for row in self._entries(batch) if row["bucket"] != CLOCK}

    def _oldest(self, number: int) -> dict[int, int | None]:
        """Of the version before a batch."""
        earlier = [done for done in self.batches() if done < number]
        return {row["bucket"]: row["time"] for row in self._entries(earlier[-1])} if earlier else {}

    def _rows(self, manifest: dict[int, int], only: set[int] | None, schema: str) -> DataFrame:
        paths = [f"{self.folder}/rows/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, schema: str) -> DataFrame:
        """All rows as of the last whole version; ``schema`` names the columns."""
        done = self.batches()
        return self._rows(self.manifest(done[-1]) if done else {}, None, schema)

    def before(self, number: int, rows: DataFrame) -> DataFrame:
        """The rows that held before a batch, in the buckets its rows belong to."""
        return self._rows(self._previous(number), self._touched(rows), rows.schema.simpleString()[len("struct<") : -1].replace(":", " "))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {row["bucket"] for row in rows.select(self._bucket().alias("bucket")).distinct().collect()}  # at most one per bucket

    def _previous(self, number: int) -> dict[int, int]:
        earlier = [done for done in self.batches() if done < number]
        return self.manifest(earlier[-1]) if earlier else {}

    def apply(self, rows: DataFrame, number: int) -> None:
        """Merges the rows of a batch and deletes what is too old. Does nothing if the batch was merged before."""
        if number in self.batches():
            return
        previous, touched, oldest = self._previous(number), self._touched(rows), self._oldest(number)
        clock = None
        if self.time:
            newest = rows.agg(F.max(F.unix_millis(self.time))).first()[0]
            clock = max([at for at in (oldest.pop(CLOCK, None), newest) if at is not None], default=None)
        if clock is not None:
            touched |= {bucket for bucket, at in oldest.items() if at is not None and at < clock - self.live}
        old = self._rows(previous, touched, rows.schema.simpleString()[len("struct<") : -1].replace(":", " "))
        merged = self.merge(old.unionByName(rows)).select(rows.columns).withColumn("bucket", self._bucket())
        if clock is not None:
            merged = merged.filter(F.coalesce(F.unix_millis(self.time) >= clock - self.live, F.lit(True)))
        place = f"{self.folder}/rows/version={number}"
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        filled = {int(path.split("=")[-1]) for path in self._named("rows", f"version={number}", "bucket=*")}
        ages = {}
        if self.time and filled:
            stored = self.spark.read.schema(merged.schema).parquet(place).groupBy("bucket").agg(F.min(F.unix_millis(self.time)).alias("time"))
            ages = {row["bucket"]: row["time"] for row in stored.collect()}  # at most one per bucket
        now = {b: v for b, v in previous.items() if b not in touched} | {b: number for b in filled}
        entries = [(b, v, ages.get(b) if v == number else oldest.get(b)) for b, v in sorted(now.items())]
        if clock is not None:
            entries.append((CLOCK, number, clock))
        table = self.spark.createDataFrame(entries, ENTRIES).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")
        self._clean(now, number)

    def _clean(self, manifest: dict[int, int], number: int) -> None:
        files = self._files()
        for path in self._named("rows", "version=*", "bucket=*"):
            version, bucket = (int(part.split("=")[1]) for part in path.split("/")[-2:])
            if manifest.get(bucket) != version:
                files.delete(self._path("rows", f"version={version}", f"bucket={bucket}"), True)
        for done in self.batches():
            if done < number:
                files.delete(self._path("manifest", f"batch={done}"), True)
