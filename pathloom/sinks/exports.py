"""Exports as lines of text and JSON records: a bounded number of files, and a manifest of each site's bytes in them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

BOM = "﻿"

# Column names of the exports.
CONTENT_COLUMNS = [
    "url", "pattern", "status", "title", "description", "h1", "canonical", "robots", "word_count", "internal_links",
    "external_links", "schema_types", "headings", "read_from", "text",
]
LINK_COLUMNS = ["url", "pattern"]
FAILURE_COLUMNS = ["url", "pattern", "reason"]
CAPTURE_COLUMNS = ["file", "url", "pattern", "width", "height", "cut_short"]


DATA, MANIFEST = "data", "manifest"
#: Bytes of an export handed over at a time.
BLOCK = 1 << 20


def quoted(cell: Column) -> Column:
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(cells: Sequence[Column]) -> Column:
    return F.concat_ws(",", *[quoted(cell) for cell in cells])


def header_line(columns: Sequence[str], quote: bool = False) -> str:
    """First line of an export file, with the mark that lets spreadsheets read UTF-8."""
    return BOM + ",".join(f'"{name}"' if quote else name for name in columns)


#: What the one text column of an export ends with, and a header that sorts before all rows.
LINE_END, JSON_END = "\r\n", "\n"
FIRST = -(1 << 62)


def write_bucketed(rows: DataFrame, path: str, buckets: int, header: str | None, end: str) -> None:
    """Writes (site, seq, value) as at most ``buckets`` files and a table that says which bytes of which file are a site's export.

    Rows are range partitioned by (site, seq): a bucket holds many small sites, or a piece of a large one, and no task a whole hot site. The
    number of files depends on ``buckets`` alone, not on the number of sites. Repeated (site, seq) are kept. The manifest (site, piece, file,
    start, length) has one row per site and bucket; a site's pieces in order, byte for byte, are its export. Null values are empty lines.
    """
    spark = rows.sparkSession
    table = rows.select("site", "seq", F.coalesce("value", F.lit("")).alias("value"))
    if header is not None:
        first = table.select("site").distinct()
        table = table.unionByName(first.select("site", F.lit(FIRST).alias("seq"), F.lit(header).alias("value")))
    # Written once, as sampled range bounds may differ when lost tasks run again.
    placed = cut_lineage(table.repartitionByRange(buckets, "site", "seq", "value").withColumn("bucket", F.spark_partition_id()))
    in_order = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "site", "seq", "value")
    in_order.select("bucket", "value").write.mode("overwrite").partitionBy("bucket").option("lineSep", end).option("compression", "none").text(f"{path}/{DATA}")
    sizes = placed.groupBy("bucket", "site").agg(F.sum(F.octet_length("value") + F.lit(len(end))).cast("long").alias("length"))
    within = Window.partitionBy("bucket").orderBy("site").rowsBetween(Window.unboundedPreceding, -1)
    started = sizes.withColumn("start", F.coalesce(F.sum("length").over(within), F.lit(0)))
    files = spark.createDataFrame(bucket_files(spark, path), "bucket int, file string")
    pieces = started.join(F.broadcast(files), "bucket")  # at most ``buckets`` files
    pieces.select("site", F.col("bucket").alias("piece"), "file", "start", "length").write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def bucket_files(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(bucket, path of its file below the export's folder). A bucket is written by one task, hence one file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{DATA}/bucket=*/part-*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    names = ["/".join(status.getPath().toString().split("/")[-3:]) for status in found]
    return [(int(name.split("/")[1].split("=")[1]), name) for name in names]


def site_pieces(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """(site, piece, file, start, length) of one site or of all; read the ranges in the order of ``piece``."""
    pieces = spark.read.parquet(f"{path}/{MANIFEST}")
    return pieces if site is None else pieces.filter(F.col("site") == site)


def site_export(spark: SparkSession, path: str, site: str) -> Iterator[bytes]:
    """The bytes of one site's export, piece by piece, read from their ranges alone."""
    hadoop = spark._jvm.org.apache.hadoop
    for piece in site_pieces(spark, path, site).orderBy("piece").collect():  # at most one row per bucket
        place = hadoop.fs.Path(f"{path.rstrip('/')}/{piece['file']}")
        opened = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
        try:
            opened.seek(piece["start"])
            left = piece["length"]
            while left > 0:
                block = bytes(opened.readNBytes(min(left, BLOCK)))
                if not block:
                    raise EOFError(f"{piece['file']} ends {left} bytes early")
                left -= len(block)
                yield block
        finally:
            opened.close()


def write_lines(lines: DataFrame, path: str, header: str, buckets: int | None = None) -> None:
    """Writes (site, seq, line); each site's export starts with the header. As many buckets as shuffle partitions unless said otherwise."""
    buckets = buckets or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(lines.withColumnRenamed("line", "value"), path, buckets, header, LINE_END)


def contents_csv(pages: DataFrame) -> DataFrame:
    """(site, seq, line) for the pages that were read."""
    headings = F.array_join(
        F.transform("headings", lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["text"])), " | "
    )
    cells = [
        F.array_join("schema_types", "; ") if name == "schema_types" else headings if name == "headings" else F.col(name)
        for name in CONTENT_COLUMNS
    ]
    return pages.filter("ok").select("site", "seq", csv_line(cells).alias("line"))


def contents_json(pages: DataFrame) -> DataFrame:
    """(site, seq, record) with one JSON text per page that was read; every key is there, null ones too."""
    record = F.struct(
        "url",
        "pattern",
        "status",
        F.col("final_url").alias("finalUrl"),
        "lang",
        "title",
        "description",
        "h1",
        "canonical",
        "robots",
        F.col("word_count").alias("wordCount"),
        F.col("internal_links").alias("internalLinks"),
        F.col("external_links").alias("externalLinks"),
        F.col("schema_types").alias("schemaTypes"),
        "headings",
        F.col("read_from").alias("readFrom"),
        "text",
        F.col("text_truncated").alias("textTruncated"),
    )
    return pages.filter("ok").select("site", "seq", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def write_json(records: DataFrame, path: str, buckets: int | None = None) -> None:
    """Writes (site, seq, record), one record per line."""
    buckets = buckets or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(records.withColumnRenamed("record", "value"), path, buckets, None, JSON_END)


def links_csv(pages: DataFrame) -> DataFrame:
    return pages.select("site", "seq", csv_line([F.col(name) for name in LINK_COLUMNS]).alias("line"))


def failures_csv(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("ok")).select(
        "site", "seq", csv_line([F.col("url"), F.col("pattern"), F.col("error")]).alias("line")
    )


def capture_manifest(numbered: DataFrame) -> DataFrame:
    cut = F.when(F.col("cut_short"), F.lit("yes")).otherwise("no")
    cells = [F.col("file"), F.col("url"), F.col("pattern"), F.col("width"), F.col("height"), cut]
    return numbered.select("site", "seq", csv_line(cells).alias("line"))
