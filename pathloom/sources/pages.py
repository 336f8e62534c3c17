"""Reading stored crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fetchlog import HTML_TYPE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small scan over all cores, for work that costs more than moving the rows.

    A corpus stored in at least as many splits as there are cores is left where it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def scan_pages(captured: DataFrame) -> DataFrame:
    """HTML pages of (page_id, url, status, content_type, html); both filters reach the file scan's partitions
    and row groups when the columns are stored."""
    html = F.col("content_type").rlike(HTML_TYPE)
    return captured.filter((F.col("status") < 400) & html).select("page_id", "url", "html")


def robots_texts(spark: SparkSession, path: str, site: str = "([^/]+)/robots[.]txt$") -> DataFrame:
    """(site, text) from files laid out as ``<site>/robots.txt``; gzip files are read as they are."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), site, 1).alias("site"), F.col("value").alias("text"))


def sitemap_dump(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) rows of well-formed urlset files on disk, split inside large files by the XML reader."""
    return (
        spark.read.format("xml")
        .option("rowTag", "url")
        .schema("loc STRING, lastmod STRING")
        .load(path)
    )
