"""Session settings this library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-node session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pathloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PATHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started. Done once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pathloom-code-")) / "pathloom_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: Rows and bytes of a batch that a Python worker gets at a time.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Smaller batches for Python workers where the session has Spark's own bounds, which are high for long texts."""
    for name, standard, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES),
    ):
        if spark.conf.get(name, standard) == standard:
            spark.conf.set(name, str(value))


def pin_utc(spark: SparkSession) -> None:
    """Timestamps are read and written as UTC, whatever the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only on one machine (a ``local`` master) a temporary one is made where neither the setting nor a checkpoint
    folder exists; on a cluster that is an error, as executors don't see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="pathloom-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder; survives the loss of executors and is read by column."""
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def keep_placement(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Unlike a written table it keeps the hash partitioning,
    so later joins on the same keys do not move these rows again.

    The partitioning is only known for plans that are fixed before they run, so adaptive planning pauses for this job.
    """
    conf = df.sparkSession.conf
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
