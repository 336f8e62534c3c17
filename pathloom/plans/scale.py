"""Plan shapes that hold when one key owns a large part of the rows.

``attach``      a left/inner lookup join with salted keys
``rank_in_group``  row numbers per group over an integer order, in bounded pieces
``rank_by_order``  row numbers per group over any order, by range partitioning
``first_k``     the first k rows of each group, cut down before the shuffle
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

RANK_WIDTH = 1 << 17
# Rows of one key meet their lookup row in so many places.
SALTS = 8


def attach(
    fact: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join ``fact`` with ``dim`` (one row per key), keeping every fact row for ``left``. Nothing runs before an action.

    Each lookup row is repeated ``salts`` times, and a fact row picks one copy by its ``spread`` columns. So a hot key, or
    the rows without a key, are spread over that many tasks at every size; adaptive execution splits them further or
    broadcasts a small lookup table.
    """
    on = list(on)
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    values = [name for name in dim.columns if name not in on]
    return salted.join(copies, [*on, "_salt"], how).select(*fact.columns, *values)


def rank_in_group(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    rank: str = "rn",
    size: str | None = None,
    width: int = RANK_WIDTH,
) -> DataFrame:
    """1-based position of each row in its group by the integer column ``seq`` (unique in a group).

    A group is cut into slices of ``width`` consecutive seq values, so no task sees more than
    ``width`` rows of it; slice sizes are summed up to give each slice its starting rank.
    """
    by = list(by)
    sliced = df.withColumn("_slice", F.floor(F.col(seq) / F.lit(width)))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_slice_start"),
        F.sum("_rows").over(group).alias("_slice_size"),
    )
    left, right = sliced.alias("l"), starts.alias("r")
    same = F.col("l._slice") == F.col("r._slice")
    for name in by:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    joined = left.join(right, same, "inner").select("l.*", "r._slice_start", "r._slice_size")
    piece = Window.partitionBy(*by, "_slice").orderBy(seq)
    out = joined.withColumn(rank, F.row_number().over(piece) + F.col("_slice_start"))
    if size:
        out = out.withColumn(size, F.col("_slice_size"))
    return out.drop("_slice", "_slice_start", "_slice_size")


def rank_by_order(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rn") -> DataFrame:
    """1-based position of each row in its group by any (total) order.

    The rows are range partitioned by group and order and written with their partition; only groups that
    span several partitions need a starting rank, and those are fewer than the partitions.
    """
    by = list(by)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(partitions, *[F.col(name) for name in by], *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_part", F.sum("_rows").over(before).alias("_slice_start")).filter("_slice_start > 0")
    piece = Window.partitionBy(*by, "_part").orderBy(*order)
    return (
        placed.join(F.broadcast(starts), [*by, "_part"], "left")
        .withColumn(rank, F.row_number().over(piece) + F.coalesce("_slice_start", F.lit(0)))
        .drop("_part", "_slice_start")
    )


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows per group. Spark applies the limit per partition before the shuffle."""
    column = rank or "_rank"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col(column) <= k
    )
    return ranked if rank else ranked.drop(column)
