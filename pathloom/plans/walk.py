"""Breadth-first walks over per-site graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, keep_placement
from .scale import first_k, rank_by_order

COMPACT_EVERY = 8


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def capped_walk(
    seeds: DataFrame, edges: DataFrame, cap: int | None, aliases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Visit nodes level by level, all or at most ``cap`` per site, each once, in breadth-first order.

    ``seeds`` (site, pos, url), ``edges`` (site, src, pos, dst), ``aliases`` (site, url, alias): another
    name of a node that counts as seen once it is visited. Returns visited (site, position, url, level)
    and left (site, left): how many known nodes the cap kept out.

    The edges are placed once by (site, src), so a level moves only its frontier and what it
    reaches. Nodes that a full site leaves out are never needed again, so visited nodes
    are the only state. Each level is a written table; every few levels they are put together.
    """
    edges = keep_placement(
        edges.repartition("site", "src").groupBy("site", "src", "dst").agg(F.min("pos").alias("pos"))
    )
    candidates = seeds.groupBy("site", "url").agg(F.min("pos").alias("_at")).withColumn("_from", F.lit(0).cast("long"))
    seeded = candidates.select("site", "url")
    levels: list[DataFrame] = []
    level = 0
    while True:
        order = [F.col("_from"), F.col("_at"), F.col("url")]
        if cap is None:
            ranked = rank_by_order(candidates, ["site"], order, "_rank")
        else:
            ranked = first_k(candidates, ["site"], order, cap, rank="_rank")
        if levels:
            used = _all(levels).groupBy("site").agg(F.max("position").alias("_used"))
            ranked = ranked.join(used, "site", "left").withColumn("_rank", F.col("_rank") + F.coalesce("_used", F.lit(0)))
        placed = (ranked if cap is None else ranked.filter(F.col("_rank") <= cap)).select(
            "site", F.col("_rank").cast("long").alias("position"), "url", F.lit(level).alias("level")
        )
        if aliases is None:
            placed = placed.withColumn("alias", F.col("url"))
        else:
            placed = placed.join(aliases, ["site", "url"], "left").withColumn("alias", F.coalesce("alias", "url"))
        frontier = cut_lineage(placed)
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > COMPACT_EVERY:
            levels = [cut_lineage(_all(levels))]
        seen = _all(levels).select("site", F.explode(F.array("url", "alias")).alias("url"))
        candidates = _reached(frontier, edges).join(seen, ["site", "url"], "left_anti")
        level += 1
    if not levels:
        empty = frontier.select("site", "position", "url", "level")
        return empty, empty.select("site", F.col("position").alias("left"))
    visited = _all(levels)
    if cap is None:  # nothing is left out
        return visited.drop("alias"), visited.select("site", F.lit(0).cast("long").alias("left")).limit(0)
    seen = visited.select("site", F.explode(F.array("url", "alias")).alias("url"))
    known = _reached(visited, edges).select("site", "url").unionByName(seeded).distinct()
    left = known.join(seen, ["site", "url"], "left_anti").groupBy("site").agg(F.count(F.lit(1)).alias("left"))
    return visited.drop("alias"), left


def _reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes one edge away, with the first place they were found at."""
    met = nodes.alias("v").join(edges.alias("e"), (F.col("v.site") == F.col("e.site")) & (F.col("v.url") == F.col("e.src")))
    first = F.min(F.struct(F.col("v.position").alias("_from"), F.col("e.pos").alias("_at"))).alias("_first")
    return (
        met.groupBy(F.col("v.site").alias("site"), F.col("e.dst").alias("url"))
        .agg(first)
        .select("site", "url", F.col("_first._at").alias("_at"), F.col("_first._from").alias("_from"))
    )
