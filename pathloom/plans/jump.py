"""Long chains of single steps, followed by doubling: a path of n steps takes about log2(n) rounds.

A step table has one row (node, next) per node; a node without a row ends the paths that reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scale import attach


def doubled(steps: DataFrame) -> tuple[list[DataFrame], int]:
    """Tables (node, to, n, open, low), each reaching twice as far as the one before, and how many nodes of the last one never end.

    ``to`` is the node ``n`` steps on; a path is ``open`` while ``to`` has a step of its own. ``low`` is the smallest node passed. Each table
    is written. The rounds are over once no path is open; or once the open ones can only run in circles, which shows when in one round no
    path ended, no ``low`` fell and the nodes that open paths reach did not get fewer.
    """
    known = steps.select(F.col("node").alias("to"), F.lit(True).alias("_more"))
    first = attach(steps.select("node", F.col("next").alias("to")), known, ["to"], ["node"])
    table = cut_lineage(
        first.select("node", "to", F.lit(1).cast("long").alias("n"), F.coalesce("_more", F.lit(False)).alias("open"), F.col("node").alias("low"), F.lit(False).alias("fell"))
    )
    tables = [table]
    before = None
    while True:
        is_open = F.col("open")
        seen = tables[-1].agg(F.count_if(is_open), F.count_if(is_open & F.col("fell")), F.count_distinct(F.when(is_open, F.col("to")))).first()
        if seen[0] == 0 or (before is not None and seen[1] == 0 and (seen[0], seen[2]) == (before[0], before[2])):
            return tables, seen[0]
        before = seen
        here = tables[-1].drop("fell")
        further = here.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("open").alias("_open"), F.col("low").alias("_low"))
        # An ended path meets no row: its last node has no step.
        met = attach(here, further, ["to"], ["node"])
        on = F.col("_to").isNotNull()
        tables.append(
            cut_lineage(
                met.select(
                    "node",
                    F.coalesce("_to", "to").alias("to"),
                    (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
                    F.coalesce("_open", F.lit(False)).alias("open"),
                    F.when(on, F.least("low", "_low")).otherwise(F.col("low")).alias("low"),
                    (on & (F.col("_low") < F.col("low"))).alias("fell"),
                )
            )
        )


def path_ends(steps: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, end, n, loop) and the doubled tables: where the path of each node ends, and after how many steps.

    A path that runs into a circle passes each of its nodes once: ``loop`` is true, ``n`` counts the nodes passed and ``end`` is null.
    """
    tables, endless = doubled(steps)
    last = tables[-1]
    ended = last.filter(~F.col("open")).select("node", F.col("to").alias("end"), "n", F.lit(False).alias("loop"))
    if endless == 0:
        return ended, tables
    circling = last.filter("open")
    on_circle = circling.join(circling.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", "low")
    lengths = on_circle.groupBy("low").agg(F.count(F.lit(1)).alias("length"))
    circles = cut_lineage(attach(on_circle, lengths, ["low"], ["node"], how="inner").select("node", "length"))
    tails = cut_lineage(steps.join(circling, "node", "left_semi").join(circles, "node", "left_anti"))
    walked = doubled(tails)[0][-1].select("node", F.col("to").alias("_entry"), "n")
    led = attach(walked, circles.select(F.col("node").alias("_entry"), "length"), ["_entry"], ["node"], how="inner")
    around = circles.select("node", F.col("length").alias("n")).unionByName(led.select("node", (F.col("n") + F.col("length")).alias("n")))
    return ended.unionByName(around.select("node", F.lit(None).cast("string").alias("end"), "n", F.lit(True).alias("loop"))), tables


def passed_nodes(paths: DataFrame, tables: list[DataFrame], longest: int) -> DataFrame:
    """(start, place, node): the first ``n`` nodes of the path of each row of ``paths`` (start, n), from place 0 on.

    A piece of a path is cut in two by the longest table that fits until each piece is one node, so there are as many joins as tables used,
    and the rows grow to no more than the nodes returned.
    """
    pieces = paths.filter("n > 0").select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("place"), "n")
    for power in range(len(tables) - 1, -1, -1):
        reach = 1 << power
        if reach >= longest:
            continue
        hop = tables[power].filter(F.col("n") == reach).select("node", F.col("to").alias("_to"))
        met = attach(pieces, hop, ["node"], ["start"])
        long_, rest = F.col("n") > reach, F.struct("_to", F.col("place") + reach, F.col("n") - reach)
        near = F.struct(F.col("node").alias("node"), F.col("place").alias("place"), F.least("n", F.lit(reach)).alias("n"))
        far = rest.cast("struct<node:string,place:bigint,n:bigint>")
        halves = F.filter(F.array(near, F.when(long_, far)), lambda piece: piece.isNotNull())
        pieces = cut_lineage(met.select("start", F.explode_outer(halves).alias("_piece")).select("start", "_piece.*"))
    return pieces.select("start", "place", "node")
