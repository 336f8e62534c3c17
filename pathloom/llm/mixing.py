"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every row has a 48-bit hash of its id. A source takes whole passes over all its rows, and then the rows whose hash lies
below a threshold. The threshold is found without sorting: words are summed by source and the hash's top 12 bits, the
bucket in which the running sum meets the budget is split by the next 12 bits, and so on; after four levels it is one hash.
All joins with the rows use (source, top bits) as the key, so a source with a third of all rows spreads over 4096 keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but blanks and the control characters from tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text; of an empty text for a null."""
    digits = F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def capped_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``: its share of all sizes by weight, at most ``most`` times its size.

    What a capped source can't take goes to the others by weight, until none is above its cap. Sources are taken by
    falling need of a cap; each is capped if the level reached so far is above it. A weight that is null, zero or
    negative gives target 0. There is one row per source, not per document.
    """
    sources = sources.withColumn("_w", F.when(F.col("weight") > 0, F.col("weight").cast("double")))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    total = F.sum(F.col("source_size").cast("double")).over(every)
    level = (F.col("_total") - prior("_cap")) / (F.sum("_w").over(every) - prior("_w"))
    weighed = sources.withColumn("_total", total).filter(F.col("_w").isNotNull()).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    marked = weighed.withColumn("_full", level * F.col("_w") > F.col("_cap"))
    rest = (F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)) / F.sum(
        F.when(~F.col("_full"), F.col("_w"))
    ).over(every)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * rest))
    unweighed = sources.filter(F.col("_w").isNull()).withColumn("target", F.lit(0.0))
    columns = [name for name in sources.columns if name != "_w"] + ["target"]
    return marked.withColumn("target", target).select(columns).unionByName(unweighed.select(columns))


def _cuts(sized: DataFrame, top: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the hash up to which its rows are taken once more (``cut``), and whether the hash itself is."""
    state = None
    for depth in range(1, LEVELS + 1):
        shift = HASH_BITS - depth * LEVEL_BITS
        if state is None:
            sums = top.join(plan.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
            sums = sums.select("source", "budget", F.lit(0).cast("long").alias("base"), F.col("top").alias("bucket"), "words")
        else:
            rows = sized.select("source", F.shiftright("hash", shift + LEVEL_BITS).alias("inside"), F.shiftright("hash", shift).alias("bucket"), "size")
            same = rows["source"].eqNullSafe(state["s"]) & (rows["inside"] == state["prefix"])
            sums = rows.join(state, same).groupBy("source", "budget", "base", "bucket").agg(F.sum("size").alias("words"))
        below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("below", F.col("base") + F.coalesce(F.sum("words").over(below), F.lit(0)))
        met = sums.filter((F.col("below") <= F.col("budget")) & (F.col("budget") < F.col("below") + F.col("words")))
        state = met.select(F.col("source").alias("s"), "budget", F.col("below").alias("base"), F.col("bucket").alias("prefix"), "words")
    over, under = F.col("base") + F.col("words") - F.col("budget"), F.col("budget") - F.col("base")
    return state.select("s", F.col("prefix").alias("cut"), (over <= under).alias("with_cut"))


def mix_sources(
    docs: DataFrame, weights: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of its columns), ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``weights`` has one row per source (``source``, ``weight``); null is a source of its own and a source without a row
    weighs nothing. ``copies`` is how often the mix takes the row and ``taken`` the words that makes; copies never exceed
    ``most``, rounded up. Each source's taken words differ from its target by at most half of one row (of the rows with
    one hash). Empty texts have size 0. Rows with the same id are taken together. Reruns agree, as only ids decide.
    """
    keys = [F.col(source).alias("source"), hash_of(F.col(id)).alias("hash"), word_count(F.col(text)).alias("size")]
    sized = cut_lineage(docs.select(*keys))
    top = sized.groupBy("source", F.shiftright("hash", HASH_BITS - LEVEL_BITS).alias("top")).agg(F.sum("size").alias("words"))
    sizes = top.groupBy("source").agg(F.sum("words").alias("source_size"))
    named = weights.select(F.col("source").alias("s"), "weight")
    weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = capped_targets(weighed, most).drop("weight")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("passes", passes.cast("long")).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    cuts = _cuts(sized, top, plan)
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = top.select(F.col("source").alias("s"), "top").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), *keys)
    rows = rows.withColumn("_top", F.shiftright("hash", HASH_BITS - LEVEL_BITS))
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (F.col("_top") == F.col("top")))
    extra = F.when(F.col("with_cut"), F.col("hash") <= F.col("cut")).otherwise(F.col("hash") < F.col("cut"))
    copies = F.col("passes") + F.when((F.col("budget") > 0) & extra, F.lit(1)).otherwise(F.lit(0))  # a source at its cap has no more to give
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeating_weights(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A weight for each source: ``weights`` in turn, the sources by code point and null last."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    named = docs.select(F.col(source).alias("source")).distinct().withColumn("_turn", F.pmod(order - 1, F.lit(len(weights))))
    return named.select("source", F.get(F.array(*[F.lit(w) for w in weights]), F.col("_turn")).alias("weight"))
