"""Exact deduplication that no group of copies can overload.

Copies are combined in three steps, and every step compares the whole content, never a digest alone:

1. each task combines its own copies (Spark's partial aggregation, keyed by digest, salt and content);
2. the groups of one salt are merged. The salt is the number of the input partition modulo ``SALTS``, so a
   group that holds a third of all rows is spread over up to ``SALTS`` keys, and copies in one task meet before
   anything is sent;
3. the winner and the number of each salt, at most ``SALTS`` per content, are combined into the final ones, and those of contents
   with several salts are joined back by digest, salt and content. The members of a group stay under their salt.

The digest only orders the work: rows that have it in common but differ in content stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys over which one content is spread. At 100 TB a third of 3e10 rows gives 2.4 million ids per key.
SALTS = 4096


def group_copies(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = lambda content: content,
    keep_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``rest``.

    Of rows with equal content (after ``normalise``; a null counts as empty) the one with the largest id stays;
    a null id loses against any other, and of rows with the same id exactly one stays. ``rest`` is a struct of all
    other columns (null if there are none) and so can't clash with the columns added here. With ``keep_text`` the
    text comes back as ``text``, as it was before normalisation. An empty table gives an empty result.
    """
    others = [name for name in docs.columns if name not in (id, text)]
    rest = F.struct(*[F.col(f"`{name}`") for name in others]) if others else F.lit(None).cast("string")
    content = F.coalesce(normalise(F.coalesce(F.col(text), F.lit(""))), F.lit(""))
    rows = docs.select(
        content.alias("content"),
        F.coalesce(F.unhex(F.sha2(content, 256)), F.lit(b"")).alias("digest"),  # never null, which spares a filter in one use only
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"),
        F.struct(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"),
        F.struct(rest.alias("rest"), (F.col(text) if keep_text else F.lit(None).cast("string")).alias("text")).alias("more"),
    )
    # The input text is only carried where it differs from the content.
    same = F.col("more.text") == F.col("content")
    rows = rows.withColumn("more", F.struct("more.rest", F.when(~same, F.col("more.text")).alias("text"), same.alias("same")))
    # Both uses below take all of ``members``, so that Spark computes and moves them once; the row numbers have to agree.
    salted = rows.groupBy("digest", "salt", "content").agg(F.collect_list(F.struct("key", "more")).alias("members"))
    winners = salted.select("digest", "salt", "content", F.array_max("members.key").alias("winner"), F.size("members").cast("long").alias("n"))
    totals = winners.groupBy("digest", "content").agg(F.max("winner").alias("keep"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    spread = totals.filter(F.size("salts") > 1).select("digest", F.explode("salts").alias("salt"), "content", "keep", "group_size")
    merged = salted.join(spread, ["digest", "salt", "content"], "left").select(
        "digest",
        "content",
        F.coalesce("keep", F.array_max("members.key")).alias("keep"),
        F.coalesce("group_size", F.size("members").cast("long")).alias("group_size"),
        "members",
    )
    every = merged.select("digest", "content", "keep", "group_size", F.explode("members").alias("member"))
    result = [
        F.col("member.key.id").alias(id),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("member.key.row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member.more.rest").alias("rest"),
    ]
    if keep_text:
        result.append(F.when(F.col("member.more.same"), F.col("content")).otherwise(F.col("member.more.text")).alias("text"))
    return every.select(*result)


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns in its order."""
    kept = group_copies(docs, id, text, normalise, keep_text=True).filter("kept")
    return kept.select(
        *[F.col(name) if name == id else F.col("text").alias(text) if name == text else F.col(f"rest.`{name}`") for name in docs.columns]
    )
