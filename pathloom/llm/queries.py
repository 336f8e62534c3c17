"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, ship_package
from . import merkle, packing
from .chat_format import format_chats
from .collocations import mine_phrases
from .decontamination import find_overlaps, overlap_report
from .exact_dedup import group_copies
from .licenses import known_digests, scan_licenses
from .mixing import mix_sources, repeating_weights
from .near_dedup import NearDuplicates
from .suffix_dedup import as_digest, remove_repeats
from .token_counts import apply_edits, build_trees, three_edits
from .toxicity import THRESHOLD, score_documents, train
from .url_filter import Rule, filter_urls

#: Which hosts and paths the registered query decides by rule.
URL_RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"), known_digests(spark))
    return found.withColumns({name: F.array_join(name, ",") for name in ("licenses", "statements")})


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"), finish=as_digest)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = NearDuplicates(table(spark, folder, "documents"), size=4).classes()
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return group_copies(docs).drop("rest")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_documents(docs, train(docs, table(spark, folder, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), URL_RULES)


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all documents before and after three edits of each."""
    trees = build_trees(table(spark, folder, "documents").select("doc_id", "text"))
    before = trees.withColumns({"edits": three_edits(F.col("id"), F.col("text")), "rest": F.struct("n_tokens", F.length("text").alias("n_chars"))})
    after = apply_edits(before, keep_text=False)
    leaves = (F.size("chars") / 2).cast("int")
    return after.select(
        F.col("id").alias("doc_id"),
        F.col("rest.n_chars").alias("n_chars"),
        F.col("rest.n_tokens").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        "n_applied",
        F.element_at("chars", 2).alias("n_chars_edited"),
        "n_encoded",
        leaves.alias("n_leaves"),
    )


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mix = mix_sources(docs, repeating_weights(docs))
    return mix.select("row.doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return overlap_report(find_overlaps(docs, table(spark, folder, "benchmark"), keep_text=False))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.pack_documents(docs, finish=packing.as_crc32, finish_type="long")
    return pieces.select("doc_id", "start", "length", F.col("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose id's CRC-32 is divisible by 3 are read again with A-Z lower-cased."""
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    smaller = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    manifest = merkle.build_manifest(docs, changed=changed, now={"text": smaller}, proof=merkle.as_digest, proof_type="string")
    return manifest.withColumnRenamed("proof", "proof_sha256")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(table(spark, folder, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_packing": op11_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collocations": op13_collocations,
}
