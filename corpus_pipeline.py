"""A training-data pipeline: each stage applies one operator to what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last one adds ``copies``, how
often the mix takes a document. Documents with a null or empty text are kept by the first stage, become one by the
second, and are left out by the last, as they have no words to take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.decontamination import clean_documents
from pathloom.llm.exact_dedup import drop_copies
from pathloom.llm.mixing import mix_sources, repeating_weights
from pathloom.llm.near_dedup import drop_near_copies
from pathloom.llm.toxicity import drop_toxic, train
from pathloom.session import bound_batches, cut_lineage, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is fitted to the training rows of ``labels``."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8 or more) the smallest doc_id stays."""
    return drop_near_copies(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten consecutive words of a benchmark item occur (or all of a shorter item) go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often: weights 1, 2, 3 in turn over the sources by name."""
    mix = mix_sources(docs, repeating_weights(docs)).filter("copies > 0 AND size > 0")
    columns = [name for name in docs.columns if name != "copies"]
    return mix.select(*[F.col(f"row.`{name}`") for name in columns], "copies")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again."""
    ship_package(spark)
    bound_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


#: The toxicity stage fits a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None
