"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) is connected with.

    Each round gives an id the smallest label among its neighbours and then the label of that label, so chains shrink by
    half or better. Rounds end when no label changes; each is written to the shared folder, so no lineage builds up.
    Only ids with an edge take part.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("beyond"))
        stepped = met.join(jump, F.col("step") == F.col("j"), "left")
        found = cut_lineage(stepped.select("id", "old", F.least("step", F.coalesce("beyond", "step")).alias("component")))
        labels = found.select("id", "component")
        if found.filter("component <> old").isEmpty():
            return labels
