"""A Merkle manifest of a dataset: one tree per part, a crown over the parts, and a proof for every row.

The leaves of a part, in order, are cut into superblocks of 8**3 leaves, so no task holds more of a part than that.

1. Going up, each superblock is reduced to one node; the nodes of a part form the next, 512 times smaller, level. This ends when
   every part is one superblock. The subroots of all parts are reduced likewise.
2. Going down, the nodes of a level are cogrouped with the outer nodes that the superblock above them needs, which gives the outer
   nodes of the superblocks below.
3. Last, leaves and outer nodes are cogrouped by superblock: one call reduces the superblock again, joins each leaf's siblings
   inside it with those outside, and folds the leaf as it is read now up to the root.

Only digests are moved; texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import rank_by_order
from ..session import cut_lineage

#: Children of a node, and how many levels of nodes a superblock has.
RUN = 8
BLOCK_LEVELS = 3
BLOCK = RUN**BLOCK_LEVELS

_NODES = "key string, pos long, node string, name string"
_OUTER = "key string, block long, whole boolean, before array<string>, after array<string>, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the columns' values, each as its number of bytes, a colon and itself; ``-`` for a null."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tree_levels(nodes: list[str], whole: bool) -> list[list[str]]:
    """The nodes and all levels above them: up to the only node, or, for one of several superblocks, BLOCK_LEVELS of them."""
    levels = [nodes]
    while len(levels[-1]) > 1 or (whole and len(levels) <= BLOCK_LEVELS):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def path_of(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """For each level below the last one, the siblings of the node on the path from ``at``: those before it and those after it."""
    before, after = [], []
    for level in levels[:-1]:
        start = at - at % RUN
        before.append("".join(level[start:at]))
        after.append("".join(level[at + 1 : start + RUN]))
        at //= RUN
    return before, after


def fold(node: str, before: Sequence[str], after: Sequence[str]) -> str:
    """The root that a node leads to with these siblings."""
    for left, right in zip(before, after, strict=True):
        node = digest(left + node + right)
    return node


def as_list(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """A proof as its digests, level by level from left to right."""
    joined = "".join(left + right for left, right in zip(before, after, strict=True))
    return [joined[i : i + 64] for i in range(0, len(joined), 64)]


def as_digest(before: Sequence[str], after: Sequence[str]) -> str:
    """A proof as the digest of its digests."""
    return digest("".join(left + right for left, right in zip(before, after, strict=True)))


def _reduced(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    levels = tree_levels(nodes.sort_values("pos")["node"].tolist(), whole=True)
    top = next(level[0] for level in levels if len(level) == 1)
    return pd.DataFrame({"key": [key[0]], "block": [key[1]], "top": [top], "whole": [levels[-1][0]]})


def _expanded(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The outer nodes of each node: its siblings in the superblock, then those of the superblock."""
    nodes, above = nodes.sort_values("pos"), outer.iloc[0]
    levels = tree_levels(nodes["node"].tolist(), bool(above["whole"]))
    paths = [path_of(levels, i) for i in range(len(nodes))]
    return pd.DataFrame(
        {
            "key": nodes["key"],
            "block": nodes["pos"],
            "whole": True,
            "before": [[*before, *above["before"]] for before, _ in paths],
            "after": [[*after, *above["after"]] for _, after in paths],
            "subroot": above["subroot"],
            "root": above["root"],
            "name": nodes["name"],
        }
    )


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(BLOCK)))


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each level its placed nodes, and the keys that end there, as (key, subroot)."""
    levels, ends = [], []
    while True:
        placed = _placed(nodes)
        levels.append(placed)
        reduced = placed.select("key", "block", "pos", "node").groupBy("key", "block").applyInPandas(
            _reduced, "key string, block long, top string, whole string"
        )
        blocks = cut_lineage(reduced)
        several = blocks.filter("block = 1").select("key")  # keys with more than one superblock
        first = blocks.filter("block = 0")  # one row per key, so the joins below see no hot key
        ends.append(first.join(several, "key", "left_anti").select("key", F.col("top").alias("subroot")))
        if several.isEmpty():
            return levels, ends
        more = first.join(several, "key", "left_semi").union(blocks.filter("block > 0"))
        nodes = more.select("key", F.col("block").alias("pos"), F.col("whole").alias("node"), F.lit(None).cast("string").alias("name"))


def _outer(levels: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    """The outer nodes of the superblocks of the lowest level. ``ends`` has those of the keys that end at each level."""
    outer = ends[-1]
    for placed, end in zip(levels[:0:-1], ends[-2::-1], strict=True):
        above = _cogrouped(placed, outer, _expanded, _OUTER + ", name string").drop("name")
        outer = cut_lineage(above.unionByName(end))
    return outer


def _cogrouped(nodes: DataFrame, outer: DataFrame, work: Callable, schema: str) -> DataFrame:
    return nodes.groupBy("key", "block").cogroup(outer.groupBy("key", "block")).applyInPandas(work, schema)


def _crown(subroots: DataFrame) -> DataFrame:
    """(key, whole = false, block = 0, before, after, subroot, root) of each part: its path to the root."""
    ranked = rank_by_order(subroots.withColumn("all", F.lit("")), ["all"], [F.col("key")])
    nodes = ranked.select(F.col("all").alias("key"), (F.col("rn") - 1).cast("long").alias("pos"), F.col("subroot").alias("node"), F.col("key").alias("name"))
    levels, ends = _grown(nodes)
    none = F.array().cast("array<string>")
    tops = [
        end.select("key", F.lit(0).cast("long").alias("block"), F.lit(False).alias("whole"), none.alias("before"), none.alias("after"), "subroot", F.col("subroot").alias("root"))
        for end in ends
    ]
    paths = _cogrouped(levels[0], _outer(levels, tops), _expanded, _OUTER + ", name string")
    of_part = paths.select(F.col("name").alias("key"), "before", "after", "root").join(subroots, "key")
    return cut_lineage(of_part.select("key", F.lit(0).cast("long").alias("block"), F.lit(False).alias("whole"), "before", "after", "subroot", "root"))


def build_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id: str = "doc_id",
    part: str = "lang",
    changed: Column | None = None,
    now: dict[str, Column] | None = None,
    proof: Callable[[Sequence[str], Sequence[str]], object] = as_list,
    proof_type: str = "array<string>",
) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified``.

    A leaf is ``leaf_of`` the fields. The leaves of a part ascend by id (null first, repeated ids by leaf); while a level has
    several nodes, each run of 8 becomes their digest. Parts are ordered by their value, null first, and reduced likewise.
    ``proof`` makes the proof's form out of the siblings on the path (``as_list`` or ``as_digest``).

    Where ``changed`` is true the row is read again with the columns of ``now`` in place of the fields of their names;
    ``folded_root`` is where that leaf leads with the proof, and ``verified`` whether it is the root. Without, every row verifies.
    Nulls, empty and long texts are values like any other; equal rows are leaves of their own; other columns are left out. An
    empty table gives an empty result.
    """
    column = lambda name: F.col(f"`{name}`")
    leaf = leaf_of([column(name) for name in fields])
    seen = F.lit(None).cast("string")
    if changed is not None:
        seen = F.when(changed, leaf_of([(now or {}).get(name, column(name)) for name in fields]))
    key = F.coalesce(F.concat(F.lit("1"), column(part).cast("string")), F.lit("0"))  # never null, null parts first
    leaves = docs.select(key.alias("key"), column(id).alias("id"), leaf.alias("node"), seen.alias("seen"))
    ranked = rank_by_order(cut_lineage(leaves), ["key"], [F.col("id").asc_nulls_first(), F.col("node")])
    nodes = cut_lineage(ranked.select("key", (F.col("rn") - 1).cast("long").alias("pos"), "node", F.lit(None).cast("string").alias("name"), "id", "seen"))
    levels, ends = _grown(nodes)
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.union(end)
    crown = _crown(cut_lineage(subroots))
    outer = _outer(levels, [crown.join(end.select("key"), "key", "left_semi") for end in ends])

    def finished(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, above = nodes.sort_values("pos"), outer.iloc[0]
        leaves = nodes["node"].tolist()
        levels = tree_levels(leaves, bool(above["whole"]))
        proofs, roots = [], []
        for i, seen in enumerate(nodes["seen"].tolist()):
            before, after = path_of(levels, i)
            before, after = [*before, *above["before"]], [*after, *above["after"]]
            proofs.append(proof(before, after))
            roots.append(fold(seen if isinstance(seen, str) else leaves[i], before, after))
        root = above["root"]
        return pd.DataFrame(
            {
                "id": nodes["id"],
                "leaf": leaves,
                "subroot": above["subroot"],
                "root": root,
                "proof": proofs,
                "folded_root": roots,
                "verified": [found == root for found in roots],
            }
        )

    kind = docs.select(column(id)).schema[0].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof {proof_type}, folded_root string, verified boolean"
    return _cogrouped(levels[0], outer, finished, schema).withColumnRenamed("id", id)
