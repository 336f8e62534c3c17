"""MinHash near-deduplication with a prefix filter on whole sets.

1. Every text becomes its set of word shingles, hashed to 64 bits.
2. Inverted lists propose pairs. Of each set the rarest values are listed, one more than a link may lack (a prefix filter). How often a value
   occurs is known only by bucket; any order that is the same for all documents is right, a good one makes the lists short. From the number
   of rarer values follows how large a partner may be whose first common value this is; rows whose list has no set that small leave it.
   Equal sets are listed once, as the smallest id.
3. Lists are kept apart by size class, and first each member is paired with one only, the one with the fewest rarer values.
   Verified pairs are united. Then each member of a list outside its largest component is paired with one of that component,
   another one in each list, and these are united. Last all other pairs of a list are tried whose ends are not yet connected, whose sizes
   allow a link and whose places in the order still leave room for enough overlap; those inside a list's largest component are never
   looked at. So a large group of near copies costs a few pairs a member and list, and no link between two components is missed.
   No pair is tried twice.
4. The smallest hashes of two sets' union estimate the similarity and drop pairs far below the threshold.
5. What remains is verified on the full sets made again from the texts.

Steps 2 and 3 lose nothing, whatever the size of the sets. Step 4 drops a pair at the threshold with a probability of about 2e-8 at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import LOWER, NOT_SPACE, freed, mixed, run_hashes, slices, text_bytes, word_hashes, words
from .components import components

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Values of the union that the estimate looks at, and the share of them that a pair needs to be verified: 6.2 standard deviations below.
ESTIMATE = 64
ESTIMATE_SHARE = 0.49
#: How often a value occurs is counted by bucket of its hash, about one for eight values. A task sends its counts in blocks of _BLOCK
#: buckets, a byte each; all counts come to the driver as one byte each, on a scale of eighths of an octave.
_LEAST_BUCKETS, _MOST_BUCKETS, _BLOCK = 1 << 16, 1 << 22, 1 << 12
#: Tasks whose blocks are added up first.
_TOGETHER = 256
#: Ids of sketches and texts to compare are told apart by so many buckets; those in no bucket aren't moved. This bounds the broadcast.
_TEXT_BUCKETS = 1 << 18


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``size`` words, or all words if there are fewer but not none."""
    data, offsets = text_bytes(column)
    for low, high in slices(offsets):
        part = offsets[low : high + 1]
        lower = LOWER[data[part[0] : part[-1]]]
        starts, ends, before = words(lower, part - part[0], NOT_SPACE)
        hashes = word_hashes(lower, starts, ends)
        runs = run_hashes(hashes, size)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= size:
                found = runs[a : b - size + 1].copy()
                found.sort()
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            else:
                yield mixed(run_hashes(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)


def _heads(size: int):
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, estimates = [], [], []
            for found in shingle_sets(batch.column(1), size):
                n.append(len(found))
                digests.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True))
                estimates.append((found[:ESTIMATE] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.int64()), _lists(estimates)], names=["id", "n", "digest", "estimate"]
            )

    return heads


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values & np.uint64(buckets - 1)).astype(np.int64)


def _frequency(size: int, buckets: int):
    """(block, task, counts): how many values of a task fall into each bucket of their hashes, 255 at most per row."""

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint32)
        for batch in batches:
            held, n = [], 0
            for found in [*shingle_sets(batch.column(0), size), None]:
                if found is not None:
                    held.append(found)
                    n += len(held[-1])
                if held and (found is None or n > 500_000):
                    at, often = np.unique(_bucket(np.concatenate(held), buckets), return_counts=True)
                    counts[at] += often.astype(np.uint32)
                    held, n = [], 0
        task = TaskContext.get().partitionId() % _TOGETHER
        while counts.any():  # more than 255 in a bucket are sent as several rows
            low = np.minimum(counts, 255)
            counts -= low
            blocks = low.astype(np.uint8).reshape(-1, _BLOCK)
            filled = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled), pa.array([task] * len(filled), pa.int64()), pa.array([blocks[i].tobytes() for i in filled], pa.binary())],
                names=["block", "task", "counts"],
            )

    return frequency


def _added(kind: type, scaled: bool = False):
    """The sum of the rows of one block, as unsigned 32-bit counts, or on the scale of eighths of an octave, a byte each."""

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.uint32)
        for content in rows.column("counts").to_pylist():
            total += np.frombuffer(content, kind)
        if scaled:
            total = np.round(8 * np.log2(1.0 + total)).clip(0, 255).astype(np.uint8)
        first = {name: rows.column(name).slice(0, 1).combine_chunks() for name in ("block", "task")}
        return pa.table({**first, "counts": pa.array([total.tobytes()], pa.binary())})

    return added


def _listing(size: int, percent: int, sent):
    """(value, digest, id, n, place): the values under which each document is listed, and how many of its set are rarer."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = sent.value, set()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            held = 0
            for id, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                if id is None or not len(found):
                    continue
                digest = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "big", signed=True)
                if digest in seen:  # a copy in the same task
                    continue
                seen.add(digest)
                n = len(found)
                need = max(1, -(-n * percent // 100))
                order = np.lexsort((found, often[_bucket(found, len(often))]))[: n - need + 1]
                same = lambda x, m=len(order): np.full(m, x, np.int64)
                parts.append([found[order].view(np.int64), same(digest), same(id), same(n), np.arange(len(order))])
                held += len(order)
                if held > 500_000:
                    yield _rows(parts)
                    parts, held = [], 0
            yield _rows(parts)

    return listing


def _rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts)]) for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["value", "digest", "id", "n", "place"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch has enough values in both."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False), strict=True):
            both = np.sort(np.concatenate((x, y)).view(np.uint32))
            twice = both[1:] == both[:-1]
            values = np.concatenate(([True], ~twice))
            # The k smallest values of the union, where both sketches reach.
            last = np.flatnonzero(values)[:ESTIMATE]
            inside = np.count_nonzero(twice[: last[-1] + 1]) if len(last) else 0
            keep.append(inside >= ESTIMATE_SHARE * len(last))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(size: int, percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return linked


class NearDuplicates:
    """Finds the components of near copies among rows of an integer id and a text.

    Null and empty texts have an empty set and link with nothing. Rows with the same id count as one document, which is
    linked if one of its texts is. Rows with a null id are left alone. An empty table gives an empty result.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = PERCENT):
        self.size, self.percent = size, percent
        self.texts = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        self.heads = cut_lineage(self.texts.mapInArrow(freed(_heads(size)), "id long, n long, digest long, estimate array<int>"))

    def _lists(self) -> DataFrame:
        """(value, id, n, place, reach): the inverted lists, equal sets once, and only rows that may have a partner in their list."""
        retained = self.heads.agg(F.sum("n")).first()[0] or 0
        buckets = min(_MOST_BUCKETS, max(_LEAST_BUCKETS, 1 << (retained // 8).bit_length()))
        schema = "block long, task long, counts binary"
        counted = self.texts.select("text").mapInArrow(freed(_frequency(self.size, buckets)), schema)
        some = counted.groupBy("block", "task").applyInArrow(_added(np.uint8), schema)
        every = some.groupBy("block").applyInArrow(_added(np.uint32, scaled=True), schema)
        often = np.zeros(buckets, np.uint8)
        for row in every.select("block", "counts").collect():  # one byte for each bucket
            often[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["counts"], np.uint8)
        sent = self.texts.sparkSession.sparkContext.broadcast(often)
        listed = self.texts.mapInArrow(freed(_listing(self.size, self.percent, sent)), "value long, digest long, id long, n long, place long")
        least = [F.min(name).alias(name) for name in ("id", "n", "place")]
        once = listed.repartition("value").groupBy("value", "digest").agg(*least)
        # Two sets at the threshold have percent / (100 + percent) of their sizes' sum in common, and at most what is left from the first common
        # value on. So ``reach`` is the largest size of a partner whose first common value this is.
        reach = F.floor((F.col("n") - F.col("place")) * (100 + self.percent) / F.lit(float(self.percent)) - F.col("n") + F.lit(1e-6))
        of_list = Window.partitionBy("value")
        near = once.withColumn("reach", reach.cast("long")).withColumn("smallest", F.min("n").over(of_list)).filter("reach >= smallest")
        return near.withColumn("sets", F.count("*").over(of_list)).filter("sets > 1").select("value", "id", "n", "place", "reach")

    @staticmethod
    def _named(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows whose ids share a bucket with those of the pairs; the others needn't be moved."""
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(_TEXT_BUCKETS)).cast("int")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        wanted = ids.select(bucket("id").alias("bucket")).distinct()  # at most _TEXT_BUCKETS rows, whatever the input
        return rows.join(F.broadcast(wanted), bucket("id") == F.col("bucket"), "left_semi")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the candidate pairs (a, b) that are links; the pairs are a written table."""
        heads = self._named(self.heads.select("id", "estimate"), pairs)
        likely = (
            pairs.join(heads.select(F.col("id").alias("a"), F.col("estimate").alias("x")), "a")
            .join(heads.select(F.col("id").alias("b"), F.col("estimate").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(freed(_likely), "a long, b long")
        )
        likely = cut_lineage(likely)
        some = self._named(self.texts, likely)
        return (
            likely.join(some.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
            .join(some.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(freed(_linked(self.size, self.percent)), "a long, b long")
        )

    def _open(self, lists: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        """The lists that are in several components, with each row's component and the one that most rows of its list are in."""
        known = lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).repartition("value")
        sizes = known.withColumn("m", F.count("*").over(Window.partitionBy(*keys, "component")))
        of_list = Window.partitionBy(*keys)
        parts = sizes.withColumn("top", F.max(F.struct("m", "component")).over(of_list)["component"])
        parts = parts.withColumn("parted", F.min("component").over(of_list) != F.max("component").over(of_list))
        return parts.filter("parted").drop("m", "parted")

    def classes(self) -> DataFrame:
        """(id, n, component), one row per row: the size of its set and the smallest id reachable over links."""
        lists = cut_lineage(self._lists())
        sets = self.heads.filter("n > 0").select("id", "digest")
        least = sets.groupBy("digest").agg(F.min("id").alias("a"))
        copies = sets.join(least, "digest").filter("id <> a").select("a", F.col("id").alias("b"))
        # Sizes of a link differ by at most the threshold, so they lie in one class or in two that follow each other.
        step = float(np.log(100 / self.percent))
        classed = lists.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
        # The member with the fewest rarer values is nearest to what the others have in common.
        of_list = Window.partitionBy("value", "class")
        nearest = F.min(F.struct("place", "id")).over(of_list)["id"]
        led = classed.repartition("value").withColumn("lead", nearest).filter("id <> lead")
        stars = led.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
        tried = cut_lineage(stars.union(copies).distinct())
        links = cut_lineage(self._verified(tried))
        # Once more from the components found so far: members outside a list's largest one meet one of its members.
        known = self._open(classed, components(links), ["value", "class"])
        some = F.min_by(F.when(F.col("component") == F.col("top"), F.col("id")), F.when(F.col("component") == F.col("top"), F.xxhash64("value", "id")))
        outside = known.withColumn("lead", some.over(of_list)).filter("component <> top")
        again = cut_lineage(outside.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).subtract(tried))
        links = cut_lineage(links.union(self._verified(again)))
        known = self._open(lists, components(links), ["value"])
        x, y = known.filter("component <> top").alias("x"), known.alias("y")
        low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        possible = (
            (F.col("x.value") == F.col("y.value"))
            & ((F.col("x.id") < F.col("y.id")) | (F.col("y.component") == F.col("y.top")))
            & (F.col("x.component") != F.col("y.component"))
            & (low * 100 >= high * self.percent)
            & (F.col("x.reach") >= F.col("y.n"))
            & (F.col("y.reach") >= F.col("x.n"))
        )
        more = x.join(y, possible).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        more = cut_lineage(more.subtract(tried.union(again)))
        found = components(links.union(self._verified(more)))
        return self.heads.select("id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component."""
    found = NearDuplicates(docs, id, text, size, percent).classes()
    dropped = found.filter("id <> component").select(F.col("id").alias(id)).distinct()
    return docs.join(dropped, id, "left_anti").select(docs.columns)
