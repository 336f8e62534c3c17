"""Phrase collocations from sorted streams of exact counts.

1. Words are counted, then pairs of words that are frequent, then longer phrases whose shorter ones are. A phrase is
   at most as frequent as its parts, so nothing frequent is missed. Between the passes only bit arrays of bounded size
   are sent: a clear bit proves that a phrase is not frequent, a set one is decided by the counts themselves.
2. The frequent phrases of all lengths form one stream, range partitioned and sorted in prefix order: a phrase is followed by those
   that begin with it. One scan holds the current phrase's beginnings on a stack, which gives it their counts and them the largest
   count of a phrase one word longer.
3. The same rows, sorted by their words from the last one on (suffix order), give the counts of the ends in a second scan.

A partition may begin in the middle of a phrase's extensions. The few phrases on such borders, at most one per length and
partition, are looked up beforehand and sent. No counts are joined by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import rank_by_order
from ..session import cut_lineage, keep_placement
from .batches import mixed

MOST_WORDS = 5
LEAST = 100
TOP = 2000
#: A bit array has 2**LEAST_BITS to 2**MOST_BITS bits, about 32 for each frequent phrase in between.
LEAST_BITS = 16
MOST_BITS = 26
#: Texts are counted in slices of so many bytes; a longer text is a slice of its own.
_SLICE = 8 << 20
_BREAK = b"\n"
#: A-Z become small; the characters that end a piece become line feeds, and tabs become blanks.
_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)) + b".,;:!?\x0b\x0c\r\t", bytes(range(0x61, 0x7B)) + _BREAK * 9 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4096)
def _seed(part: str) -> int:
    return xxhash.xxh32_intdigest(part)


def _word_hash(part: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=_seed(part))


def _chained(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from those of their words."""
    out = mixed(hashes[0])
    for found in hashes[1:]:
        out = mixed(out * _STEP + found)
    return out


class Bits:
    """A set of hashes without false negatives."""

    def __init__(self, size: int, words: list[tuple[int, int]]):
        self.size = size
        self.bits = np.zeros(1 << max(0, size - 6), np.uint64)
        for place, value in words:
            self.bits[place] = value & 0xFFFFFFFFFFFFFFFF

    def of(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.size)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _bits_of(frequent: DataFrame) -> Bits:
    """The bits of a table (part, words). At most 2**MOST_BITS bits come to the driver, 64 a row."""
    n = frequent.count()
    size = min(MOST_BITS, max(LEAST_BITS, int(32 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.append(_chained([np.array([_word_hash(part, w.encode())], np.uint64) for w in words])[0])
            place = (np.array(found, np.uint64) >> np.uint64(64 - size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(place & 63)], names=["place", "bit"])

    found = frequent.select("part", "words").mapInArrow(places, "place long, bit long")
    rows = found.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("value")).collect()
    return Bits(size, [(r["place"], r["value"]) for r in rows])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    parts, texts, held = [], [], 0
    for i in range(0, batch.num_rows, 64):
        some = batch.slice(i, 64)
        for part, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
            if text:
                parts.append(part)
                texts.append(text)
                held += len(text)
                if held >= _SLICE:
                    yield parts, texts
                    parts, texts, held = [], [], 0
    if texts:
        yield parts, texts


def _numbered(parts: list[str], texts: list[bytes]) -> tuple[np.ndarray, list[tuple[str, bytes]]]:
    """The words of all texts as numbers, with -1 at the ends of pieces, and which (part, word) a number stands for."""
    numbers: dict[str, dict[bytes, int]] = {}
    names: list[tuple[str, bytes]] = []
    out = []
    for part, text in zip(parts, texts, strict=True):
        known = numbers.setdefault(part, {b"": -2, _BREAK: -1})
        tokens = text.translate(_TABLE).replace(_BREAK, b" \n ").split(b" ")
        new = set(tokens).difference(known)
        for word in new:
            known[word] = len(names)
            names.append((part, word))
        found = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        out += [found[found != -2], np.array([-1])]
    return np.concatenate(out), names


def _emitted(names: list[tuple[str, bytes]], phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(phrase, n): each phrase (a row of word numbers) as its part, a line feed, and its words joined by blanks."""
    words = pa.array([word for _, word in names], pa.binary()).cast(pa.string())
    parts = pa.array([part for part, _ in names], pa.string())
    columns = [words.take(pa.array(phrases[:, i])) for i in range(phrases.shape[1])]
    columns[0] = pc.binary_join_element_wise(parts.take(pa.array(phrases[:, 0])), columns[0], "\n")
    joined = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ")
    return pa.RecordBatch.from_arrays([joined, pa.array(counts, pa.int64())], names=["phrase", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every word in every slice; an empty phrase has those of all words."""
    for batch in batches:
        for parts, texts in _slices(batch):
            numbers, names = _numbered(parts, texts)
            counts = np.bincount(numbers[numbers >= 0], minlength=len(names))
            if not len(names):
                continue
            yield _emitted(names, np.arange(len(names))[:, None], counts)
            totals: dict[str, int] = {}
            for (part, _), n in zip(names, counts.tolist(), strict=True):
                totals[part] = totals.get(part, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}\n" for part in totals]), pa.array(totals.values(), pa.int64())], names=["phrase", "n"])


def _phrase_counts(lengths: list[int], sent_words, sent_shorter):
    """Occurrences in every slice of the phrases of these lengths whose words and whose parts of ``lengths[0] - 1`` words may be frequent."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, shorter = sent_words.value, sent_shorter.value if sent_shorter else None
        for batch in batches:
            for parts, texts in _slices(batch):
                numbers, names = _numbered(parts, texts)
                hashes = np.array([_word_hash(part, word) for part, word in names], np.uint64)
                usual = np.append(frequent.of(_chained([hashes])), False)
                begins = usual[numbers]  # where a phrase of n words begins, n being 1 here
                if shorter is not None:
                    for _ in range(lengths[0] - 2):
                        begins = begins[:-1] & begins[1:]
                    at = np.flatnonzero(begins)
                    found = _chained([hashes[numbers[at + i]] for i in range(lengths[0] - 1)])
                    begins[at] = shorter.of(found)
                for n in lengths:
                    begins = begins[:-1] & begins[1:]
                    at = np.flatnonzero(begins)
                    if not len(at):
                        break
                    yield _counted(names, numbers, at, n)

    return counts


def _counted(names: list[tuple[str, bytes]], numbers: np.ndarray, at: np.ndarray, n: int) -> pa.RecordBatch:
    """Exact counts of the phrases that begin at these places: a group of equal beginnings and the next word become a group."""
    group = numbers[at]
    for i in range(1, n):
        _, group = np.unique((group << 32) | numbers[at + i], return_inverse=True)
    _, first, counts = np.unique(group, return_index=True, return_counts=True)
    return _emitted(names, np.stack([numbers[at[first] + i] for i in range(n)], axis=1), counts)


def frequent_phrases(texts: DataFrame, longest: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """(part, words, a): every phrase of up to ``longest`` words that occurs at least ``least`` times in its part, with its count.

    ``texts`` has (part, text as binary). An empty list of words has the number of all words of the part.
    """
    send = texts.sparkSession.sparkContext.broadcast
    schema = "phrase string, n long"
    joined = F.substring_index("phrase", "\n", -1)  # words have no line feed, parts may
    part = F.substring("phrase", F.lit(1), F.length("phrase") - F.length(joined) - 1)
    words = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))

    def summed(counted: DataFrame) -> DataFrame:
        found = counted.groupBy("phrase").agg(F.sum("n").alias("a")).filter((F.col("a") >= least) | F.col("phrase").endswith("\n"))
        return cut_lineage(found.select(part.alias("part"), words.alias("words"), "a"))

    found = [summed(texts.mapInArrow(_word_counts, schema))]
    single = send(_bits_of(found[0].filter("size(words) > 0")))
    shorter = None
    for lengths in ([2], [3], list(range(4, longest + 1))):
        lengths = [n for n in lengths if n <= longest]
        if lengths:
            found.append(summed(texts.mapInArrow(_phrase_counts(lengths, single, shorter), schema)))
            shorter = send(_bits_of(found[-1])) if lengths[-1] < longest else None
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _stream(counts: DataFrame, key: Column) -> DataFrame:
    """The rows range partitioned and sorted by part and key; the partitions stay as they are, in order."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = counts.withColumn("key", key)
    return keep_placement(keyed.repartitionByRange(partitions, "part", "key").sortWithinPartitions("part", "key"))


def _borders(stream: DataFrame) -> dict[tuple[str, tuple[str, ...]], tuple[int, int]]:
    """Count and largest count of an extension of the beginnings of each partition's first phrase."""
    firsts = stream.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("part", "key")).alias("first")).collect()  # a row per partition
    wanted = sorted({(r["first"]["part"], tuple(r["first"]["key"][:n])) for r in firsts for n in range(len(r["first"]["key"]))})
    if not wanted:
        return {}
    border = F.broadcast(stream.sparkSession.createDataFrame([(part, list(key)) for part, key in wanted], "part string, key array<string>"))
    zero = F.lit(0).cast("long")
    longer = stream.filter("size(key) > 0").select("part", F.slice("key", F.lit(1), F.size("key") - 1).alias("key"), zero.alias("a"), F.col("a").alias("longer"))
    both = stream.select("part", "key", "a", zero.alias("longer")).union(longer)
    found = both.join(border, ["part", "key"]).groupBy("part", "key").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    return {(r["part"], tuple(r["key"])): (r["a"], r["longer"]) for r in found.collect()}


def _scan(sent, finish: Callable, schema: str):
    """Runs through a sorted partition with the beginnings of the current key on a stack.

    ``finish(part, words, a, heads, counts, longer)`` makes the row of each phrase; ``counts[i]`` is the count of its key's first i words, and
    ``longer`` the largest count of a phrase that has one word more at its key's end, or what the row brought if that is larger.
    """
    names = [column.split()[0] for column in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = sent.value
        # (part, key, count, largest extension, row or None for a phrase of an earlier partition)
        stack: list[list] = []
        out: list[tuple] = []
        started = False

        def close() -> None:
            part, key, a, longer, row = stack.pop()
            if row is not None:
                words, heads, counts, brought = row
                made = finish(part, words, a, heads, counts, max(longer, brought, borders.get((part, key), (0, 0))[1]))
                if made is not None:
                    out.append(made)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

        types = [_TYPES[column.split(" ", 1)[1]] for column in schema.split(", ")]
        for batch in batches:
            for part, words, a, heads, longer, key in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                key = tuple(key)
                if not started:
                    started = True
                    stack = [[part, key[:n], *borders[(part, key[:n])], None] for n in range(len(key))]
                while stack and not (stack[-1][0] == part and key[: len(stack[-1][1])] == stack[-1][1]):
                    close()
                if len(stack) != len(key):
                    raise ValueError(f"the stream lacks a beginning of {key}")
                if stack:
                    stack[-1][3] = max(stack[-1][3], a)
                stack.append([part, key, a, 0, (words, heads, [entry[2] for entry in stack], longer)])
            yield batch_of()
        while stack:
            close()
        yield batch_of()

    return scan


_TYPES = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _with_heads(part, words, a, heads, counts, longer):
    return part, words, a, counts, longer


def _scored(percent: int):
    """The cut with the lowest score of a phrase that isn't part of a longer one; numbers have any size here."""

    def scored(part, words, a, heads, tails, longer):
        m = len(words)
        if m < 2 or 100 * longer >= percent * a:
            return None
        total = heads[0]
        cuts = [(1000 * a * total // (heads[k] * tails[m - k]), k) for k in range(1, m)]
        score, k = min(cuts)
        return part, " ".join(words), a, heads[k], tails[m - k], total, score

    return scored


def mine_phrases(
    docs: DataFrame, text: str = "text", part: str = "lang", longest: int = MOST_WORDS, least: int = LEAST, percent: int = 100, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each part by score, count (both falling) and the phrase's bytes.

    Texts, with A-Z lower-cased, are cut at ``.,;:!?`` and at line breaks, and into words at blanks and tabs. A phrase has 2 to
    ``longest`` words of one piece and occurs ``a >= least`` times in its part. Its score is the least floor(1000 * a * n / (l * r)) over its cuts
    in two, n being all words of the part and l and r the counts of the halves; of equal cuts the first. Phrases inside
    a longer one with at least ``percent`` per cent of their count are left out.

    A null part is ``und`` (and one with that name). Null and empty texts have no words; a long text is counted whole; repeated rows count each time;
    other columns are not read. An empty table, or one without frequent phrases, gives an empty result.
    """
    column = lambda name: F.col(f"`{name}`")
    texts = docs.select(F.coalesce(column(part).cast("string"), F.lit("und")).alias("part"), column(text).cast("binary").alias("text"))
    counts = frequent_phrases(texts, longest, least).select("part", "words", "a", F.array().cast("array<long>").alias("heads"), F.lit(0).cast("long").alias("longer"))
    send = docs.sparkSession.sparkContext.broadcast
    forward = _stream(counts, F.col("words"))
    first = "part string, words array<string>, a long, heads array<long>, longer long"
    begun = cut_lineage(forward.mapInArrow(_scan(send(_borders(forward)), _with_heads, first), first))
    backward = _stream(begun, F.reverse("words"))
    last = "lang string, phrase string, a long, l long, r long, n long, score long"
    found = backward.mapInArrow(_scan(send(_borders(backward)), _scored(percent), last), last)
    ranked = rank_by_order(found, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], rank="rank")
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
