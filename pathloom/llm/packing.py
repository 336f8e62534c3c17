"""Packing documents into sequences of fixed length, by column generation for the cutting-stock problem.

1. Every text is tokenised once. Each full sequence of a long document stands for itself; what is left (the tail) has a length
   below the capacity. A row is ranked among the tails of its length: its place in its input partition, plus the
   tails of that length in earlier partitions.
2. The histogram of lengths, at most as many numbers as the capacity, goes to the driver. A linear program chooses how often each pattern
   (a multiset of length classes that fits a sequence) is used; a knapsack dynamic program over the duals prices new
   patterns until none improves. Numbers of uses are rounded down, then up where tails are left.
3. A pattern's uses take consecutive ranks of each class, which turns the plan into runs of sequences with the same exact lengths. A tail finds
   its sequence and offset from its length and rank alone.
4. Tails that rounding leaves over form a stream that is cut to fill the gaps of the runs, then whole sequences, and last ones of
   powers of two. Where they can't fill the gaps, the most wasteful uses are given up first.

The plan's size depends on the capacity, not on the number of documents, so it can be sent to all tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import freed

CAPACITY = 2048
END_ID = 1
#: Lengths up to EXACT are classes of their own, above it WIDTH lengths share one.
EXACT = 128
WIDTH = 16
#: Gaps below this stay padding; a piece of fewer ids than this isn't cut off to fill one.
LEAST_GAP = 8
#: Rounds of pricing at most; each may add many patterns. The bound only limits the driver's time, the plan stays valid.
MOST_ROUNDS = 300
#: Of the lower bound that the duals give, by how much the program's value may exceed it.
TOLERANCE = 2e-3
#: Words whose ids a task remembers.
_REMEMBERED = 900_000
#: Ids of full sequences start here, then the partition, then the place in it.
_FULL_BITS = 40


#: A word of small letters of ASCII and Latin-1, with at most one mark after it: the tokenizer takes the two apart and each as a whole.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]?)")


class Vocabulary:
    """Ids of texts as little-endian unsigned 32-bit bytes. Words between white space are encoded once and remembered."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for token, id in self.tokenizer.get_vocab().items():
            self.last[id] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {b"": b""}

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one unit each, from one text of them all: each ends with an id that ends a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        content, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [content[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The vocabulary drops white space and the case of A-Z and treats each word by itself, so a text's ids are those of its words."""
        known, split = self.known, [text.lower().split() for text in texts]
        new = set().union(*split).difference(known)
        marked, wanted, odd, apart = [], set(), [], _PLAIN.fullmatch
        for word in new:
            found = apart(word)
            if found is None:
                odd.append(word)
                continue
            stem, mark = found.groups()
            if mark:
                marked.append((word, stem, mark))
                wanted.add(mark)
            wanted.add(stem)
        stems = list(wanted.difference(known))
        for low in range(0, len(stems), 1024):
            known.update(zip(stems[low : low + 1024], self._plain(stems[low : low + 1024]), strict=True))
        for word, stem, mark in marked:
            known[word] = known[stem] + known[mark]
        known.update(zip(odd, self._each(odd), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        # The words met first stay, among them the frequent ones; later ones are forgotten at once when there is no more room.
        if len(known) > _REMEMBERED:
            for word in new.union(stems):
                del known[word]
        return out


@lru_cache(maxsize=1)
def _vocabulary(content: bytes) -> Vocabulary:
    """Read once per worker process, not per task."""
    return Vocabulary(content)


def as_bytes(ids: bytes) -> bytes:
    """A piece's ids as little-endian unsigned 32-bit numbers."""
    return bytes(ids)


def as_crc32(ids: bytes) -> int:
    """The CRC-32 of a piece's ids."""
    return zlib.crc32(ids)


def class_sizes(capacity: int, exact: int = EXACT, width: int = WIDTH) -> np.ndarray:
    """The largest length of each class, ascending."""
    return np.array([*range(1, min(exact, capacity) + 1), *range(exact + width, capacity, width)] + ([capacity] if capacity > exact else []), np.int64)


def best_patterns(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, list[np.ndarray]]:
    """Knapsack by dynamic programming: the best value of a pattern, and good patterns, at most one for each class that is in it."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(duals > 1e-12)
    small, worth = sizes[useful], duals[useful]
    fits = np.searchsorted(small, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        n = fits[room]
        value[room] = value[room - 1]
        if n:
            reached = value[room - small[:n]] + worth[:n]
            at = int(np.argmax(reached))
            if reached[at] > value[room] + 1e-12:
                value[room], taken[room] = reached[at], useful[at]

    def pattern(room: int, first: int | None = None) -> np.ndarray:
        counts = np.zeros(len(sizes), np.int64)
        if first is not None:
            counts[first] += 1
        while room > 0:
            if taken[room] < 0:
                room -= 1
            else:
                counts[taken[room]] += 1
                room -= sizes[taken[room]]
        return counts

    forced = value[capacity - sizes] + duals
    chosen, seen = [], set()
    for k in [None, *np.argsort(-forced, kind="stable").tolist()]:
        if k is not None and (forced[k] <= 1 + 1e-7 or len(chosen) >= 200):
            break
        found = pattern(capacity) if k is None else pattern(capacity - int(sizes[k]), k)
        if found.tobytes() not in seen:
            seen.add(found.tobytes())
            chosen.append(found)
    return float(value[capacity]), chosen


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The product in this thread alone: a driver's many threads and those of a linear algebra library slow each other down."""
    return np.einsum("ij,j->i", matrix, vector)


def _refined(inverse: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A step of Newton's iteration, which squares the error of a nearly right inverse."""
    return 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", matrix, inverse))


def solve_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often the linear program uses each, so that every class is used ``counts`` times.

    Revised simplex on the patterns known so far, with the inverse of the basis; patterns that the duals price above 1 are added.
    """
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    fit = capacity // sizes
    pool = [np.eye(m, dtype=np.int64)[k] * fit[k] for k in range(m)]
    matrix = np.array(pool, float)
    basis, inverse = np.arange(m), np.diag(1.0 / fit)
    uses = counts / fit
    for _ in range(MOST_ROUNDS):
        for step in range(20 * m):
            duals = inverse.sum(axis=0)
            gain = _times(matrix, duals)
            gain[basis] = -np.inf
            enter = int(np.argmax(gain))
            if gain[enter] <= 1 + 1e-9:
                break
            column = _times(inverse, matrix[enter])
            up = column > 1e-9
            if not up.any():
                break
            ratio = np.full(m, np.inf)
            ratio[up] = uses[up] / column[up]
            leave = int(np.argmin(ratio))
            uses = np.maximum(uses - ratio[leave] * column, 0)
            uses[leave] = ratio[leave]
            row = inverse[leave] / column[leave]
            inverse -= np.outer(column, row)
            inverse[leave] = row
            basis[leave] = enter
            if step % 200 == 199:
                inverse = _refined(inverse, matrix[basis].T)
        inverse = _refined(inverse, matrix[basis].T)
        uses, duals = np.maximum(_times(inverse, counts), 0), inverse.sum(axis=0)
        best, found = best_patterns(sizes, duals, capacity)
        # The duals divided by the best value are feasible, which bounds the program's value from below.
        if best <= 1 + TOLERANCE:
            break
        matrix = np.concatenate([matrix, np.array(found, float)])
        pool.extend(found)
    return np.array([pool[i] for i in basis]), uses


def rounded(patterns: np.ndarray, uses: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole numbers of uses that take no class more often than it occurs: rounded down, then one more by falling remainder."""
    whole = np.floor(uses + 1e-7).astype(np.int64)
    for i in np.argsort(uses - whole, kind="stable"):
        while whole[i] and (whole @ patterns > counts).any() and (patterns[i] * (whole @ patterns > counts)).any():
            whole[i] -= 1
    left = counts - whole @ patterns
    for i in np.argsort(whole - uses, kind="stable"):
        if (patterns[i] <= left).all() and patterns[i].any():
            whole[i] += 1
            left = left - patterns[i]
    return whole


class Plan:
    """Where a tail goes, by its length and its rank among the tails of that length.

    ``lengths`` and ``counts`` are the histogram; sequences are numbered from 0.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY):
        self.capacity = capacity
        order = np.argsort(lengths, kind="stable")
        self.lengths, self.counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
        every = class_sizes(capacity)
        of = np.searchsorted(every, self.lengths)
        present = np.unique(of)
        sizes = every[present]
        self.first_class = np.searchsorted(present, of)
        totals = np.bincount(self.first_class, self.counts, len(present)).astype(np.int64) if len(present) else np.zeros(0, np.int64)
        patterns, uses = solve_patterns(sizes, totals, capacity)
        whole = rounded(patterns, uses, totals) if len(uses) else np.zeros(0, np.int64)
        while True:
            gap = self._lay(patterns, whole)
            missing = self.gap_ids - self.stock_ids
            if missing <= 0 or not gap.any():
                break
            worst = int(np.argmax(gap))
            whole[worst] -= min(whole[worst], -(-missing // capacity))
        self._fill()

    def _lay(self, patterns: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Gives each use its ranks, and splits uses into runs in which every slot has one exact length; the mean gap of each pattern."""
        # Ranks within a class go by length, then by rank among the tails of that length.
        ends = np.zeros(len(self.lengths), np.int64)
        starts = np.zeros(len(self.lengths), np.int64)
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(self.first_class):
            own = np.flatnonzero(self.first_class == k)
            ends[own] = np.cumsum(self.counts[own])
            starts[own] = ends[own] - self.counts[own]
            bounds[int(k)] = (ends[own], own)
        used = np.zeros(len(bounds), np.int64)
        slots: list[tuple[int, int, int, int]] = []
        gaps: list[tuple[int, int, int, int]] = []
        sequence, mean = 0, np.zeros(len(whole))
        for which, (pattern, n) in enumerate(zip(patterns, whole.tolist(), strict=True)):
            if not n:
                continue
            taken = []
            for k in np.flatnonzero(pattern).tolist():
                for _ in range(int(pattern[k])):
                    taken.append((k, int(used[k])))
                    used[k] += n
            cuts = {0, n}
            for k, low in taken:
                inside = bounds[k][0] - low
                cuts.update(inside[(inside > 0) & (inside < n)].tolist())
            cuts = sorted(cuts)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                offset = 0
                for k, low in taken:
                    at = int(bounds[k][1][np.searchsorted(bounds[k][0], low + a, "right")])
                    slots.append((at, low + a - int(starts[at]), sequence + a, offset))
                    offset += int(self.lengths[at])
                if self.capacity - offset >= LEAST_GAP:
                    gaps.append((self.capacity - offset, b - a, sequence + a, offset))
                    mean[which] += (self.capacity - offset) * (b - a) / n
            sequence += n
        self.sequences = sequence
        table = np.array(sorted(slots), np.int64).reshape(-1, 4)
        self.slot_key = (table[:, 0] << 40) | table[:, 1]
        self.slot_rank, self.slot_sequence, self.slot_offset = table[:, 1], table[:, 2], table[:, 3]
        #: Of each length, the rank from which its tails are left over.
        self.left_from = np.clip(used[self.first_class] - starts, 0, self.counts) if len(self.lengths) else starts
        self.gaps = sorted(gaps, reverse=True)
        self.gap_ids = sum(size * n for size, n, _, _ in gaps)
        self.stock_ids = int(((self.counts - self.left_from) * self.lengths).sum())
        return mean

    def _fill(self) -> None:
        """The places that the stream of left-over tails runs through: gaps, whole sequences, powers of two."""
        rest, places = self.stock_ids, list(self.gaps)
        rest -= min(rest, self.gap_ids)
        if rest >= self.capacity:
            places.append((self.capacity, rest // self.capacity, self.sequences, 0))
            self.sequences += rest // self.capacity
            rest %= self.capacity
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                places.append((1 << bit, 1, self.sequences, 0))
                self.sequences += 1
        table = np.array(places, np.int64).reshape(-1, 4)
        self.place_size, self.place_sequence, self.place_offset = table[:, 0], table[:, 2], table[:, 3]
        self.place_start = np.concatenate(([0], np.cumsum(table[:, 0] * table[:, 1])))
        # Long tails come first, so that they meet the large gaps.
        sizes = (self.counts - self.left_from) * self.lengths
        self.stock_start = sizes.sum() - np.cumsum(sizes)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of each piece of a tail."""
        at = int(np.searchsorted(self.lengths, length))
        if rank < self.left_from[at]:
            slot = int(np.searchsorted(self.slot_key, (at << 40) | rank, "right")) - 1
            return [(0, length, int(self.slot_sequence[slot] + rank - self.slot_rank[slot]), int(self.slot_offset[slot]))]
        place, start, out = int(self.stock_start[at] + (rank - self.left_from[at]) * length), 0, []
        while start < length:
            group = int(np.searchsorted(self.place_start, place, "right")) - 1
            size = int(self.place_size[group])
            nth, inside = divmod(place - int(self.place_start[group]), size)
            part = min(size - inside, length - start)
            out.append((start, part, int(self.place_sequence[group]) + nth, int(self.place_offset[group]) + inside))
            start += part
            place += part
        return out


def _sent(docs: DataFrame, path: str):
    from .token_counts import MOST_VOCABULARY_BYTES

    with open(path, "rb") as file:
        content = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(content)


def _tokenised(docs: DataFrame, vocabulary, capacity: int, end_id: int, finish: Callable[[bytes], object], schema):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(vocabulary.value)
        part = TaskContext.get().partitionId()
        ranks = [0] * capacity
        full = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                rows: list[list] = [[] for _ in range(7)]
                for ids in words.encode([x or b"" for x in some.column(1).to_pylist()]):
                    ids += end
                    n = len(ids) // 4
                    cut = n // capacity * capacity * 4
                    tail = n % capacity
                    values = [finish(ids[i : i + capacity * 4]) for i in range(0, cut, capacity * 4)]
                    for column, value in zip(rows, (n, part, tail, ranks[tail], full, values, ids[cut:]), strict=True):
                        column.append(value)
                    ranks[tail] += 1
                    full += len(values)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, t) for x, t in zip(rows, schema[1:], strict=True))], names=_COLUMNS)

    return run


_COLUMNS = ["id", "n", "part", "tail", "place", "full", "whole", "ids"]


def pack_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    finish: Callable[[bytes], object] = as_bytes,
    finish_type: str = "binary",
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (of a piece, as ``finish`` gives them), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its text and then ``end_id``; a null or empty text is that id alone, so every row has a piece. The pieces
    of a row cover its ids once; those of a sequence follow each other from offset 0 and hold at most ``capacity`` ids.
    Rows with the same id, or a null one, are documents of their own; other columns are left out. An empty table gives an empty result. ``vocabulary`` is a
    file of the ``tokenizers`` library that drops white space, as in ``word_bpe_49k.json``; its own special tokens in a text are read as such.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    sent = _sent(docs, vocabulary)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = f"id {kind}, n long, part int, tail int, place long, full long, whole array<{finish_type}>, ids binary"
    types = [to_arrow_type(f.dataType) for f in docs.sparkSession.createDataFrame([], made).schema.fields]
    table = cut_lineage(rows.mapInArrow(freed(_tokenised(docs, sent, capacity, end_id, finish, types)), made))
    # Tails of a length in earlier partitions; (part, tail) has at most capacity rows per partition.
    sizes = table.groupBy("part", "tail").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("part", "tail", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")))
    histogram = starts.filter("tail > 0").groupBy("tail").agg(F.sum("rows").alias("rows")).orderBy("tail").collect()  # fewer rows than the capacity
    plan = Plan(np.array([r["tail"] for r in histogram], np.int64), np.array([r["rows"] for r in histogram], np.int64), capacity)
    planned = docs.sparkSession.sparkContext.broadcast(plan)
    ranked = table.join(starts.drop("rows").hint("merge"), ["part", "tail"]).select(
        "id", "n", "part", "tail", (F.col("place") + F.col("before")).alias("rank"), "full", "whole", "ids"
    )
    schema = f"id {kind}, start long, length long, ids {finish_type}, doc_tokens long, sequence_id long, offset long"
    out_types = [to_arrow_type(f.dataType) for f in docs.sparkSession.createDataFrame([], schema).schema.fields]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = planned.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                some = batch.slice(low, 2048)
                source, rows = [], [[] for _ in range(6)]
                columns = [some.column(i).to_pylist() for i in range(1, 8)]
                for i, (n, part, tail, rank, full, whole, ids) in enumerate(zip(*columns, strict=True)):
                    first = ((part + 1) << _FULL_BITS) + full
                    found = [(j * capacity, capacity, value, first + j, 0) for j, value in enumerate(whole)]
                    done = len(whole) * capacity
                    if tail:
                        for start, length, sequence, offset in plan.pieces(tail, rank):
                            found.append((done + start, length, finish(ids[start * 4 : (start + length) * 4]), sequence, offset))
                    for start, length, value, sequence, offset in found:
                        source.append(i)
                        for column, x in zip(rows, (start, length, value, n, sequence, offset), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, t) for x, t in zip(rows, out_types[1:], strict=True))],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return ranked.mapInArrow(freed(placed), schema).withColumnRenamed("id", id)
