"""Benchmark decontamination: which words of the documents lie inside n-grams of benchmark items.

The benchmark's n-grams are broadcast in blocks whose size is bounded: ``n_blocks`` follows from the measured bytes of
all items, and each block holds the items that hash to it. A usual benchmark is one block; a larger one takes further
passes over the documents, never a larger broadcast. The documents are not shuffled.

In a task, prefix polynomial hashes give the hash of every window of document words; a bitmap lets nearly all of them go,
and those that remain are compared word by word with the item's window.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ALNUM, LOWER, run_hashes, slices, text_bytes, word_hashes, words

#: Bytes of item texts in one broadcast. Its n-grams take about 12 times as much in a task.
BLOCK_BYTES = 8 << 20
_BITS = 20


class Windows:
    """The windows of some items: their hashes by length, and the items by the window's words."""

    def __init__(self, items: Iterable[tuple[str, str]], length: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        found: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
            if not len(starts):
                continue
            n = min(length, len(starts))
            hashes = run_hashes(word_hashes(data, starts, ends), n)
            found[n].update(hashes.tolist())
            parts = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            for i in range(len(hashes)):
                self.items[b" ".join(parts[i : i + n])].add(item)
        self.hashes = {n: np.sort(np.array(list(x), np.uint64)) for n, x in sorted(found.items())}
        self.bitmap = {}
        for n, x in self.hashes.items():
            self.bitmap[n] = np.zeros(1 << _BITS, bool)
            self.bitmap[n][x >> np.uint64(64 - _BITS)] = True

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """First word, number of words and items of each window that occurs inside one text."""
        hashes = word_hashes(data, starts, ends)
        for n, known in self.hashes.items():
            runs = run_hashes(hashes, n)
            at = np.flatnonzero(self.bitmap[n][runs >> np.uint64(64 - _BITS)])
            at = at[known[np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)] == runs[at]]
            last = before[np.searchsorted(before, at, "right")]  # where the text of the first word ends
            for i in at[at + n <= last].tolist():
                items = self.items.get(b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n], strict=True)))
                if items:
                    yield i, n, items


def _scan(windows: Windows, column: pa.Array, spans: list[list[int]], items: list[list[str]]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    data, offsets = text_bytes(column)
    n_words: list[int] = []
    out_spans, out_items = list(spans), list(items)
    for low, high in slices(offsets):
        part = offsets[low : high + 1]
        lower = LOWER[data[part[0] : part[-1]]]
        starts, ends, before = words(lower, part - part[0], ALNUM)
        n_words.extend(np.diff(before).tolist())
        inside = np.zeros(len(starts), bool)
        named: dict[int, set[str]] = defaultdict(set)
        for first, n, who in windows.hits(lower, starts, ends, before):
            inside[first : first + n] = True
            named[int(np.searchsorted(before, first, "right")) - 1] |= who
        for row, who in named.items():
            a, b = before[row], before[row + 1]
            old = spans[low + row]
            for i in range(0, len(old), 4):
                inside[a + old[i] : a + old[i + 1]] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[a:b].view(np.int8), [0]))))
            text_start = part[row] - part[0]
            out_spans[low + row] = [
                int(x) for i, j in zip(edge[::2], edge[1::2], strict=True) for x in (i, j, starts[a + i] - text_start, ends[a + j - 1] - text_start)
            ]
            out_items[low + row] = sorted(who.union(items[low + row]))
    return n_words, out_spans, out_items


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    length: int = 10,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text``, ``rest``, ``n_words``, ``spans``, ``items``.

    Words are runs of ASCII letters (case folded), digits and non-ASCII characters. A window is ``length`` consecutive
    words of an item, or the whole item if it has fewer words but not none. ``spans`` lists, for each maximal run of
    document words that lie inside occurrences of windows, four numbers: its first word, the word after its last, and the
    same as byte offsets into the UTF-8 text. ``items`` are the ids, as strings, of the items with an occurring window.
    ``rest`` is a struct of the other columns; without ``keep_text`` the text comes back as null. Null or empty texts, on either side, have no words; an empty benchmark
    hits nothing; rows that repeat are judged each; a null item id is named "null".
    """
    others = [name for name in docs.columns if name not in (id, text)]
    rest = F.struct(*[F.col(f"`{name}`") for name in others]) if others else F.lit(None).cast("string")
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    measured = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    n_blocks = max(1, math.ceil(measured / block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    context = docs.sparkSession.sparkContext
    found = docs.select(
        F.col(id).alias("id"),
        F.col(text).alias("text"),
        rest.alias("rest"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = found.schema
    for number in range(n_blocks):
        sent = context.broadcast([tuple(row) for row in bench.filter(block == number).select("item", "text").collect()])

        last = number == n_blocks - 1

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, drop=last and not keep_text) -> Iterator[pa.RecordBatch]:
            windows = Windows(sent.value, length)
            for batch in batches:
                columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                n_words, spans, items = _scan(windows, columns["text"], columns["spans"].to_pylist(), columns["items"].to_pylist())
                columns["n_words"] = pa.array(n_words, pa.int64())
                columns["spans"] = pa.array(spans, pa.list_(pa.int64()))
                columns["items"] = pa.array(items, pa.list_(pa.string()))
                if drop:
                    columns["text"] = pa.nulls(len(n_words), pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        found = found.mapInArrow(scan, schema)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with its columns in its order."""
    found = find_overlaps(docs, benchmark, id, text, **options).filter(F.size("spans") == 0)
    return found.select(
        *[F.col("id").alias(id) if name == id else F.col("text") if name == text else F.col(f"rest.`{name}`") for name in docs.columns]
    )


def without_spans(found: DataFrame) -> DataFrame:
    """``find_overlaps`` rows with the bytes of all spans cut out of ``text``; a null text stays null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts = columns["text"].to_pylist()
            for row, spans in enumerate(columns["spans"].to_pylist()):
                if spans:
                    raw, kept, at = texts[row].encode(), [], 0
                    for i in range(0, len(spans), 4):
                        kept.append(raw[at : spans[i + 2]])
                        at = spans[i + 3]
                    texts[row] = b"".join([*kept, raw[at:]]).decode()
            columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return found.mapInArrow(cut, found.schema)


def overlap_report(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts per document from ``find_overlaps`` rows."""
    quads = F.sequence(F.lit(0), (F.size("spans") / 4).cast("int") - 1)
    hit = F.when(
        F.size("spans") > 0, F.aggregate(quads, F.lit(0).cast("long"), lambda n, i: n + F.get("spans", i * 4 + 1) - F.get("spans", i * 4))
    ).otherwise(F.lit(0).cast("long"))
    return found.select(
        F.col("id").alias(id),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
