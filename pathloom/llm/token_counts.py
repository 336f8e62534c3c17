"""Edit-aware token counts: a segment tree per document, whose leaves are runs of pre-tokens.

A leaf ends where a character that is no white space is followed by a blank. There a pre-token ends whatever stands around
it (only its first character can be a blank), so the tokens of a text are the sum of its leaves' tokens, each encoded alone.
An edit touches the leaves it overlaps; neighbours join in until both ends of the region are such places again. Only that
region is encoded anew, and the sums on the way to the root are updated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters after which a leaf ends at the next possible place.
LEAF_CHARS = 512
#: Where the vocabulary lies on the driver; it is sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64 << 20
#: Fixed value: how the vocabulary's pre-tokens are cut.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LEAF = re.compile(rf"(?s).{{{LEAF_CHARS - 1}}}.*?\S(?= )|.+")


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tree:
    """Sums of characters and tokens over leaves; node i has the children 2 i and 2 i + 1, and the root is 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = 1 << max(0, (len(chars) - 1).bit_length())
        fill = [0] * (self.leaves - len(chars))
        self.chars = [0] * self.leaves + chars + fill
        self.tokens = [0] * self.leaves + tokens + fill
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def of(cls, text: str, count) -> Tree:
        parts = _LEAF.findall(text)
        return cls([len(x) for x in parts], [count(x) for x in parts])

    @classmethod
    def restored(cls, chars: list[int], tokens: list[int]) -> Tree:
        tree = cls.__new__(cls)
        tree.leaves, tree.chars, tree.tokens = len(chars) // 2, list(chars), list(tokens)
        return tree

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one with characters, if there is none behind), and where it starts."""
        at = min(at, self.chars[1] - 1)
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        chars, tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, text: str, start: int, end: int, new: str, count) -> tuple[str, int]:
        """The text with [start, end) replaced by ``new``, and how many characters were encoded anew."""
        edited = text[:start] + new + text[end:]
        if not text:
            self.put(0, len(edited), count(edited) if edited else 0)
            return edited, len(edited)
        first, low = self.find(start)
        last, at = self.find(max(start, end - 1))
        high = at + self.chars[self.leaves + last]
        grown = len(edited) - len(text)
        # [low, high) of the old text is [low, high + grown) of the new one.
        while low > 0 and not (low < high + grown and edited[low] == " "):
            first, low = self.find(low - 1)
        while high < len(text) and not (low < high + grown and edited[high + grown] == " " and not edited[high + grown - 1].isspace()):
            last, at = self.find(high)
            high = at + self.chars[self.leaves + last]
        while low > 0 and not (low < high + grown and edited[low] == " "):
            first, low = self.find(low - 1)
        region = edited[low : high + grown]
        for leaf in range(first + 1, last + 1):
            if self.chars[self.leaves + leaf]:
                self.put(leaf, 0, 0)
        self.put(first, len(region), count(region) if region else 0)
        return edited, len(region)


def _sent_vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        vocabulary = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(vocabulary) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(vocabulary)


def _with_rest(docs: DataFrame, *named: str) -> Column:
    others = [name for name in docs.columns if name not in named]
    return F.struct(*[F.col(f"`{name}`") for name in others]) if others else F.lit(None).cast("string")


def build_trees(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: id, text, ``rest`` (a struct of its other columns), ``n_tokens``, ``chars`` and ``tokens``.

    The last two are the nodes of the segment tree. A null or empty text has one empty leaf. Documents are not shuffled.
    """
    sent = _sent_vocabulary(docs, vocabulary)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), _with_rest(docs, id, text).alias("rest"))
    nodes = [F.lit(0).cast("long").alias("n_tokens"), *(F.array().cast("array<int>").alias(name) for name in ("chars", "tokens"))]
    schema = rows.select("*", *nodes).schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            trees = [Tree.of(x or "", lambda part: len(encode(part))) for x in batch.column(1).to_pylist()]
            added = [pa.array([t.tokens[1] for t in trees], pa.int64())]
            added += [pa.array([getattr(t, name) for t in trees], pa.list_(pa.int32())) for name in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return rows.mapInArrow(build, schema)


def apply_edits(trees: DataFrame, edits: str = "edits", vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``build_trees`` rows with a list of edits, after the edits: text, tree and ``n_tokens`` are the new ones.

    An edit is (start, end, new): the characters from ``start`` to before ``end`` of the text before all edits become ``new``.
    Edits are cut to the text. They may not overlap: of two that do, the one that starts later, ends later or else has the
    larger text is left out; null fields count as start 0, end = start, and no text. ``n_applied`` and ``n_encoded`` count edits applied and
    characters encoded anew. ``edits`` itself is dropped. Without ``keep_text`` the text comes back as null.
    """
    sent = _sent_vocabulary(trees, vocabulary)
    rows = trees.select("id", "text", "rest", "n_tokens", "chars", "tokens", F.col(edits).alias("edits"))
    schema = rows.drop("edits").select("*", F.lit(0).cast("long").alias("n_applied"), F.lit(0).cast("long").alias("n_encoded")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(sent.value).encode_ordinary
        count = lambda part: len(encode(part))
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts, found, done, encoded = columns["text"].to_pylist(), [], [], []
            for i, (chars, tokens, wanted) in enumerate(zip(*(columns[x].to_pylist() for x in ("chars", "tokens", "edits")), strict=True)):
                tree, text = Tree.restored(chars, tokens), texts[i] or ""
                legal, reached = [], 0
                spans = []
                for edit in wanted or []:
                    start = min(max(edit["start"] or 0, 0), len(text))
                    spans.append((start, min(max(start if edit["end"] is None else edit["end"], start), len(text)), edit["new"] or ""))
                for start, end, new in sorted(spans):
                    if start >= reached:
                        legal.append((start, end, new))
                        reached = max(end, start + 1)
                size = 0
                for start, end, new in reversed(legal):  # from the end, so that earlier positions hold
                    text, again = tree.edit(text, start, end, new, count)
                    size += again
                if legal:
                    texts[i] = text
                found.append(tree)
                done.append(len(legal))
                encoded.append(size)
            columns["text"] = pa.array(texts, pa.string()) if keep_text else pa.nulls(len(texts), pa.string())
            columns["n_tokens"] = pa.array([t.tokens[1] for t in found], pa.int64())
            for name in ("chars", "tokens"):
                columns[name] = pa.array([getattr(t, name) for t in found], pa.list_(pa.int32()))
            columns["n_applied"], columns["n_encoded"] = pa.array(done, pa.int64()), pa.array(encoded, pa.int64())
            yield pa.RecordBatch.from_arrays([columns[name] for name in schema.names], names=schema.names)

    return rows.mapInArrow(work, schema)


def with_edits(trees: DataFrame, edits: DataFrame, id: str = "doc_id") -> DataFrame:
    """``trees`` with the edits of a table (id, start, end, new), joined by id; rows without edits have none."""
    per_row = edits.groupBy(F.col(id).alias("_id")).agg(F.collect_list(F.struct("start", "end", "new")).alias("edits"))
    return trees.join(per_row, F.col("id") == F.col("_id"), "left").drop("_id")


def three_edits(id: Column, text: Column) -> Column:
    """Edits for a text that follow from its id: seven characters cut, a remark put in, a word break made a paragraph break."""
    size = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))
    at = lambda salt: F.pmod(F.xxhash64(id, F.lit(salt)), size.cast("long")).cast("int")
    edit = lambda start, n, new: F.struct(start.alias("start"), (start + n).alias("end"), F.lit(new).alias("new"))
    return F.array(edit(at(1), 7, ""), edit(at(2), 0, " (remark: see above)"), edit(at(3), 1, "\n\n"))
