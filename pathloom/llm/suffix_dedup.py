"""Removal of repeated byte strings with a sparse, hash-compared suffix sort.

A byte goes if a string of SPAN bytes around it also starts in a document with a smaller id. Suffixes are not sorted at
every byte: each window of SPAN bytes picks the smallest hash among its strings of GRAM bytes (its anchor), so equal windows
have the same anchor at the same place, and only anchors are compared, each with all windows that picked it.

1. The documents are dealt into batches once; all three passes over them read that one exchange.
2. First pass: 32-bit fingerprints of the anchors, by bucket. Anchors that can't occur in a second document are done.
3. Second pass: the other anchors send the bytes of their windows, by bucket of the anchor. There the suffixes from the anchor
   on, and those before it read backwards, are sorted by a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes. Neighbours are compared byte by byte afterwards; if that
   contradicts a hash, the suffixes are sorted by their bytes. Common extensions tell which windows are equal.
4. Third pass: what the buckets found is marked in the texts.

An anchor with more than HOT occurrences sends each of its windows alone, by bucket of the window, so that no bucket has to
take all of them. A batch sends equal strings once, and there are at most MOST_BATCHES of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import BASE, SLICE_BYTES, mixed, powers, prefix_hash, range_hash, slices, text_bytes

SPAN = 50
GRAM = 25
REACH = SPAN - GRAM + 1
HOT = 1 << 14
BATCH_BYTES = 2 << 20
MOST_BATCHES = 1 << 20
#: A text above this many bytes is worked on in pieces; each window lies in one piece.
PIECE_BYTES = 4 << 20
_CHUNK = 16_384
_LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Units:
    """Anchors, or single windows of them: positions in the batch's buffer, grouped by nothing yet."""

    anchor: np.ndarray
    first: np.ndarray  # start of the first and the last window
    last: np.ndarray
    gram: np.ndarray  # hash of the anchor's string

    def take(self, at: np.ndarray) -> Units:
        return Units(self.anchor[at], self.first[at], self.last[at], self.gram[at])


def _anchors(data: np.ndarray, offsets: np.ndarray) -> Units:
    """All anchors of some texts with the windows that picked them."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return Units(none, none, none, none.astype(np.uint64))
    grams = mixed(range_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), at := np.arange(len(data) - GRAM + 1), at + GRAM))
    least = (grams & ~_LOW) | at.astype(np.uint64)  # of equal ones the first
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    edge = np.zeros(len(data) + 1, np.int64)
    full = np.diff(offsets) >= SPAN
    edge[offsets[:-1][full]] += 1
    edge[offsets[1:][full] - SPAN + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge)[:-1])
    if not len(starts):
        return Units(none, none, none, none.astype(np.uint64))
    picked = (least[starts] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
    end = np.concatenate((new[1:], [len(starts)])) - 1
    return Units(picked[new], starts[new], starts[end], grams[picked[new]])


def anchors(data: np.ndarray, offsets: np.ndarray) -> Units:
    found = []
    for low, high in slices(offsets, SLICE_BYTES):
        base, end = int(offsets[low]), int(offsets[high])
        long = high - low == 1 and end - base > PIECE_BYTES
        step = PIECE_BYTES if long else max(1, end - base)
        for at in range(base, end, step):
            to = min(end, at + step + SPAN - 1)
            units = _anchors(data[at:to], np.array([0, to - at]) if long else offsets[low : high + 1] - base)
            found.append(Units(units.anchor + at, units.first + at, units.last + at, units.gram))
    join = lambda name: np.concatenate([np.zeros(0, np.uint64 if name == "gram" else np.int64), *(getattr(x, name) for x in found)])
    return Units(join("anchor"), join("first"), join("last"), join("gram"))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions start[i] .. start[i] + length[i] - 1, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _packed(values: np.ndarray) -> bytes:
    return len(values.tobytes()).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    if not packed:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True), kind)


class Batch:
    """The texts of one batch in the order of their ids, and their anchors."""

    def __init__(self, rows: pa.Table, buckets: int):
        rows = rows.combine_chunks()
        ids = rows.column("id").to_pylist()
        # A null id is above all others.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows.column("row")[i].as_py()))
        rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
        column = rows.column("text")
        self.rows = rows
        self.data, self.offsets = text_bytes(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        self.ids = np.array([np.iinfo(np.int64).max if ids[i] is None else ids[i] for i in order], np.int64)
        self.buckets = buckets
        self.units = anchors(self.data, self.offsets)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, fingerprint and number of occurrences (up to 255; 1 if in one document) of each distinct anchor string, and
        for each unit the index of its string."""
        grams, index, n = np.unique(self.units.gram, return_inverse=True, return_counts=True)
        ids = self.ids[self.text_of(self.units.anchor)]
        # Units come in the order of the ids, so a string is in one document if its first and last unit are.
        last = np.zeros(len(grams), np.int64)
        last[index] = ids
        first = np.zeros(len(grams), np.int64)
        first[index[::-1]] = ids[::-1]
        n = np.where(first != last, n, 1)
        bucket = ((grams >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((grams & _LOW, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return bucket[order], (grams[order] & _LOW).astype(np.uint32), np.minimum(n[order], 255).astype(np.uint8), rank[index]

    def shared(self, states: np.ndarray, string: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray]:
        """Units that may be repeated (hot ones cut into windows), and for each its bucket and its representative unit."""
        state = states[string]
        normal, hot = self.units.take(np.flatnonzero(state == 1)), self.units.take(np.flatnonzero(state == 2))
        each = hot.last - hot.first + 1
        window = _ranges(hot.first, each)
        units = Units(*(np.concatenate(x) for x in ((normal.anchor, np.repeat(hot.anchor, each)), (normal.first, window), (normal.last, window), (normal.gram, np.repeat(hot.gram, each)))))
        order = np.argsort(units.first, kind="stable")
        units = units.take(order)
        alone = (np.arange(len(order)) >= len(normal.first))[order]
        if not len(order):
            return units, np.zeros(0, np.int64), np.zeros(0, np.int64)
        content = np.zeros(len(order), np.uint64)
        for a in range(0, len(order), _CHUNK * 4):
            part = units.take(np.arange(a, min(len(order), a + _CHUNK * 4)))
            content[a : a + _CHUNK * 4] = self._hashes(part)
        _, rep, index = np.unique(content, return_index=True, return_inverse=True)
        rep = rep[index]
        # The same hash isn't enough: whoever differs from its representative stands for itself.
        size = units.last - units.first + SPAN
        twin = np.flatnonzero((rep != np.arange(len(rep))))
        equal = (size[twin] == size[rep[twin]]) & (units.anchor[twin] - units.first[twin] == units.anchor[rep[twin]] - units.first[rep[twin]])
        for k in range(int(size[twin].max()) if len(twin) else 0):
            at = np.flatnonzero(equal & (k < size[twin]))
            equal[at] = self.data[units.first[twin[at]] + k] == self.data[units.first[rep[twin[at]]] + k]
        rep[twin[~equal]] = twin[~equal]
        bucket = (np.where(alone, content, mixed(units.gram)) % np.uint64(self.buckets)).astype(np.int64)
        return units, bucket, rep

    def _hashes(self, units: Units) -> np.ndarray:
        """Of each unit's bytes and the anchor's place in them."""
        low, high = int(units.first.min()), int(units.last.max()) + SPAN
        if high - low > 8 * PIECE_BYTES:  # far apart: halves are near
            half = len(units.first) // 2
            if half:
                return np.concatenate([self._hashes(units.take(np.arange(half))), self._hashes(units.take(np.arange(half, len(units.first))))])
        prefix = prefix_hash(self.data[low:high].astype(np.uint64) + np.uint64(1))
        found = range_hash(prefix, units.first - low, units.last + SPAN - low)
        return mixed(found + (units.anchor - units.first).astype(np.uint64) * BASE)


class Suffixes:
    """Rows of bytes, sorted inside groups by a mergesort over prefix hashes. Rows end with zeros; bytes are counted from one."""

    def __init__(self, rows: np.ndarray, group: np.ndarray):
        self.rows = rows
        self.width = rows.shape[1]
        up, _ = powers(self.width + 1)
        self.hashes = np.zeros((len(rows), self.width + 1), np.uint64)
        np.cumsum(rows * up[: self.width], axis=1, dtype=np.uint64, out=self.hashes[:, 1:])
        self.order = self._sorted(group)
        # Byte by byte, so that a collision of hashes can't pass.
        self.common, right = self._neighbours(group)
        if not right:
            self.order = np.lexsort((*rows.T[::-1], group))
            self.common, _ = self._neighbours(group)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many leading bytes rows x and y have in common, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.width)
        for _ in range(int(self.width).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes[x, middle] == self.hashes[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether row x comes before row y; ``equal`` where they are the same."""
        common = self.extension(x, y)
        at = np.minimum(common, self.width - 1)
        return np.where(common == self.width, equal, self.rows[x, at] < self.rows[y, at])

    def _sorted(self, group: np.ndarray) -> np.ndarray:
        order = np.arange(len(group))
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else order
        size = np.diff(np.concatenate((begin, [len(group)])))
        begin, size = np.repeat(begin, size), np.repeat(size, size)
        width, most = 1, int(size.max()) if len(size) else 0
        while width < most:
            at = np.flatnonzero(size > width)
            inside = at - begin[at]
            run = inside // width
            low = begin[at] + (run ^ 1) * width
            high = np.minimum(low + width, begin[at] + size[at])
            low = np.minimum(low, high)
            start, right = low.copy(), (run & 1).astype(bool)
            busy = np.flatnonzero(low < high)
            while len(busy):
                middle = (low[busy] + high[busy]) >> 1
                # Of equal rows those of the left run come first.
                before = self.less(order[middle], order[at[busy]], right[busy])
                low[busy] = np.where(before, middle + 1, low[busy])
                high[busy] = np.where(before, high[busy], middle)
                busy = busy[low[busy] < high[busy]]
            place = begin[at] + (run & ~1) * width + (inside - run * width) + (low - start)
            merged = order.copy()
            merged[place] = order[at]
            order = merged
            width *= 2
        return order

    def _neighbours(self, group: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common bytes of each row in order with the one before it (-1 at the start of a group); whether the order is right."""
        common, right = np.full(len(self.order), -1, np.int64), True
        x, y = self.rows[self.order[:-1]], self.rows[self.order[1:]]
        if len(x):
            differs = x != y
            found = np.where(differs.any(axis=1), differs.argmax(axis=1), self.width)
            same = group[self.order[1:]] == group[self.order[:-1]]
            at = np.minimum(found, self.width - 1)
            line = np.arange(len(x))
            right = bool(np.all(~same | (found == self.width) | (x[line, at] < y[line, at])))
            common[1:] = np.where(same, found, -1)
        return common, right

    def classes(self, length: int) -> np.ndarray:
        """A number for each row; rows of a group with the same first ``length`` bytes have the same."""
        found = np.empty(len(self.order), np.int64)
        found[self.order] = np.cumsum(self.common < length)
        return found


def repeated_windows(data: np.ndarray, start: np.ndarray, most: np.ndarray, least: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each anchor the windows that also occur under a smaller id: bit i for the one that starts i bytes before it.

    An anchor's bytes begin at ``start``, ``most`` bytes before the anchor, and reach SPAN - ``least`` bytes behind it.
    """
    at = start + most
    grams = np.zeros(len(at), np.uint64)
    up, _ = powers(GRAM)
    for k in range(GRAM):
        grams += (data[at + k].astype(np.uint64) + np.uint64(1)) * up[k]
    by = np.argsort(grams, kind="stable")
    bounds = np.flatnonzero(np.concatenate(([True], grams[by][1:] != grams[by][:-1]))) if len(by) else np.zeros(0, np.int64)
    masks = np.zeros(len(at), np.uint32)
    low = 0
    while low < len(by):
        later = bounds[np.searchsorted(bounds, low + _CHUNK) :]
        high = int(later[0]) if len(later) else len(by)
        part = by[low:high]
        low = high
        group = grams[part]
        # Hashes brought them together; whoever has other bytes in the anchor differs in its class anyway.
        ahead = np.zeros((len(part), SPAN), np.uint16)
        for k in range(SPAN):
            here = np.flatnonzero(k < SPAN - least[part])
            ahead[here, k] = data[at[part[here]] + k].astype(np.uint16) + 1
        back = np.zeros((len(part), REACH - 1), np.uint16)
        for k in range(REACH - 1):
            here = np.flatnonzero(k < most[part])
            back[here, k] = data[at[part[here]] - 1 - k].astype(np.uint16) + 1
        forward, backward = Suffixes(ahead, group), Suffixes(back, group)
        for k in range(REACH):
            here = np.flatnonzero((least[part] <= k) & (k <= most[part]))
            if not len(here):
                continue
            key = forward.classes(SPAN - k)[here] * (len(part) + 1) + backward.classes(k)[here]
            order = np.lexsort((ids[part[here]], key))
            head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            smallest = ids[part[here[order[head]]]][np.cumsum(head) - 1]
            found = here[order[ids[part[here[order]]] > smallest]]
            masks[part[found]] |= np.uint32(1 << k)
    return masks


def _per_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), int(a), int(b)


_SENT = "bucket long, batch long, a binary, b binary, c binary"
_FOUND = "batch long, kind int, bucket long, found binary"
_SENT_TYPE = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_FOUND_TYPE = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("found", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict({name: [row[i] for row in rows] for i, name in enumerate(schema.names)}, schema=schema)


def _first_pass(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def send(rows: pa.Table) -> pa.Table:
        batch = Batch(rows, buckets)
        number = rows.column("batch")[0].as_py()
        bucket, prints, n, _ = batch.fingerprints()
        return _table([(k, number, prints[a:b].tobytes(), _packed(n[a:b]), None) for k, a, b in _per_bucket(bucket)], _SENT_TYPE)

    return send


def _count(rows: pa.Table) -> pa.Table:
    """Which fingerprints of a bucket are unique (0), shared (1) or hot (2), for each batch."""
    prints = [np.frombuffer(x.as_py(), np.uint32) for x in rows.column("a")]
    n = np.concatenate([_unpacked(x.as_py(), np.uint8) for x in rows.column("b")]).astype(np.int64)
    _, index = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(index, weights=n).astype(np.int64)
    state = ((total > 1).astype(np.uint8) + (total > HOT).astype(np.uint8))[index]
    ends = np.cumsum([len(x) for x in prints])
    out = [
        (batch.as_py(), 0, bucket.as_py(), _packed(state[b - len(x) : b]))
        for batch, bucket, x, b in zip(rows.column("batch"), rows.column("bucket"), prints, ends, strict=True)
    ]
    return _table(out, _FOUND_TYPE)


def _states(found: pa.Table, kind: int, dtype: type) -> np.ndarray:
    """What the buckets found for a batch, in the order of the buckets."""
    rows = sorted((x["bucket"], x["found"]) for x in found.to_pylist() if x["kind"] == kind)
    return np.concatenate([np.zeros(0, dtype), *(_unpacked(x, dtype) for _, x in rows)])


def _second_pass(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _SENT_TYPE)
        batch = Batch(rows, buckets)
        number = rows.column("batch")[0].as_py()
        units, bucket, rep = batch.shared(_states(found, 0, np.uint8), batch.fingerprints()[3])
        own = np.flatnonzero(rep == np.arange(len(rep)))
        own = own[np.argsort(bucket[own], kind="stable")]
        out = []
        for k, a, b in _per_bucket(bucket[own]):
            part = units.take(own[a:b])
            size = part.last - part.first + SPAN
            places = np.stack((part.anchor - part.first, part.anchor - part.last)).astype(np.uint8)
            out.append((k, number, _packed(batch.data[_ranges(part.first, size)]), _packed(places.ravel()), _packed(batch.ids[batch.text_of(part.anchor)])))
        return _table(out, _SENT_TYPE)

    return send


def _sort(rows: pa.Table) -> pa.Table:
    """The repeated windows among the anchors of a bucket, for each batch."""
    data = np.concatenate([_unpacked(x.as_py(), np.uint8) for x in rows.column("a")])
    places = [_unpacked(x.as_py(), np.uint8).astype(np.int64).reshape(2, -1) for x in rows.column("b")]
    ids = np.concatenate([_unpacked(x.as_py(), np.int64) for x in rows.column("c")])
    most, least = np.concatenate(places, axis=1)
    size = most - least + SPAN
    masks = repeated_windows(data, np.cumsum(size) - size, most, least, ids)
    ends = np.cumsum([x.shape[1] for x in places])
    out = [
        (batch.as_py(), 1, bucket.as_py(), _packed(masks[b - x.shape[1] : b]))
        for batch, bucket, x, b in zip(rows.column("batch"), rows.column("bucket"), places, ends, strict=True)
    ]
    return _table(out, _FOUND_TYPE)


_RESULT = "row long, id long, n_bytes long, spans array<long>, kept binary"
_RESULT_TYPE = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def _third_pass(buckets: int, finish: Callable[[bytes], bytes]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def mark(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _RESULT_TYPE)
        batch = Batch(rows, buckets)
        units, bucket, rep = batch.shared(_states(found, 0, np.uint8), batch.fingerprints()[3])
        own = np.flatnonzero(rep == np.arange(len(rep)))
        own = own[np.argsort(bucket[own], kind="stable")]
        masks = np.zeros(len(rep), np.uint32)
        masks[own] = _states(found, 1, np.uint32)
        ids = batch.ids[batch.text_of(units.anchor)]
        # Equal to a unit of a smaller id in the batch: all windows; of the same id: those of that unit.
        masks = np.where(ids > ids[rep], np.uint32(0xFFFFFFFF), masks[rep]) if len(rep) else masks
        edge = np.zeros(len(batch.data) + SPAN + 1, np.int32)
        for k in range(REACH):
            at = units.anchor - k
            at = at[(at >= units.first) & (at <= units.last) & ((masks >> np.uint32(k)) & np.uint32(1)).astype(bool)]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + SPAN, -1)
        gone = np.cumsum(edge)[: len(batch.data)] > 0
        out = []
        for i, (row, id) in enumerate(zip(batch.rows.column("row").to_pylist(), batch.rows.column("id").to_pylist(), strict=True)):
            a, b = int(batch.offsets[i]), int(batch.offsets[i + 1])
            inside = gone[a:b]
            spans = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
            out.append((row, id, b - a, spans.tolist(), finish(batch.data[a:b][~inside].tobytes())))
        return _table(out, _RESULT_TYPE)

    return mark


def as_text(kept: bytes) -> bytes:
    """Cuts may split a character; its remaining bytes are dropped from a text, which has to be valid."""
    return kept.decode("utf-8", "ignore").encode()


def as_digest(kept: bytes) -> bytes:
    return hashlib.sha256(kept).hexdigest().encode()


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", finish: Callable[[bytes], bytes] = as_text) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_bytes`` (UTF-8), ``n_removed``, ``n_spans``, ``spans``, ``kept``.

    ``spans`` lists start and end byte of each maximal removed run; ``kept`` is what ``finish`` makes of the bytes that
    stay, as text. A null text is empty. Strings are judged on the input. Rows with the same id repeat nothing of each
    other, nor do rows with a null id, which counts as above all others. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    batches = min(max(1, total // BATCH_BYTES), MOST_BATCHES)
    buckets = max(8, batches // 8)
    batch = F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(batches)).alias("batch")
    dealt = rows.select("id", "text", F.monotonically_increasing_id().alias("row"), batch).repartition("batch")
    prints = dealt.groupBy("batch").applyInArrow(_first_pass(buckets), _SENT)
    states = prints.groupBy("bucket").applyInArrow(_count, _FOUND)
    sent = dealt.groupBy("batch").cogroup(states.groupBy("batch")).applyInArrow(_second_pass(buckets), _SENT)
    masks = sent.groupBy("bucket").applyInArrow(_sort, _FOUND)
    found = states.union(masks)
    marked = dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_third_pass(buckets, finish), _RESULT)
    removed = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
                          lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")))
    return marked.select(
        F.col("id").alias(id),
        "n_bytes",
        removed["sum"].alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        "spans",
        F.decode("kept", "UTF-8").alias("kept"),
    )
