"""Toxicity by weak supervision: many voters, a generative model of them, and a linear classifier on its posterior labels.

1. Words and word beginnings that are typical of toxic texts are counted over all labelled training rows.
2. Voters: the most typical ones, public lexicons of insults in four languages, and patterns of style. A voter fires or
   abstains on a text.
3. Label model: how often each voter fires on toxic and on other texts is estimated by expectation-maximisation over the
   votes on all documents; all training labels only give the start. Voters that fire together on toxic texts beyond chance share
   their weight.
4. The classifier is fitted on a bounded sample, to the posterior of the votes and of the row's own label, which counts as one
   more voter of limited accuracy. Its features are the typical words and beginnings, the lexicons and the patterns. A typical
   feature that is rare in the sample gets its weight from its log odds over all training rows. The bias is set so that
   THRESHOLD is the best cut on all training rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import freed, release

#: Labelled rows that the weights are fitted on, at most: those with the smallest hashes. Nothing else is sampled.
SAMPLE_ROWS = 20_000
#: Names that a task counts before it passes them on.
MOST_COUNTED = 200_000
#: Logits are counted in bins of this width, up to LAST_BIN on both sides.
BIN = 1 / 1024
LAST_BIN = 1 << 18
MOST_FEATURES = 4096
MOST_VOTERS = 48
LEAST_DOCUMENTS = 5
ROUNDS = 6
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
#: Lengths of word beginnings in characters, the shortest first.
BEGINNINGS = (3, 4, 5, 6)
#: Common insults by language.
LEXICONS: dict[str, tuple[str, ...]] = {
    "en": ("asshole", "bastard", "clown", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"),
    "de": ("abschaum", "arschloch", "blödmann", "depp", "dumm", "dummkopf", "erbärmlich", "idiot", "müll", "trottel", "versager", "wertlos", "widerlich"),
    "fr": ("abruti", "bouffon", "connard", "crétin", "dégoûtant", "idiot", "imbécile", "minable", "ordure", "pathétique", "raclure", "stupide"),
    "es": ("asqueroso", "basura", "escoria", "estúpido", "idiota", "imbécil", "inútil", "patético", "payaso", "perdedor", "tonto"),
}
#: Each with a simpler pattern that has to occur first.
PATTERNS: dict[str, tuple[str, str]] = {
    "masked word": ("[*@#$%]{2}", r"\b[A-Za-z][*@#$%]{2,}[A-Za-z]*\b"),
    "shouting": ("[A-Z]{4}", r"\b[A-Z]{4,}(?:[ ,]+[A-Z]{4,}){2,}\b"),
    "outcry": ("[!?]{3}", r"!!!|!\?!|\?!\?"),
}
_WORD = re.compile(r"[^\W\d_]+")
_FIXED = [f"lexicon {name}" for name in LEXICONS] + [f"pattern {name}" for name in PATTERNS]


def words_of(text: str) -> set[str]:
    """The distinct runs of letters of a lower-cased text."""
    tokens = set(text.lower().split())
    plain = {token for token in tokens if token.isalpha()}
    return plain.union(*map(_WORD.findall, tokens - plain))


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


class Features:
    """Which of a list of features occur in a text. The fixed lexicons and patterns come first."""

    def __init__(self, typical: list[str]):
        self.names = _FIXED + typical
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, lexicon in enumerate(LEXICONS.values()):
            for word in lexicon:
                self.index[word].append(i)
        for i, name in enumerate(typical, len(_FIXED)):
            self.index[name].append(i)
        self.index = dict(self.index)
        # Whatever starts otherwise has none of the features.
        self.starts = {name.rstrip("*")[: BEGINNINGS[0]] for name in self.index}
        self.patterns = [(i, re.compile(first), re.compile(p)) for i, (first, p) in enumerate(PATTERNS.values(), len(LEXICONS))]
        self.cache: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        found: set[int] = set()
        starts, least = self.starts, BEGINNINGS[0]
        for word in {word for word in words_of(text) if word[:least] in starts}:
            known = self.cache.get(word)
            if known is None:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                known = self.cache[word] = tuple(i for f in features_of(word) for i in self.index.get(f, ()))
            found.update(known)
        found.update(i for i, first, pattern in self.patterns if first.search(text) and pattern.search(text))
        return sorted(found)


#: Ids of labelled rows are told apart by so many buckets, which bounds the broadcast.
_ID_BUCKETS = 1 << 19


@dataclass
class Model:
    typical: list[str]
    weights: np.ndarray
    bias: float
    #: Of the label model: voters, how often they fire on toxic and on other texts, and their share of weight.
    voters: list[int] = field(default_factory=list)
    rates: np.ndarray | None = None
    shares: np.ndarray | None = None

    def score(self, text: Column) -> Column:
        """Between 0 and 1, from the text alone; a null counts as empty."""
        typical, weights, bias = self.typical, self.weights, self.bias

        def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features = Features(typical)
            try:
                for part in parts:
                    sums = np.array([bias + weights[features.of(x)].sum() for x in part], float)
                    yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))
            finally:
                del features
                release()

        scores.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(scores, "double")(text)


def is_training(id: Column) -> Column:
    """Labels of other rows are held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(hash, text, y): all labelled training rows."""
    known = labels.filter(is_training(F.col(id)) & F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    known = cut_lineage(known)
    rows = docs.filter(is_training(F.col(id))).select(F.col(id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Texts in no bucket of a labelled id stay where they are; the rest meet their labels by one kind of join at every size.
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(_ID_BUCKETS)).cast("int")
    wanted = known.select(bucket("id").alias("bucket")).distinct()
    rows = rows.join(F.broadcast(wanted), bucket("doc") == F.col("bucket"), "left_semi")
    joined = rows.join(known.hint("merge"), F.col("doc") == F.col("id"))
    return cut_lineage(joined.select(F.xxhash64("doc", "text").alias("hash"), "text", "y"))


def _typical(labelled: DataFrame, toxic: int, other: int) -> list[tuple[str, float, int]]:
    """Features with their log odds and number of toxic texts, the most telling first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), *(pa.array([x[y] for x in counts.values()], pa.int64()) for y in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["name", "other", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name in {f for word in words_of(text) for f in features_of(word)}:
                    if name in counts:
                        counts[name][y] += 1
                    else:
                        counts[name] = [1 - y, y]
                if len(counts) > MOST_COUNTED:
                    yield batch_of()
                    counts.clear()
        yield batch_of()

    counted = labelled.select("text", "y").mapInArrow(freed(emit), "name string, other long, toxic long").groupBy("name").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    best = counted.filter(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", F.round(odds, 6)).filter("odds > 1.5")
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "name").limit(MOST_FEATURES)
    return [(row["name"], row["odds"], row["toxic"]) for row in best.select("name", "odds", "toxic").collect()]


def _voters(typical: list[tuple[str, float, int]]) -> list[int]:
    """Feature numbers of the voters. Of a word and its beginnings one votes."""
    chosen: list[str] = []
    voters = list(range(len(_FIXED)))
    for least in (4.0, 2.0):
        for i, (name, odds, _) in enumerate(typical, len(_FIXED)):
            stem = name.rstrip("*")
            if odds >= least and len(chosen) < MOST_VOTERS and i not in voters and not any(stem.startswith(x) or x.startswith(stem) for x in chosen):
                chosen.append(stem)
                voters.append(i)
        if len(chosen) >= 8:
            break
    return voters


def _votes(docs: DataFrame, text: str, typical: list[str], voters: list[int]) -> DataFrame:
    """(votes, n): how many documents have which votes, as bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(typical)
        bit = {feature: 1 << i for i, feature in enumerate(voters)}
        for batch in batches:
            counts: dict[int, int] = defaultdict(int)
            for value in batch.column(0).to_pylist():
                counts[sum(bit.get(i, 0) for i in features.of(value))] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    found = docs.select(F.col(text)).mapInArrow(freed(emit), "votes long, n long")
    return cut_lineage(found.groupBy("votes").agg(F.sum("n").alias("n")))


def _fired(labelled: DataFrame, typical: list[str], voters: list[int]) -> DataFrame:
    """(hash, y, fired, votes): the features of each labelled row, and its votes as bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(typical)
        bit = {feature: 1 << i for i, feature in enumerate(voters)}
        for batch in batches:
            fired = [features.of(x) for x in batch.column(2).to_pylist()]
            votes = [sum(bit.get(i, 0) for i in x) for x in fired]
            columns = [batch.column(0), batch.column(1), pa.array(fired, pa.list_(pa.int32())), pa.array(votes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "y", "fired", "votes"])

    return cut_lineage(labelled.select("hash", "y", "text").mapInArrow(freed(emit), "hash long, y int, fired array<int>, votes long"))


def _bits(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n)) & 1).astype(float)


def _posterior(bits: np.ndarray, prior: float, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """That a text is toxic. Voters that abstain say nothing."""
    logit = np.log(prior / (1 - prior)) + bits @ (shares * np.log(rates[1] / rates[0]))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _expected(votes: DataFrame, width: int, estimate: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all documents, by class: votes of each pair of voters (of a voter with itself: its votes), and all documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width * width + 1))
        for batch in batches:
            bits, n = _bits(batch.column(0).to_numpy(), width), batch.column(1).to_numpy().astype(float)
            toxic = estimate(bits)
            for y, weight in enumerate((n * (1 - toxic), n * toxic)):
                sums[y, :-1] += ((bits * weight[:, None]).T @ bits).ravel()
                sums[y, -1] += weight.sum()
        at = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums.ravel()[at])], names=["at", "sum"])

    found = np.zeros(2 * (width * width + 1))
    rows = votes.mapInArrow(freed(emit), "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum"))
    for row in rows.collect():  # at most as many rows as ``found`` has places
        found[row["at"]] = round(row["sum"], 6)
    return found.reshape(2, -1)


def _label_model(votes: DataFrame, width: int, prior: float, rates: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    shares = np.ones(width)
    for _ in range(ROUNDS):
        sums = _expected(votes, width, lambda bits, p=prior, r=rates, s=shares: _posterior(bits, p, r, s))
        total, pairs = sums[:, -1], sums[:, :-1].reshape(2, width, width)
        prior = float(np.clip(total[1] / max(total.sum(), 1), 1e-4, 0.5))
        fired = np.stack([np.diag(x) for x in pairs])
        rates = (fired + 0.5) / (total[:, None] + 1)
        spread = np.sqrt(rates[1] * (1 - rates[1]))
        correlation = (pairs[1] / (total[1] + 1) - np.outer(rates[1], rates[1])) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        shares = 1 / (1 + np.clip(correlation, 0, 1).sum(axis=1))
    return prior, rates, shares


def _fit(rows: list[list[int]], target: np.ndarray, n: int, penalty: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over binary features, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column = np.array([i for x in rows for i in x], int)
    often = np.bincount(column, minlength=n)
    scale = 1 / np.sqrt(np.maximum(often, 1))  # rare features move as far as frequent ones
    step = 4.0 / (max((len(x) for x in rows), default=0) + 1)
    w, b = np.zeros(n), float(np.log(max(target.mean(), 1e-4) / max(1 - target.mean(), 1e-4)))
    v, vb = w.copy(), b
    for k in range(1, steps + 1):
        logit = vb + np.bincount(row, (v * scale)[column], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        slope = np.bincount(column, off[row], minlength=n) * scale + penalty * v
        nw, nb = v - step * slope, vb - 4.0 * off.mean()
        v, vb = nw + (k - 1) / (k + 2) * (nw - w), nb + (k - 1) / (k + 2) * (nb - b)
        w, b = nw, nb
    return np.round(w * scale, 6), round(float(b), 6)


def _backed_off(weights: np.ndarray, seen: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Weights of typical features, those seen too rarely for a fit by their log odds on the scale of the fitted ones."""
    fitted = seen >= LEAST_DOCUMENTS
    scale = odds[fitted] @ weights[fitted] / (odds[fitted] @ odds[fitted]) if fitted.any() else 1 / (len(BEGINNINGS) + 1)
    return np.where(fitted, weights, np.round(max(scale, 0.0) * odds, 6))


def _histogram(fired: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the labelled rows in descending order, in steps of BIN, with how many rows have them: toxic, all."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.array([bias + weights[x].sum() if x else bias for x in batch.column(0).to_pylist()], float)
            at = np.clip(np.round(logits / BIN), -LAST_BIN, LAST_BIN).astype(np.int64)
            bins, place = np.unique(at, return_inverse=True)
            y = batch.column(1).to_numpy().astype(float)
            toxic = np.bincount(place, y, minlength=len(bins)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(toxic), pa.array(np.bincount(place, minlength=len(bins)))], names=["bin", "toxic", "n"])

    found = fired.select("fired", "y").mapInArrow(freed(emit), "bin long, toxic long, n long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    rows = sorted(map(tuple, found.collect()), reverse=True)  # at most one row per bin
    bins, toxic, n = (np.array(x) for x in zip(*rows, strict=True))
    return bins * BIN, toxic, n


def _threshold(logits: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """Where to cut descending logits for the best F1 against the labels: the middle of the widest best gap."""
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    gap = logits - np.append(logits[1:], logits[-1] - 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[np.argmax(gap[best])]
    return float(logits[at] - gap[at] / 2)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = SAMPLE_ROWS) -> Model:
    """A model from all training rows of ``labels`` and the votes on all of ``docs``; only the fit reads at most ``fit_rows`` of them.

    Rows of ``labels`` with a null id or a label other than 0 and 1 are left out, and an id with several labels is toxic if one
    is. Without both a toxic and another labelled text there is nothing to learn: the score is then high exactly where a
    lexicon fires.
    """
    labelled = _labelled(docs, labels, id, text, label)
    counted = {row["y"]: row["n"] for row in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counted.get(0) or not counted.get(1):
        weights = np.array([4.0] * len(LEXICONS) + [0.0] * len(PATTERNS))
        return Model([], weights, -3.0)
    total = counted[0] + counted[1]
    typical = _typical(labelled, counted[1], counted[0])
    names, voters = [x[0] for x in typical], _voters(typical)
    width = len(voters)
    fired = _fired(labelled, names, voters)
    known = [fired.filter(F.col("y") == y).groupBy("votes").agg(F.count("*").alias("n")) for y in (0, 1)]
    sums = [_expected(known[y], width, lambda bits, y=y: np.full(len(bits), float(y)))[y] for y in (0, 1)]
    start = np.stack([(np.diag(x[:-1].reshape(width, width)) + 0.5) / (x[-1] + 1) for x in sums])
    prior, rates, shares = _label_model(_votes(docs, text, names, voters), width, float(np.clip(counted[1] / total, 1e-4, 0.5)), start)
    right = sum(_expected(known[y], width, lambda bits: (_posterior(bits, prior, rates, shares) > 0.5).astype(float))[y, -1] for y in (0, 1))
    accuracy = float(np.clip(right / total, 0.6, 0.97))
    # The hash leaves about twice the rows to sort, not all of them.
    part = fired.filter(F.pmod("hash", F.lit(1 << 20)) < math.ceil(min(1.0, 2 * fit_rows / total) * (1 << 20)))
    if part.count() < min(fit_rows, total):  # rows that repeat have one hash
        part = fired
    sample = part.orderBy("hash", "y", "fired").limit(fit_rows).collect()
    gold = np.array([row["y"] for row in sample])
    posterior = _posterior(_bits(np.array([row["votes"] for row in sample], np.int64), width), prior, rates, shares)
    logit = np.log(np.clip(posterior, 1e-9, 1 - 1e-9) / np.clip(1 - posterior, 1e-9, 1)) + (2 * gold - 1) * np.log(accuracy / (1 - accuracy))
    size = len(_FIXED) + len(names)
    weights, bias = _fit([row["fired"] for row in sample], 1 / (1 + np.exp(-logit)), size)
    seen = np.bincount(np.array([i for row in sample for i in row["fired"]], int), minlength=size)
    weights[len(_FIXED) :] = _backed_off(weights[len(_FIXED) :], seen[len(_FIXED) :], np.array([x[1] for x in typical]))
    # The best cut on all training rows gets the score that a row has to reach.
    bias = round(bias - _threshold(*_histogram(fired, weights, bias)) + float(np.log(THRESHOLD / (1 - THRESHOLD))), 6)
    return Model(names, weights, bias, voters, rates, shares)


def score_documents(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score): whether the row's label was held out, and its toxicity. Null texts score as empty ones."""
    held_out = F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1
    return docs.select(F.col(id).alias(id), F.coalesce(held_out, F.lit(False)).alias("held_out"), model.score(F.col(text)).alias("score"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    return docs.filter(model.score(F.col(text)) < threshold)
