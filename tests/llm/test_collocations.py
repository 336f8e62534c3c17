"""Phrase mining against plain counting."""

import random
import re

from pathloom.llm import collocations
from pathloom.llm.collocations import Bits, frequent_phrases, mine_phrases
from pathloom.llm.queries import op13_collocations

SCHEMA = "text string, lang string, phrase string, n int, rank int"


def plain(rows, longest=5, least=100, percent=100, top=2000):
    counts, totals = {}, {}
    for text, lang in rows:
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            part = "und" if lang is None else lang
            totals[part] = totals.get(part, 0) + len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    key = (part, tuple(words[i : i + m]))
                    counts[key] = counts.get(key, 0) + 1
    frequent = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    inside = set()
    for (part, words), a in frequent.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                small = (part, words[i : i + m])
                if 100 * a >= percent * frequent[small]:
                    inside.add(small)
    out = {}
    for (part, words), a in frequent.items():
        if (part, words) not in inside:
            n = totals[part]
            score, k = min((1000 * a * n // (counts[part, words[:k]] * counts[part, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(part, []).append((-score, -a, " ".join(words).encode(), counts[part, words[:k]], counts[part, words[k:]], n))
    return sorted(
        (part, i + 1, p.decode(), -a, l, r, n, -s) for part, found in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top])
    )


def mined(docs, **options):
    return sorted(tuple(r) for r in mine_phrases(docs, **options).collect())


def made(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "\x01", "a\x01", "é", "漢字", "x" * 300, "b c", "new", "york", "city", "\x1d"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.8 else f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!?", "\x0b"]) for w in words)
        rows.append((text + (" New York City hall" if rng.random() < 0.5 else ""), rng.choice(["en", "en", "en", None, "und", "de"])))
    return [*rows, (None, "en"), ("", None), (" . ", "fr"), (" ".join(["same line of words"] * 3000), "en"), ("only once", "xx")]


def test_against_plain(spark):
    rows = made(1)
    docs = spark.createDataFrame([(t, lang, "p", 1, 2) for t, lang in rows], SCHEMA).repartition(5)
    for options in ({"least": 20}, {"least": 5, "longest": 3, "top": 50}, {"least": 20, "percent": 60}, {"least": 20, "longest": 2}):
        found = mined(docs, **options)
        assert found and found == plain(rows, **options)


def test_many_partitions_and_full_bits(spark, monkeypatch):
    """Borders inside a phrase's extensions, and bits that prove nothing."""
    rows = made(2, 150)
    docs = spark.createDataFrame([(t, lang, "p", 1, 2) for t, lang in rows], SCHEMA)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    monkeypatch.setattr(Bits, "of", lambda self, hashes: hashes == hashes)
    monkeypatch.setattr(collocations, "_SLICE", 2000)
    try:
        assert mined(docs, least=8) == plain(rows, least=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([("a b", "en", "", 1, 1)], SCHEMA)
    assert mined(docs) == [] and mined(docs.limit(0)) == []
    totals = frequent_phrases(docs.selectExpr("lang AS part", "cast(text AS binary) AS text")).collect()
    assert [(r["part"], r["words"], r["a"]) for r in totals] == [("en", [], 2)]


def test_query(spark):
    assert op13_collocations(spark, "/root/testdata/sf0.001").columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
