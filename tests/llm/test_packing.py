"""Packing: pieces against the tokenizer's own ids, little padding, plans for odd histograms."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathloom.llm.packing import Plan, as_crc32, best_patterns, class_sizes, pack_documents, rounded, solve_patterns
from pathloom.llm.queries import op11_packing

SCHEMA = "doc_id long, text string, start int, ids string, tail int"


def padding(fill, capacity):
    """Padded ids, after a check that pieces follow each other."""
    out = 0
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
        out += 0 if end & (end - 1) == 0 else capacity - end
    return out


def checked(rows, texts, capacity=2048):
    """The pieces of rows (id, text) against the tokenizer; the share of padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sorted([str(id), *tokenizer.encode(text or "", add_special_tokens=False).ids, 1] for id, text in texts)
    docs, fill = {}, {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], bytes(r["ids"])))
    found = []
    for id, pieces in docs.items():
        ids, end = [], 0
        for start, length, tokens, content in sorted(pieces):
            assert start == end and len(content) == 4 * length > 0
            ids += np.frombuffer(content, "<u4").tolist()
            end += length
        assert end == tokens
        found.append([str(id), *ids])
    assert sorted(found) == wanted
    return padding(fill, capacity) / sum(len(x) - 1 for x in wanted)


def test_pieces(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß漢 \x1c '.,") for _ in range(rng.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 20, 200])))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "same text"), (1004, "same text"), (1005, "wörd don't " * 5000)]
    texts += [(1006, "A" * 20_000), (1007, "İstanbul ΣΑΣ é <|endoftext|>x"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], SCHEMA).repartition(5)
    rows = pack_documents(docs).collect()
    assert checked(rows, texts) < 0.02
    few = pack_documents(docs, capacity=64).collect()
    assert checked(few, texts, 64) < 0.08
    crcs = pack_documents(docs, finish=as_crc32, finish_type="long")
    assert {(r["doc_id"], r["start"], r["ids"]) for r in crcs.collect() if r["start"] == 0 and r["length"] == r["doc_tokens"]} >= {
        (r["doc_id"], 0, zlib.crc32(bytes(r["ids"]))) for r in rows if r["doc_id"] == 1000
    }


def test_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(7, "one two", 0, "", 0)] * 50, SCHEMA)
    rows = pack_documents(docs).collect()
    assert sum(r["length"] for r in rows) == 50 * rows[0]["doc_tokens"]
    assert padding({s: [(r["offset"], r["length"]) for r in rows if r["sequence_id"] == s] for s in {r["sequence_id"] for r in rows}}, 2048) == 0
    assert pack_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("case", ["one", "halves", "large", "small", "hot", "mixed", "full"])
def test_plans(case):
    rng = np.random.RandomState(3)
    lengths = {
        "one": np.array([5]),
        "halves": np.array([1024] * 31),
        "large": rng.randint(1100, 1500, 4000),
        "small": rng.randint(1, 9, 5000),
        "hot": np.concatenate([np.full(20_000, 700), rng.randint(1, 2047, 3000)]),
        "mixed": np.minimum(2047, rng.lognormal(5, 1.5, 20_000).astype(int) + 1),
        "full": np.full(100, 2047),
    }[case]
    sizes, counts = np.unique(lengths, return_counts=True)
    plan, fill, total = Plan(sizes, counts), {}, 0
    for length, n in zip(sizes.tolist(), counts.tolist(), strict=True):
        for rank in range(n):
            end = 0
            for start, part, sequence, offset in plan.pieces(length, rank):
                assert start == end and part > 0
                end += part
                fill.setdefault(sequence, []).append((offset, part))
            assert end == length
            total += length
    assert len(fill) <= plan.sequences
    assert padding(fill, 2048) <= 0.005 * total


def test_column_generation():
    # The classic case: a program whose best value is known, found from single-class patterns.
    sizes, counts = np.array([3, 5, 7]), np.array([20, 20, 20])
    patterns, uses = solve_patterns(sizes, counts, 10)
    assert (patterns @ sizes <= 10).all() and np.allclose(uses @ patterns, counts)
    assert uses.sum() == pytest.approx(30, abs=0.05)  # 20 x (3, 7) and 10 x (5, 5)
    whole = rounded(patterns, uses, counts)
    assert (whole @ patterns <= counts).all()
    best, found = best_patterns(sizes, np.array([0.3, 0.5, 0.7]), 10)
    assert best == pytest.approx(1.0) and all(p @ sizes <= 10 for p in found)
    assert class_sizes(2048)[-1] == 2048 and (np.diff(class_sizes(2048)) > 0).all()


def test_query(spark):
    rows = op11_packing(spark, "/root/testdata/sf0.001").collect()
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert padding(fill, 2048) <= 0.01 * sum(r["length"] for r in rows)
