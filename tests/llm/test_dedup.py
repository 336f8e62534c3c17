"""Exact, near and suffix deduplication."""

import random

import numpy as np
import pytest
from brute import near, repeats
from pyspark.sql import functions as F

from pathloom.llm import suffix_dedup
from pathloom.llm.components import components
from pathloom.llm.exact_dedup import drop_copies, group_copies
from pathloom.llm.near_dedup import NearDuplicates, drop_near_copies
from pathloom.llm.queries import QUERIES
from pathloom.llm.suffix_dedup import as_digest, remove_repeats

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, kept string, winner int"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_exact_copies_with_odd_rows(spark):
    rows = [(1, "a", "x", 1), (3, "a", None, 2), (3, "a", "y", 3), (2, None, "z", 4), (5, "", "z", 5), (None, "a", "n", 6), (None, "b", "n", 7), (4, "A", "x", 8)]
    found = group_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    by = {(r["doc_id"], r["rest"]["winner"]): r for r in found}
    assert {k[1]: (r["keep_id"], r["group_size"]) for k, r in by.items()} == {
        1: (3, 4), 2: (3, 4), 3: (3, 4), 6: (3, 4), 4: (5, 2), 5: (5, 2), 7: (None, 1), 8: (4, 1),
    }
    kept = [r["rest"]["winner"] for r in found if r["kept"]]
    assert len(kept) == 4 and {5, 7, 8} <= set(kept) and len({2, 3} & set(kept)) == 1  # of a repeated id one row
    out = drop_copies(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "kept", "winner"]
    assert {r["winner"] for r in out.collect()} == set(kept)
    assert {r["text"] for r in out.collect()} == {"a", "", "b", "A"}


def test_exact_copies_can_be_normalised(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in drop_copies(rows, normalise=F.lower).collect()) == [(2, "aB"), (3, None)]


def test_large_group_over_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text").repartition(37)
    found = group_copies(rows).filter("group_size > 1").collect()
    assert len(found) == 1667 and {r["keep_id"] for r in found} == {4998} and sum(r["kept"] for r in found) == 1


def test_members_of_one_content_stay_in_several_tasks(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")).repartition(8)
    old = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for threshold in ("-1", old["spark.sql.autoBroadcastJoinThreshold"]):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            found = group_copies(rows)
            tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.min("group_size"), F.min("keep_id")).collect()
            assert len(tasks) > 1 and sum(r["n"] for r in tasks) == 4000 and sum(r["kept"] for r in tasks) == 1
            assert {(r["min(group_size)"], r["min(keep_id)"]) for r in tasks} == {(4000, 3999)}
            found.collect()
            assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_near_copies_match_brute_force(spark):
    found = sorted(map(tuple, QUERIES["op3_near_dedup"](spark, FOLDER).collect()))
    assert found == near(documents(spark))


def test_near_copies_of_generated_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, n = [], 0
    for size, length in ((60, 150), (40, 700), (30, 12), (25, 300)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, length // 25))):
                text[rng.randrange(length)] = word()
            docs.append((n, " ".join(text)))
            n += 7
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "one two"), (n + 5, "ONE  two"), (n + 6, "one two three"), (n + 7, docs[0][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = NearDuplicates(table, size=4).classes()
    got = sorted((r["id"], r["n"], r["component"], r["id"] == r["component"]) for r in found.collect())
    assert got == near(docs)
    assert len({x[2] for x in got}) < len(got) - 50


def test_large_texts_around_the_threshold(spark):
    draw = random.Random(5)
    docs = []
    for group in range(2):
        words = [f"w{draw.randrange(10**6)}" for _ in range(430 + 470 * group)]
        for k in range(40):
            rate = draw.choice((0.01, 0.03, 0.06))
            docs.append((1000 * group + k, " ".join(f"e{draw.randrange(10**6)}" if draw.random() < rate else w for w in words)))
    classes = NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4).classes()
    got = sorted((r.id, r.n, r.component, r.id == r.component) for r in classes.collect())
    assert got == near(docs)
    assert 1 < sum(r[3] for r in got) < 60


def test_texts_that_are_not_alike_enough_seldom_meet(spark):
    """Pairs with a similarity of about a half are not candidates again and again."""
    draw = random.Random(6)
    words = [f"w{draw.randrange(10**6)}" for _ in range(900)]
    docs = [(k, " ".join(f"e{draw.randrange(10**6)}" if draw.random() < 0.04 else w for w in words)) for k in range(40)]
    lists = NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4)._lists()
    met = lists.groupBy("value").count().selectExpr("sum(count * (count - 1) / 2) AS met").first().met or 0
    assert met < 4 * 780  # there are 780 pairs


@pytest.mark.parametrize("size", [4, 5])
def test_pairs_tried_grow_with_the_group(spark, monkeypatch, size):
    """Variants of a long text, many of them too far off for a link: a few pairs each are tried, not their square."""
    draw = random.Random(8)
    words = [f"w{draw.randrange(10**6)}" for _ in range(800)]
    docs = []
    for k in range(160):
        rate = draw.uniform(0.005, 0.06)
        docs.append((k, " ".join(f"e{draw.randrange(10**6)}" if draw.random() < rate else w for w in words)))
    tried, verified = [], NearDuplicates._verified

    def counted(self, pairs):
        tried.append(pairs.count())
        return verified(self, pairs)

    monkeypatch.setattr(NearDuplicates, "_verified", counted)
    classes = NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=size).classes()
    got = sorted((r.id, r.n, r.component, r.id == r.component) for r in classes.collect())
    assert got == near(docs, size)
    assert 10 < sum(r[3] for r in got) < 150 and sum(tried) < 4 * len(docs)


def test_near_copies_with_odd_rows(spark):
    rows = [(2, "a b c d e f", "x", 1), (2, "a b c d e f", "x", 1), (1, "A B C D E F", None, 2), (None, "a b c d e f", "x", 3), (7, None, "x", 4)]
    out = drop_near_copies(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "kept", "winner"]
    assert sorted(r["winner"] for r in out.collect()) == [2, 3, 4]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    edges = chain + [(7, i) for i in range(300, 340)] + [(5, 5), (9, 7)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(100, 165)} == {100} and {found[i] for i in (7, 9, 300, 339)} == {7} and 5 not in found


def test_repeats_match_brute_force(spark):
    found = sorted(map(tuple, QUERIES["op2_suffix_dedup"](spark, FOLDER).collect()))
    assert found == repeats(documents(spark))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats_of_generated_texts(spark, monkeypatch, hot):
    """Runs of one byte, many small batches, windows at both ends, characters of several bytes; all anchors hot or none."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcé 中") for _ in range(rng.randrange(40, 160))) for _ in range(12)] + ["-" * 70, "ab" * 45]
    docs = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(30))]) for _ in range(rng.randrange(0, 6)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "-" * 900), (103, docs[3][1]), (104, "z" * 49), (105, "z" * 49)]
    wanted = repeats(docs)
    assert sum(x[2] for x in wanted) > 3000
    # The passes run where the settings were made.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        found = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), finish=as_digest)
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in found.collect()) == wanted
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_repeats_with_odd_rows(spark):
    text = "0123456789" * 6
    rows = [(1, text, "x", 1), (1, text, "x", 2), (None, text, "x", 3), (2, None, "x", 4)]
    found = remove_repeats(spark.createDataFrame(rows, DOCS))
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept"]) for r in found.collect()) == [(0, 60, ""), (1, 0, text), (1, 0, text), (2, 0, "")]


def test_collisions_are_caught():
    """With a hash that tells nothing apart the order still comes from the bytes."""
    rows = np.array([[3, 1, 0], [1, 2, 0], [3, 0, 0], [1, 2, 0]], np.uint16)
    group = np.zeros(4, np.int64)
    plain = suffix_dedup.Suffixes(rows, group)
    blind = suffix_dedup.Suffixes.__new__(suffix_dedup.Suffixes)
    blind.__class__ = type("Blind", (suffix_dedup.Suffixes,), {"extension": lambda self, x, y: np.full(len(x), self.width)})
    blind.__init__(rows, group)
    assert rows[plain.order].tolist() == rows[blind.order].tolist() == sorted(rows.tolist())
    assert plain.common.tolist() == blind.common.tolist() == [-1, 3, 0, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert group_copies(none).count() == drop_copies(none).count() == remove_repeats(none).count() == drop_near_copies(none).count() == 0
