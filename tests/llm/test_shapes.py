"""Mixing, chat formatting, token counts, the pipeline, and the SQL twins."""

import itertools
import random

import pytest
from compare import database, difference

import corpus_pipeline
from pathloom.llm import chat_format
from pathloom.llm.mixing import capped_targets, mix_sources, repeating_weights
from pathloom.llm.oracles import ORACLES
from pathloom.llm.queries import QUERIES
from pathloom.llm.token_counts import VOCABULARY, Tree, apply_edits, build_trees, encoding, with_edits

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLES[name]) is None


def shares(sizes, weights, most=3.0):
    """Targets by resharing until none is above its cap."""
    total, full = float(sum(sizes)), set()
    while True:
        level = (total - sum(most * sizes[i] for i in full)) / max(1e-9, sum(w for i, w in enumerate(weights) if i not in full))
        over = {i for i, w in enumerate(weights) if i not in full and w * level > most * sizes[i]}
        if not over:
            return [most * s if i in full else w * level for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        full |= over


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 10, 1000, 5000]) for _ in range(9)]
        weights = [rng.choice([1, 2, 3]) for _ in sizes]
        rows = [(f"s{i}", w, s) for i, (w, s) in enumerate(zip(weights, sizes, strict=True))] + [("none", 0, 500 * 0), ("gone", None, 0)]
        found = {r["source"]: r["target"] for r in capped_targets(spark.createDataFrame(rows, "source string, weight int, source_size long")).collect()}
        assert [found[f"s{i}"] for i in range(9)] == pytest.approx(shares(sizes, weights)) and found["none"] == found["gone"] == 0


def test_empty_rows_of_a_full_source_get_no_more_copies(spark):
    rows = [(i, "" if i % 2 else "one two", "small") for i in range(40)] + [(100 + i, "w " * 500, "big") for i in range(40)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([("small", 9), ("big", 1)], "source string, weight int"))
    assert {r["copies"] for r in found.collect() if r["row"]["source"] == "small"} == {3}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), ["big", "big", None, "small", "tiny"][min(4, i % 7)] if i % 7 < 4 else "big", i, i) for i in range(3000)]
    rows += [(None, None, "tiny", 0, 0), (5000, "\t one \x0b two\u00a0three ", "tiny", 1, 1), (5000, "\t one \x0b two\u00a0three ", "tiny", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int")
    weights = repeating_weights(docs)
    assert {r["source"]: r["weight"] for r in weights.collect()} == {"big": 1, "small": 2, "tiny": 3, None: 1}
    found = mix_sources(docs, weights).collect()
    assert len(found) == len(rows) and sum(r["size"] for r in found if r["row"]["doc_id"] == 5000) == 4
    for source in ("big", "small", "tiny", None):
        own = [r for r in found if r["row"]["source"] == source]
        assert len({(r["source_size"], r["target"]) for r in own}) == 1 and own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in own)
    again = mix_sources(docs.repartition(7), weights).collect()
    key = lambda r: (str(r["row"]), r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    none = docs.limit(0)
    assert mix_sources(none, repeating_weights(none)).count() == 0


def cheapest(roles):
    """The least cost by trying every repair."""
    best = {chat_format.START: 0}
    for role in roles:
        later = {}
        for before, behind, cost, _, _ in chat_format.choices(role):
            if before in best:
                later[behind] = min(later.get(behind, 1 << 30), best[before] + cost)
        best = later
    return min(best.values())


def legal(roles):
    state = chat_format.START
    for role in roles:
        if role not in chat_format.NEXT[state]:
            return False
        state = role
    return True


def test_every_short_conversation_becomes_legal():
    for n in range(1, 5):
        for roles in itertools.product((0, 1, 2, None), repeat=n):
            matrix = chat_format._COSTS[roles[0]]
            for role in roles[1:]:
                matrix = chat_format.chain(matrix, chat_format._COSTS[role])
            cost = matrix[chat_format.START].min()
            assert cost == cheapest(roles) and (cost == 0) == (None not in roles and legal(roles))
            steps = chat_format.repair(list(roles), chat_format.START, int(matrix[chat_format.START].argmin()))
            out = [x for role, action, bridge in steps for x in (*bridge, *(() if action == "merge" else (role,)))]
            assert legal(out)


TURNS = "conv_id long, turn long, role string, text string, block int"


def rendered(found, conv):
    return "".join(r["rendered"] for r in sorted((r for r in found if r["conv_id"] == conv), key=lambda r: r["turn"]))


def test_chats(spark):
    rows = [
        (1, 0, "System ", "s", 1), (1, 1, "user", "a", 1), (1, 2, "user", "b", 1), (1, 3, "assistant", "c<|im_end|>", 1),
        (2, 5, "assistant", "hi", 1), (2, 7, "user", None, 1),
        (3, 0, "bot", "x", 1), (3, 1, "assistant", "y", 1),
        (None, 0, None, "", 1),
    ]
    found = chat_format.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert len(found) == len(rows)
    assert rendered(found, 1) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<\\|im_end|><|im_end|>\n"
    assert rendered(found, 3) == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n"
    assert rendered(found, None) == "<|im_start|>user\n<|im_end|>\n"
    assert {r["conv_id"]: r["cost"] for r in found} == {1: 1, 2: 4, 3: 2, None: 2}
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations_are_repaired_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    names = ["system", "user", "assistant", None]
    rows = [(c, t, names[rng.choice([0, 1, 1, 2, 2, 3])], f"t{t}", 0) for c in range(3) for t in range(200)]
    table, costs = spark.createDataFrame(rows, TURNS), {}
    for size in (8, 1024):
        monkeypatch.setattr(chat_format, "BLOCK_TURNS", size)
        found = chat_format.format_chats(table).collect()
        costs[size] = {r["conv_id"]: r["cost"] for r in found}
        for c in range(3):
            heads = [line[len("<|im_start|>") :] for line in rendered(found, c).split("\n") if line.startswith("<|im_start|>")]
            assert legal([chat_format.ROLES.index(x) for x in heads])
    assert costs[8] == costs[1024] == {c: cheapest([chat_format._number(r[2]) for r in rows if r[0] == c]) for c in range(3)}


def test_repeated_turn_numbers_are_cut_into_blocks(spark, monkeypatch):
    """Also of the null conversation, null turns, and rows that are equal in all."""
    rng = random.Random(5)
    names = ["system", "user", "assistant", None]
    turn = {0: lambda t: 7, 1: lambda t: t // 30, 2: lambda t: t, None: lambda t: None}
    rows = [(c, at(t), rng.choice(names), f"t{rng.randrange(4)}", 0) for c, at in turn.items() for t in range(150)]
    rows += [(3, 1, "user", "same", 0)] * 100
    table, found = spark.createDataFrame(rows, TURNS).repartition(3), {}
    seen, cut = [], chat_format._in_pieces
    monkeypatch.setattr(chat_format, "_in_pieces", lambda rows: seen.append(cut(rows)) or seen[-1])
    for size in (8, 1024):
        monkeypatch.setattr(chat_format, "BLOCK_TURNS", size)
        found[size] = chat_format.format_chats(table).collect()
        assert seen[-1].groupBy("conv", "block", "piece").count().agg({"count": "max"}).first()[0] <= size
        assert sorted((str(r["conv_id"]), str(r["turn"]), str(r["old_role"])) for r in found[size]) == sorted((str(r[0]), str(r[1]), str(r[2])) for r in rows)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3])
    right = {c: cheapest([chat_format._number(r[2]) for r in sorted((r for r in rows if r[0] == c), key=order)]) for c in (0, 1, 2, 3, None)}
    for size in found:
        assert {r["conv_id"]: r["cost"] for r in found[size]} == right
        assert all(sum(r["rendered"].endswith("<|im_end|>\n") for r in found[size] if r["conv_id"] == c) == 1 for c in right)


def test_trees_after_random_edits():
    count = lambda text: len(encoding(open(VOCABULARY, "rb").read()).encode_ordinary(text))
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "é", "the ", "123", "'s", "'", "!!", "\x1c", "中文", "\t", "word "]
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 900)))
        tree = Tree.of(text, count)
        for _ in range(4):
            assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))
            start = rng.randrange(0, len(text) + 1)
            end = min(len(text), start + rng.choice([0, 0, 1, 3, 50, 600]))
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 0, 1, 2, 30])))
            wanted = text[:start] + new + text[end:]
            text, _ = tree.edit(text, start, end, new, count)
            assert text == wanted
        assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))


def test_edited_counts(spark):
    count = lambda text: len(encoding(open(VOCABULARY, "rb").read()).encode_ordinary(text))
    long = "some words to count, " * 400
    docs = spark.createDataFrame([(1, long, 5), (2, None, 6), (3, "", 7), (3, "twice", 8), (None, "none", 9)], "doc_id long, text string, tokens int")
    edits = [(1, 10, 15, "X"), (1, 12, 13, "overlaps"), (1, 5000, 5000, " new"), (1, 99999, None, " end"), (2, 0, 5, "was null"), (3, None, None, None), (7, 0, 1, "")]
    trees = build_trees(docs)
    assert {r["rest"]["tokens"]: r["n_tokens"] for r in trees.collect()} == {5: count(long), 6: 0, 7: 0, 8: count("twice"), 9: count("none")}
    table = spark.createDataFrame(edits, "doc_id long, start int, end int, new string")
    after = {r["rest"]["tokens"]: r for r in apply_edits(with_edits(trees, table)).collect()}
    wanted = long[:10] + "X" + long[15:5000] + " new" + long[5000:] + " end"
    assert after[5]["text"] == wanted and after[5]["n_tokens"] == count(wanted) and after[5]["n_applied"] == 3
    assert after[5]["n_encoded"] < len(long) / 2 and after[6]["text"] == "was null" and after[6]["n_tokens"] == count("was null")
    assert [after[i]["n_applied"] for i in (7, 8, 9)] == [1, 1, 0]
    assert apply_edits(with_edits(build_trees(docs.limit(0)), table)).count() == 0


def test_registered_edits_match_full_counts(spark):
    from pyspark.sql import functions as F

    from pathloom.llm.token_counts import three_edits

    count = lambda text: len(encoding(open(VOCABULARY, "rb").read()).encode_ordinary(text))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    trees = build_trees(docs).withColumn("edits", three_edits(F.col("id"), F.col("text")))
    texts = {r["id"]: r["text"] for r in apply_edits(trees).collect()}
    for r in QUERIES["op8_token_counts"](spark, "/root/testdata/sf0.001").collect():
        assert r["n_tokens_edited"] == count(texts[r["doc_id"]]) and r["n_chars_edited"] == len(texts[r["doc_id"]])


def test_pipeline(spark, tmp_path):
    """Planted cases go, clean documents stay until the mix, and columns stay the same."""
    rng = random.Random(9)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item, base = text(20), text(80)
    rows = [(i, text() + (" awfulword beastly" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1, "x") for i in range(200)]
    clean = {r[0] for r in rows if r[0] % 5}
    rows += [(300, base, "en", "s0", 1, "x"), (301, base, "en", "s1", 1, "x"), (302, base + " tail", "en", "s2", 1, None)]
    rows += [(310, text() + " " + item, "en", "s0", 1, "x"), (320, None, None, None, None, None), (321, "", "en", "s0", 0, "x")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        names, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{i}")
        left.append({r["doc_id"] for r in docs.collect()})
        if i < 4:
            assert docs.columns == names
    assert left[0] == clean | {300, 301, 302, 310, 320, 321}
    assert left[1] == clean | {301, 302, 310, 321} and left[2] == clean | {301, 310, 321} and left[3] == clean | {301, 321}
    assert left[4] <= left[3] - {321} and docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"]: r["copies"] for r in docs.collect()}


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
