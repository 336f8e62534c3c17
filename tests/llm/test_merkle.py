"""The Merkle manifest against a plain version, with parts of one leaf, of one superblock and of several."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pathloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key string, pos int, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def path(nodes, at):
    """Siblings of each level (those before, those after), and the only node at the end."""
    out = []
    while len(nodes) > 1:
        run = at // 8 * 8
        out.append((nodes[run:at], nodes[at + 1 : run + 8]))
        nodes, at = up(nodes), at // 8
    return out, nodes[0]


def plain(rows, seen):
    """(id, leaf, subroot, root, proof, folded root) of each row; ``seen`` is the row as it is read now."""
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for own in parts.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [path([leaf_of(r) for r in parts[p]], 0)[1] for p in order]
    out = []
    for i, p in enumerate(order):
        leaves = [leaf_of(r) for r in parts[p]]
        crown, root = path(subroots, i)
        for j, row in enumerate(parts[p]):
            steps = path(leaves, j)[0] + crown
            node = leaf_of(seen(row))
            for before, after in steps:
                node = sha("".join(before) + node + "".join(after))
            out.append((str(row[0]), leaves[j], subroots[i], root, [x for b, a in steps for x in b + a], node, node == root))
    return sorted(out)


def rows_of(found):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], list(r["proof"]), r["folded_root"], r["verified"]) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i % 3}", "big", i, f"Text {i} é") for i in range(1300)]  # three superblocks, the last one short
    out += [(5000 + i, None, "mid", None, "" if i % 2 else None) for i in range(513)]  # the second one has a single leaf
    out += [(7000 + i, "x", "run", 1, "A" * i) for i in range(9)] + [(8000, "x", None, 1, "b"), (None, "x", None, 1, "c"), (8001, "", "", 2, "漢" * 50_000)]
    out += [(9000, "x", "same", 1, "T"), (9000, "x", "same", 1, "T"), (9000, "x", "same", 1, "U")]
    return out + [(10_000 + i, "x", f"l{i:02}", 1, "Z") for i in range(70)]


def test_against_plain(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(6)
    changed, small = F.coalesce(F.col("doc_id"), F.lit(1)) % 4 == 0, F.lower("text")

    def seen(row):
        return (*row[:4], row[4].lower()) if row[0] is not None and row[0] % 4 == 0 and row[4] is not None else row

    found = merkle.build_manifest(docs, changed=changed, now={"text": small})
    assert rows_of(found) == plain(rows, seen)
    assert rows_of(merkle.build_manifest(docs)) == plain(rows, lambda row: row)


def test_small_tables(spark):
    one = [(1, "s", "en", 1, "only")]
    schema = SCHEMA.split(", leaf")[0]
    assert rows_of(merkle.build_manifest(spark.createDataFrame(one, schema))) == plain(one, lambda row: row)
    assert merkle.build_manifest(spark.createDataFrame([], schema)).collect() == []
    digests = merkle.build_manifest(spark.createDataFrame(one * 3, schema), proof=merkle.as_digest, proof_type="string").collect()
    assert all(r["proof"] == sha(r["leaf"] * 2) and r["verified"] for r in digests)
