"""Chat formatting: the cheapest repair of a conversation's roles, then one rendered text piece per turn.

A legal conversation is an automaton over roles: an optional system turn, then user and assistant in turn, beginning with
user; it may end after either. A repair reads the turns in order and for each one

* keeps it, or relabels it to another role (cost RELABEL, or RELABEL_UNKNOWN if its role is none of the three, plus SYSTEM
  if one of the roles is system), as a turn of its own, possibly with empty turns inserted before it (cost INSERT each), or
* merges it into the turn before it (cost MERGE, plus relabelling if the roles differ).

Dynamic programming finds a repair of the least cost; of equally cheap ones a fixed order of choices decides. The cost of a run
of turns is a matrix from the state before it to the state behind it, and such matrices combine in any grouping. So a
conversation is cut into blocks: each block's matrix is worked out alone, the few blocks of a conversation are combined in
order, and each block is then repaired between known states. Only these small matrices of a conversation meet in one task, never
its turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import rank_by_order
from ..session import cut_lineage

MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 3, 2, 4
#: On top of relabelling, where one of the two roles is system.
SYSTEM = 2
#: Turns in a block: consecutive turn numbers divided by this. If turn numbers repeat, so that a block has more rows, it is cut by rank.
BLOCK_TURNS = 1024
ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START = 3
STATES = 4
#: Which role may follow in which state.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
_FAR = np.int64(1) << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each state and role the shortest list of empty turns that makes the role legal; of equally long ones the first found."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in range(STATES):
        paths = [((), state)]
        while paths:
            later = []
            for path, at in paths:
                for role in NEXT[at]:
                    if (state, role) not in found:
                        found[state, role] = path
                        later.append(((*path, role), role))
            paths = later
    return found


BRIDGES = _bridges()


def choices(role: int | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(state before, state behind, cost, action, empty turns before) for one turn; role: its number, or None."""
    out = []
    for new in range(len(ROLES)):
        change = 0 if new == role else (RELABEL_UNKNOWN if role is None else RELABEL) + SYSTEM * (0 in (new, role))
        for state in range(STATES):
            if (state, new) in BRIDGES:
                bridge = BRIDGES[state, new]
                out.append((state, new, change + INSERT * len(bridge), "keep" if not change else "relabel", bridge))
        out.append((new, new, MERGE + change, "merge", ()))
    return out


_CHOICES = {role: choices(role) for role in (0, 1, 2, None)}


def _costs(role: int | None) -> np.ndarray:
    costs = np.full((STATES, STATES), _FAR)
    for before, behind, cost, _, _ in _CHOICES[role]:
        costs[before, behind] = min(costs[before, behind], cost)
    return costs


_COSTS = {role: _costs(role) for role in (0, 1, 2, None)}


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of two runs of turns, one behind the other."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def repair(roles: list[int | None], before: int, behind: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, empty turns before) of each turn of a cheapest repair between two states."""
    best = np.full((len(roles) + 1, STATES), _FAR)
    best[-1, behind] = 0
    for i in range(len(roles) - 1, -1, -1):
        best[i] = np.minimum((_COSTS[roles[i]] + best[i + 1][None, :]).min(axis=1), _FAR)
    out, state = [], before
    for i, role in enumerate(roles):
        _, new, _, action, bridge = next(c for c in _CHOICES[role] if c[0] == state and c[2] + best[i + 1, c[1]] == best[i, state])
        out.append((new, action, bridge))
        state = new
    return out


def _number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def escaped(text: str) -> str:
    """The markers can't be written by a turn's text."""
    return text.replace("<|", "<\\|")


def head(role: int, first: bool) -> str:
    return f"{'' if first else CLOSE + chr(10)}{OPEN}{ROLES[role]}\n"


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per block: conv, block, piece, and its matrix as a list."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a block come together and in order; the last block of a batch may go on in the next.
        key, matrix = None, None
        rows: list[tuple] = []
        schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("piece", pa.int64()), ("costs", pa.list_(pa.int64()))])
        pack = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
        for batch in batches:
            for *at, role in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if tuple(at) != key:
                    if key is not None:
                        rows.append((*key, matrix.ravel().tolist()))
                    key, matrix = tuple(at), _COSTS[_number(role)]
                else:
                    matrix = chain(matrix, _COSTS[_number(role)])
            yield pack()
            rows = []
        if key is not None:
            rows.append((*key, matrix.ravel().tolist()))
        yield pack()

    return turns.select("conv", "block", "piece", "role").mapInArrow(emit, "conv long, block long, piece long, costs array<long>")


def _borders(blocks: DataFrame) -> DataFrame:
    """The state before and behind each block, and the whole conversation's cost: one row per block is read, not its turns."""

    def emit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("piece", "ascending")])
        costs = [np.array(x.as_py(), np.int64).reshape(STATES, STATES) for x in rows.column("costs")]
        ahead = [np.zeros(STATES, np.int64)]
        for matrix in reversed(costs):
            ahead.append(np.minimum((matrix + ahead[-1][None, :]).min(axis=1), _FAR))
        ahead.reverse()
        states = [START]
        for i, matrix in enumerate(costs):
            states.append(int(np.argmin(matrix[states[-1]] + ahead[i + 1])))
        size = len(costs)
        return pa.table(
            {
                "conv": rows.column("conv"),
                "block": rows.column("block"),
                "piece": rows.column("piece"),
                "before": pa.array(states[:-1], pa.int32()),
                "behind": pa.array(states[1:], pa.int32()),
                "last": pa.array([i == size - 1 for i in range(size)], pa.bool_()),
                "cost": pa.array([int(ahead[0][START])] * size, pa.int64()),
            }
        )

    return blocks.groupBy("conv").applyInArrow(emit, "conv long, block long, piece long, before int, behind int, last boolean, cost long")


_OUT = pa.schema(
    [("conv", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("old", pa.string()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.int64()), ("rendered", pa.string()), ("cost", pa.int64())]
)


def _rendered(group: list[dict]) -> list[dict]:
    """The rows of a whole block, repaired and rendered."""
    first = group[0]
    steps = repair([_number(x["role"]) for x in group], first["before"], first["behind"])
    begun, out = first["before"] != START, []
    for x, (role, action, bridge) in zip(group, steps, strict=True):
        text = escaped(x["text"] or "")
        if action == "merge":
            piece = "\n" + text
        else:
            piece = ""
            for new in (*bridge, role):
                piece += head(new, not begun)
                begun = True
            piece += text
        out.append(
            {"conv": x["conv"], "at": x["at"], "turn": x["turn"], "old": x["role"], "role": ROLES[role], "action": action, "inserted": len(bridge), "rendered": piece, "cost": x["cost"]}
        )
    if first["last"]:
        out[-1]["rendered"] += CLOSE + "\n"
    return out


def _in_pieces(rows: DataFrame) -> DataFrame:
    """The rows with ``piece``: 0, or in blocks of more than BLOCK_TURNS rows their rank in the block divided by that."""
    whole = rows.withColumn("piece", F.lit(0).cast("long"))
    large = cut_lineage(rows.groupBy("conv", "block").count().filter(F.col("count") > BLOCK_TURNS).select(F.col("conv").alias("c"), F.col("block").alias("k")))
    if large.isEmpty():
        return whole
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))
    # A null conversation has to meet itself; rows that are equal in all are told apart, so that they don't end in one task.
    named = rows.join(large, same, "left_semi").select("*", F.coalesce("conv", F.lit(0)).alias("key"), F.col("conv").isNull().alias("none"))
    tied = named.withColumn("tie", F.monotonically_increasing_id())
    ranked = rank_by_order(tied, ["none", "key", "block"], [F.col(name) for name in ("at", "role", "text", "tie")])
    cut = ranked.withColumn("piece", F.floor((F.col("rn") - 1) / BLOCK_TURNS).cast("long")).select(*whole.columns)
    return whole.join(large, same, "left_anti").unionByName(cut)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv, turn, ``old_role``, ``new_role``, ``action``, ``inserted``, ``rendered``, ``cost``.

    ``action`` is keep, relabel or merge, ``inserted`` the number of empty turns put before it and ``cost`` that of the whole
    conversation. The ``rendered`` pieces of a conversation, in the order of its turns, make up its text. Turns are ordered
    by number; rows that repeat a number, in whatever order, by role and text, and a null number comes first. A role is read without case and blanks; others and null are
    unknown and have to be relabelled. A null text is empty. Null conversations are one conversation. An empty table gives
    an empty result.
    """
    number = F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62)))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"),
        F.floor(number / BLOCK_TURNS).cast("long").alias("block"),
        number.alias("at"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    rows = _in_pieces(rows)
    block = ("conv", "block", "piece")
    blocks = rows.select(*block, "at", "role").repartition(*block).sortWithinPartitions(*block, "at", "role")
    borders = cut_lineage(_borders(_blocks(blocks)))
    b = borders.select(F.col("conv").alias("c"), F.col("block").alias("k"), F.col("piece").alias("p"), "before", "behind", "last", "cost")
    known = rows.join(b, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")) & (F.col("piece") == F.col("p"))).drop("c", "k", "p")
    known = known.repartition(*block).sortWithinPartitions(*block, "at", "role", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for x in batch.to_pylist():
                if group and any(group[0][name] != x[name] for name in block):
                    out += _rendered(group)
                    group = []
                group.append(x)
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)
        if group:
            yield pa.RecordBatch.from_pylist(_rendered(group), schema=_OUT)

    schema = "conv long, at long, turn long, old string, role string, action string, inserted long, rendered string, cost long"
    return known.mapInArrow(emit, schema).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("old").alias("old_role"), F.col("role").alias("new_role"), "action", "inserted", "rendered", "cost"
    )
