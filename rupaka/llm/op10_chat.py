"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton.

A legal conversation may open with one system message; then user and assistant take
turns, and the assistant has the last word. For every turn the repair takes it as a
new message, merges it into the message before, or gives it another role, and may put
empty messages in between. Each has a cost, and the cheapest repair wins; among equally
cheap ones a hash of conversation, turn and state decides, so the result is one and
the same however the rows are spread.

Turns are sorted over the cluster by conversation and turn, and cut into segments of up to
``SEGMENT`` rows. What a segment holds of a conversation acts on the automaton's states as a
matrix of least costs. Matrices combine, so a conversation that holds a third of all rows is
repaired in as many tasks as its rows lie in; only its matrices meet in one place, one for
each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from rupaka.llm.common import small_batches, table, written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last message.
START, N = 0, 4
MERGE, RELABEL, UNKNOWN, INSERT = 2, 3, 1, 4
#: Which states may stand before a message of each role.
BEFORE = {1: (START,), 2: (START, 1, 3), 3: (2,)}
#: A cost unit is worth this much of the tie-breaking hashes, of which there are at most as many as turns.
UNIT = 1 << 96
NEVER = None
#: Rows of a segment, as a power of two: what a worker holds at once.
SEGMENT = 14


@lru_cache(maxsize=None)
def inserted(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty messages between a state and a new message of ``role``; None if there is no way."""
    todo, seen = [(state, ())], {state}
    while todo:
        s, way = todo.pop(0)
        if s in BEFORE[role]:
            return way
        for r, before in BEFORE.items():
            if s in before and r not in seen:
                seen.add(r)
                todo.append((r, (*way, r)))
    return None


@lru_cache(maxsize=None)
def closing(state: int) -> tuple[int, ...]:
    """The empty messages that let a conversation end in this state."""
    return () if state in (START, 3) else (*inserted(state, 3), 3)


@lru_cache(maxsize=None)
def moves(role: str | None) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, action) of a turn with this role."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for r in (1, 2, 3):
        other = 0 if r == own else RELABEL if own else UNKNOWN
        for s in range(N):
            if s == r:
                out.append((s, r, MERGE + other, "merge" if r == own else "relabel+merge"))
            if (way := inserted(s, r)) is not None:
                out.append((s, r, other + INSERT * len(way), ("take" if r == own else "relabel") + ("+insert" if way else "")))
    return tuple(out)


def tie(conv: int | None, turn: int | None, before: int, after: int, action: str) -> int:
    return xxh3_64_intdigest(f"{conv}:{turn}:{before}:{after}:{action}") >> 16


def step(costs: list, conv, turn, role) -> tuple[list, list]:
    """The least cost to be in each state after a turn, and the (state before, action) of each."""
    new, back = [NEVER] * N, [None] * N
    for a, b, cost, action in moves(role):
        if costs[a] is not NEVER:
            c = costs[a] + cost * UNIT + tie(conv, turn, a, b, action)
            if new[b] is NEVER or c < new[b]:
                new[b], back[b] = c, (a, action)
    return new, back


def segment_matrix(conv, turns: list[tuple]) -> list[list]:
    """Least costs from each state before the turns (turn, role) to each state after."""
    out = []
    for s in range(N):
        costs = [0 if k == s else NEVER for k in range(N)]
        for turn, role in turns:
            costs, _ = step(costs, conv, turn, role)
        out.append(costs)
    return out


def segment_ends(matrices: list[list[list]]) -> list[tuple[int, int]]:
    """The states before and after each segment on the cheapest way through all of them."""
    costs, backs = [0, NEVER, NEVER, NEVER], []
    for m in matrices:
        new, back = [NEVER] * N, [None] * N
        for a in range(N):
            for b in range(N):
                if costs[a] is not NEVER and m[a][b] is not NEVER and (new[b] is NEVER or costs[a] + m[a][b] < new[b]):
                    new[b], back[b] = costs[a] + m[a][b], a
        costs = new
        backs.append(back)
    end = min((c + INSERT * UNIT * len(closing(s)), s) for s, c in enumerate(costs) if c is not NEVER)[1]
    out = []
    for back in reversed(backs):
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def segment_actions(conv, turns: list[tuple], first: int, last: int) -> list[tuple[int, int, str]]:
    """(state before, state after, action) of each turn on the cheapest way between two states."""
    costs, backs = [0 if k == first else NEVER for k in range(N)], []
    for turn, role in turns:
        costs, back = step(costs, conv, turn, role)
        backs.append(back)
    out = []
    for back in reversed(backs):
        before, action = back[last]
        out.append((before, last, action))
        last = before
    return out[::-1]


def rendered(text: str | None, before: int, after: int, action: str, ends: bool) -> tuple[str, str]:
    """The roles of empty messages put in, and the turn's part of the rendered conversation. In texts the opening ``<|`` of a marker gets a space."""
    safe = (text or "").replace("<|", "< |")
    if "merge" in action:
        way, part = (), "\n" + safe
    else:
        way = inserted(before, after)
        part = ("<|end|>\n" if before != START else "") + "".join(f"<|{ROLES[r - 1]}|>\n<|end|>\n" for r in way) + f"<|{ROLES[after - 1]}|>\n{safe}"
    if ends:
        way += closing(after)
        part += "<|end|>\n" + "".join(f"<|{ROLES[r - 1]}|>\n<|end|>\n" for r in closing(after))
    return ",".join(ROLES[r - 1] for r in way), part


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with one (conv_id, seg), as ((conv_id, seg), rows)."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names)):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield key, rows


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row of ``turns``: conv_id, turn, role, new_role, action, inserted, part.

    part is the turn's share of the rendered conversation: the parts of a
    conversation in order of turn, joined, are its rendering. action: take, merge or relabel, with
    +merge or +insert; inserted: roles of the empty messages put in before (or, after the
    last turn, at the end). Turns are ordered by turn, then role, then a hash of the text; null
    turns come first. Roles other than system, user and assistant, and null, get the role that
    costs least. Null texts are empty. Rows without conv_id form one conversation.
    """
    small_batches(turns.sparkSession)
    order = ("conv_id", "turn", "role", "h", "text")
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # ranges are found from samples of the keys, so a text's hash stands in for it; which segment has a row is fixed by writing it down
    t = t.withColumn("h", F.xxhash64("text")).repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions(*order)
    t = written(t.withColumn("seg", F.shiftright(F.monotonically_increasing_id(), SEGMENT)))
    in_order = lambda df: df.repartition("seg").sortWithinPartitions("seg", *order)
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("matrix", pa.list_(pa.string()))])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, seg), rows in _runs(batches, ("conv_id", "seg", "turn", "role")):
            flat = [None if c is NEVER else str(c) for r in segment_matrix(conv, rows) for c in r]
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(([conv], [seg], [flat]), schema.types)], schema=schema)

    m = in_order(t).select("conv_id", "seg", "turn", "role").mapInArrow(matrices, "conv_id long, seg long, matrix array<string>")
    ends_schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("final", pa.bool_())])

    def ends(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("seg").to_pylist(), group.column("matrix").to_pylist()))
        ms = [[[None if c is None else int(c) for c in f[N * a : N * a + N]] for a in range(N)] for _, f in rows]
        states = segment_ends(ms)
        cols = group.column("conv_id").to_pylist(), [s for s, _ in rows], [a for a, _ in states], [b for _, b in states], [k == len(rows) - 1 for k in range(len(rows))]
        return pa.Table.from_arrays([pa.array(c, ty) for c, ty in zip(cols, ends_schema.types)], schema=ends_schema)

    # one matrix for each segment that holds part of a conversation
    e = m.groupBy("conv_id").applyInArrow(ends, "conv_id long, seg long, first int, last int, final boolean")
    joined = t.join(e.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "first", "last", "final"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")))
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("part", pa.string())])

    def actions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for (conv, _), rows in _runs(batches, ("conv_id", "seg", "turn", "role", "text", "first", "last", "final")):
            first, last, final = rows[0][3:]
            for k, ((turn, role, text, *_), (a, b, action)) in enumerate(zip(rows, segment_actions(conv, [r[:2] for r in rows], first, last))):
                way, part = rendered(text, a, b, action, final and k == len(rows) - 1)
                group.append((conv, turn, role, ROLES[b - 1], action, way, part))
            if len(group) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*group), out.types)], schema=out)
                group = []
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*group), out.types)], schema=out)

    return in_order(joined).mapInArrow(actions, "conv_id long, turn long, role string, new_role string, action string, inserted string, part string")


def op10_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "new_role", "action", "inserted", F.sha2("part", 256).alias("part_sha256"))


QUERIES = {"op10_role_repair": op10_role_repair}
ORACLES: dict[str, str] = {}
