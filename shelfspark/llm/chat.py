"""Chat formatting: conversations brought into a legal order of roles at the least cost, then rendered.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant.  Of every turn the repair may keep the role, change it, or merge the turn into
the message before; it may insert an empty message before a turn or at the end.  The cheapest
repair is a shortest path through the automaton's states.

A turn is a matrix of costs between states, and such matrices multiply, so a
conversation of any length is cut into fragments: each fragment's matrix is found on its own, a
conversation's fragments choose the states at their borders, and the fragments are then repaired
between these states.  No task holds a whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, MERGE_OTHER, INSERT = 2, 1, 3, 3
# what the end costs: the empty messages up to an assistant's
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
FRAGMENT_TURNS = 4096
INFINITE = 1 << 40
END_MARK = "<|end|>\n"

# (from, to, inserted state or -1, merged) by own state of the turn, cheapest first for each (from, to)
Step = tuple[int, int, int, int, bool]


def steps_of(own: int) -> list[Step]:
    """All (cost, from, to, inserted, merged) of a turn whose role is `own` (0: no known role)."""
    found: list[Step] = []
    for at in range(4):
        for to in NEXT[at]:
            found.append((0 if to == own else RELABEL, at, to, -1, False))
        if at != START:
            found.append((MERGE if at == own else MERGE_OTHER, at, at, -1, True))
        for between in NEXT[at]:
            for to in NEXT[between]:
                found.append((INSERT + (0 if to == own else RELABEL), at, to, between, False))
    return sorted(found)


_STEPS = [steps_of(own) for own in range(4)]


def role_state(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def fragment_costs(states: list[int]) -> list[int]:
    """The 4 x 4 costs of a run of turns, row by row: from each state into each."""
    out = []
    for start in range(4):
        costs = [0 if s == start else INFINITE for s in range(4)]
        for own in states:
            after = [INFINITE] * 4
            for cost, at, to, _, _ in _STEPS[own]:
                after[to] = min(after[to], costs[at] + cost)
            costs = after
        out += costs
    return out


def choose_states(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, exit) state of each fragment of one conversation, of the cheapest repair."""
    costs = [0, INFINITE, INFINITE, INFINITE]
    back: list[list[int]] = []
    for m in matrices:
        after, best = [INFINITE] * 4, [0] * 4
        for to in range(4):
            for at in range(4):
                if costs[at] + m[4 * at + to] < after[to]:
                    after[to], best[to] = costs[at] + m[4 * at + to], at
        back.append(best)
        costs = after
    state = min(range(4), key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), s))
    out = []
    for best in reversed(back):
        out.append((best[state], state))
        state = best[state]
    return out[::-1]


def repair(states: list[int], entry: int, leave: int) -> list[Step]:
    """The cheapest steps of a run of turns between two states."""
    costs = [0 if s == entry else INFINITE for s in range(4)]
    back: list[list[Step | None]] = []
    for own in states:
        after: list[int] = [INFINITE] * 4
        best: list[Step | None] = [None] * 4
        for step in _STEPS[own]:
            cost, at, to, _, _ = step
            if costs[at] + cost < after[to]:
                after[to], best[to] = costs[at] + cost, step
        back.append(best)
        costs = after
    out, state = [], leave
    for best in reversed(back):
        step = best[state]
        out.append(step)
        state = step[1]
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches by their first `width` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:width] != key:
                yield key, held
                held = []
            key = row[:width]
            held.append(row)
    if held:
        yield key, held


def _emit(rows: Iterator[tuple], schema: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*held), fields)], [n for n, _ in fields])
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def repaired(conversations: DataFrame, fragment_turns: int = FRAGMENT_TURNS) -> DataFrame:
    """(conv_id, position, sub, turn, role, action, rendered): the repaired conversations, piece by piece.

    position numbers a conversation's turns from 0, in the order of turn, ties by a hash of role and text; sub is 1 for
    the turn itself, 0 for an empty message before it, 2 and 3 for those after the last.  action is keep,
    relabel, merge or insert.  The pieces of a conversation, joined in the order of (position,
    sub), are its rendered text.  Rows without a conv_id are one conversation; turns without a
    number come first; null texts are empty; roles that are null or unknown cost a change
    wherever they go.  Repeated rows are repeated turns.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows():
            last, fragment, n = object(), -1, 0
            for batch in batches:
                for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                    if conv != last or n >= fragment_turns:
                        last, fragment, n = conv, fragment + 1, 0
                    yield conv, part, fragment, n, turn, role, text
                    n += 1
        return _emit(rows(), sorted_schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(((held[0][3], *key, len(held), fragment_costs([role_state(r[4]) for r in held]))
                      for key, held in _groups(batches, 2)), measured_schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, held in _groups(batches, 1):
                offset = 0
                states = choose_states([r[4] for r in held])
                for i, (r, (entry, leave)) in enumerate(zip(held, states)):
                    yield r[1], r[2], entry, leave, offset, i == len(held) - 1
                    offset += r[3]
        return _emit(rows(), chosen_schema)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, held in _groups(batches, 2):
                entry, leave, offset, last = held[0][7:]
                fresh = entry == START
                for i, step in enumerate(repair([role_state(r[5]) for r in held], entry, leave)):
                    conv, turn, role, text = held[i][3:7]
                    _, _, to, between, merged = step
                    if between >= 0:
                        yield conv, offset + i, 0, None, ROLES[between - 1], "insert", _open(between, fresh)
                        fresh = False
                    action = "merge" if merged else "keep" if to == role_state(role) else "relabel"
                    lead = "\n\n" if merged else _open(to, fresh)
                    fresh = False
                    final = last and i == len(held) - 1
                    closing = CLOSING[leave] if final else ()
                    yield (conv, offset + i, 1, turn, ROLES[to - 1], action,
                           lead + (text or "") + ("\n" + END_MARK if final and not closing else ""))
                    for k, extra in enumerate(closing):
                        yield (conv, offset + i, 2 + k, None, ROLES[extra - 1], "insert",
                               _open(extra, False) + ("\n" + END_MARK if k == len(closing) - 1 else ""))
        return _emit(rows(), "conv_id long, position long, sub int, turn long, role string, action string, rendered string")

    sorted_schema = "conv_id long, part int, fragment int, n int, turn long, role string, text string"
    measured_schema = "conv_id long, part int, fragment int, turns long, costs array<long>"
    chosen_schema = "part int, fragment int, entry int, leave int, offset long, last boolean"
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    turns = written(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                         F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
                    .repartitionByRange(parts, *order[:2], F.xxhash64("role", "text")).sortWithinPartitions(*order[:2], F.xxhash64("role", "text"), *order[2:])
                    .mapInArrow(cut, sorted_schema), "turns")
    measured = (turns.select("part", "fragment", "n", "conv_id", "role").repartition("part", "fragment")
                .sortWithinPartitions("part", "fragment", "n").mapInArrow(measure, measured_schema))
    chosen = written(measured.select("conv_id", "part", "fragment", "turns", "costs").repartition("conv_id")
                     .sortWithinPartitions("conv_id", "part", "fragment").mapInArrow(choose, chosen_schema), "states")
    return (turns.join(chosen, ["part", "fragment"])
            .select("part", "fragment", "n", "conv_id", "turn", "role", "text", "entry", "leave", "offset", "last")
            .repartition("part", "fragment").sortWithinPartitions("part", "fragment", "n")
            .select("part", "fragment", "n", "conv_id", "turn", "role", "text", "entry", "leave", "offset", "last")
            .mapInArrow(render, "conv_id long, position long, sub int, turn long, role string, action string, rendered string"))


def _open(state: int, first: bool) -> str:
    return ("" if first else "\n" + END_MARK) + f"<|{ROLES[state - 1]}|>\n"
