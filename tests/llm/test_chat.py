"""Role repair against a search over all repairs of short conversations."""

import itertools
import random

import pytest

from shelfspark.llm import chat as C
from tests.conftest import SMALL


def cheapest(states):
    """Least cost by trying every sequence of steps."""
    best = [{C.START: 0}]
    for own in states:
        after = {}
        for at, cost in best[-1].items():
            for c, a, to, _, _ in C.steps_of(own):
                if a == at:
                    after[to] = min(after.get(to, 1 << 30), cost + c)
        best.append(after)
    return min(cost + C.INSERT * len(C.CLOSING[s]) for s, cost in best[-1].items())


def messages(pieces):
    """Roles of the messages in the order of the pieces."""
    return [role for role, action in pieces if action != "merge"]


def cost_of(rows):
    total, current = 0, None
    for r in rows:
        own = (r["role_in"] or "").strip().lower()
        if r["action"] == "insert":
            total += C.INSERT
        elif r["action"] == "merge":
            total += C.MERGE if own == current else C.MERGE_OTHER
        elif r["action"] == "relabel":
            total += C.RELABEL
        else:
            assert own == r["role"]
        if r["action"] != "merge":
            current = r["role"]
    return total


def legal(roles):
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and roles


@pytest.mark.parametrize("size", [2, C.FRAGMENT_TURNS])
def test_small(spark, size):
    rng = random.Random(6)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (None, None, None, None), (2, 0, " System ", "s"), (3, 0, "assistant", ""),
            (3, 0, "assistant", ""), (4, 5, "tool", "x")]
    for conv in range(10, 60):
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "User", "bot", None]), f"text {conv} {t}") for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(["user", "user", "assistant"]), f"t{t}") for t in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    out = C.repaired(df, size).collect()
    assert sum(r["action"] != "insert" for r in out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["conv_id"], []).append(r)
    given = {}
    for conv, turn, role, text in rows:
        given.setdefault(conv, {}).setdefault(turn, []).append((role, text or ""))
    for conv, pieces in by.items():
        pieces.sort(key=lambda r: (r["position"], r["sub"]))
        assert legal(messages([(p["role"], p["action"]) for p in pieces]))
        named = [p.asDict() | {"role_in": given[conv][p["turn"]][0][0] if p["action"] != "insert" else None} for p in pieces]
        own = [C.role_state(n["role_in"]) for n in named if n["action"] != "insert"]
        assert cost_of(named) == cheapest(own)
        text = "".join(p["rendered"] for p in pieces)
        assert text.count(C.END_MARK) == len(messages([(p["role"], p["action"]) for p in pieces])) and text.endswith(C.END_MARK)
    assert C.repaired(df.limit(0)).count() == 0
    one = [p["rendered"] for p in by[1]]
    assert "".join(one) == "<|user|>\nhi\n<|end|>\n<|assistant|>\nho\n<|end|>\n"


def test_every_short_conversation():
    for n in range(1, 5):
        for states in itertools.product(range(4), repeat=n):
            (entry, leave), = C.choose_states([C.fragment_costs(list(states))])
            steps = C.repair(list(states), entry, leave)
            total = sum(s[0] for s in steps) + C.INSERT * len(C.CLOSING[leave])
            assert entry == C.START and total == cheapest(states)


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    out = C.repaired(df)
    assert out.where("action <> 'insert'").count() == df.count()
    kept = {r["conv_id"] for r in df.collect()}
    assert {r["conv_id"] for r in out.collect()} == kept
