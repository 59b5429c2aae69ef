"""Budgets against exact water filling, selections against a plain walk in hash order."""

import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from shelfspark.llm import mixing

LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"web": 5, "book": 3, "off": 0}, "lang": {"en": 6, "de": 2}}


def fill(children, budget):
    """{name: (w, cap)} -> {name: given}, by adding the shortage again until nobody is short."""
    given, left, open_ = {}, budget, {n: v for n, v in children.items() if v[0] > 0}
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if cap <= Fraction(left * w, weight)]
        if not full:
            return given | {n: left * w // weight for n, (w, _) in open_.items()}
        for n in full:
            given[n] = open_[n][1]
        left -= sum(open_.pop(n)[1] for n in full)
    return given


def plan(rows, target, epochs):
    leaves = {}
    for r in rows:
        leaves[r[1:4]] = leaves.get(r[1:4], 0) + r[4]
    w = lambda level, name: WEIGHTS.get(level, {}).get(name, 1)
    cap = lambda path: sum(t * epochs for p, t in leaves.items() if p[:len(path)] == path
                           and all(w(lv, n) for lv, n in zip(LEVELS, p)))
    budgets, level = {(): min(target, cap(()))}, 0
    while level < 3:
        nxt = {}
        for path, budget in budgets.items():
            names = {p[level] for p in leaves if p[:level] == path}
            for n, b in fill({n: (w(LEVELS[level], n), cap(path + (n,))) for n in names}, budget).items():
                nxt[path + (n,)] = b
        budgets, level = nxt, level + 1
    copies = {}
    for path, b in budgets.items():
        t = leaves[path]
        if not t or not b:
            continue
        q, rest, seen = b // t, b % t, 0
        mine = {}
        for r in rows:
            if r[1:4] == path:
                mine.setdefault(hashlib.md5(f"42:{q}:{r[0] if r[0] is not None else ''}".encode()).hexdigest(), []).append(r)
        for key in sorted(mine):
            c = q + (seen < rest)
            seen += sum(r[4] for r in mine[key])
            for r in mine[key]:
                if c:
                    copies[r] = c
    return copies


def run(spark, rows, share, epochs=4):
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    target = F.floor(F.col("total") * share)
    out = mixing.select_documents(df, LEVELS, WEIGHTS, target, epochs)
    got = {}
    for r in out.collect():
        got[(r["doc_id"], r["domain"], r["lang"], r["source"], r["n_tokens"])] = r["copies"]
    want = plan([(r[0], *(x or "" for x in r[1:4]), r[4] or 0) for r in rows], int(sum(r[4] or 0 for r in rows) * share), epochs)
    assert got == want
    return got


def test_selection(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["web", "web", "web", "book", "code", "off"]), rng.choice(["en", "de", None]),
             rng.choice(["hot", "hot", "a", "b"]), rng.choice([0, 1, 5, 50, 1000])) for i in range(400)]
    for share in (0.5, 1.0, 3.0, 9.0):
        assert run(spark, rows, share)
    assert max(run(spark, rows, 1.5).values()) > 1


def test_edges(spark):
    rows = [(1, "web", "en", "a", 10), (1, "web", "en", "a", 10), (None, None, None, None, None), (2, "off", "en", "a", 9)]
    got = run(spark, rows, 0.5)
    assert got[(1, "web", "en", "a", 10)] in (1, 2)
    empty = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, n_tokens long")
    assert mixing.select_documents(empty, LEVELS, WEIGHTS, F.col("total")).count() == 0


def test_rows_come_back_as_often(spark):
    df = spark.createDataFrame([(1, "a b c", "en", 7), (2, "d e", "de", 8), (2, "d e", "de", 8), (3, None, None, 9), (None, "x y", "de", 1)],
                               "doc_id long, text string, lang string, n_tokens int")
    out = mixing.mixed_documents(df, {"lang": F.col("lang")}, {}, F.col("total") * 2, max_epochs=2)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 0, 1, 1, 2, 2, 2, 2]


def test_shortage_stays_in_the_family(spark):
    """A short source is filled by its sibling, not by the other domain."""
    leaves = spark.createDataFrame([("web", "en", "short", 10), ("web", "en", "long", 1000), ("book", "en", "c", 1000)],
                                   "domain string, lang string, source string, tokens long")
    out = mixing.leaf_budgets(leaves, LEVELS, {}, F.lit(400), 1)
    assert {r["source"]: r["budget"] for r in out.collect()} == {"short": 10, "long": 190, "c": 200}
