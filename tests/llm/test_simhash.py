"""SimHash against brute force: fingerprints bit by bit, links over all pairs."""

import itertools
import random

import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import common, simhash
from shelfspark.llm.common import components
from tests.conftest import SMALL

SPACES = " \t\n\x0b\x0c\r"


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_components(df).collect()}
    prints = {d: slow_print(t) for d, t, _ in rows}
    groups = slow_groups(prints)
    assert got == {d: (prints[d], groups[d]) for d in prints}


def test_covering_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}É" if i % 9 == 0 else f"W{i}" for i in range(60)]
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, "one Two", "b"), (4, "ONE two", "b"),
            (5, "x y z q r s", "c")]
    base = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(6, 60):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice(SPACES).join(words), "hot"))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 50))), "x") for i in range(60, 120)]
    check(spark, rows)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(spark, rows)


def test_long_text_in_runs(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(5000))
    monkeypatch.setattr("shelfspark.llm.common.WORD_CHUNK", 64)
    assert simhash.fingerprint(text) == slow_print(text)


def test_keep_one_each(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(3, text, 1), (2, text, 2), (2, text, 2), (None, text, 3), (9, "other words here", 4)],
                               "doc_id long, text string, root int")
    out = sorted((r["doc_id"] or 0, r["root"]) for r in simhash.keep_one_each(df).collect())
    assert out == [(0, 3), (2, 2), (9, 4)]
    assert simhash.keep_one_each(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(500, 400), (400, 400), (450, 500)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(links.unionByName(more)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 450: 400, 500: 400}


def test_members_are_shuffled_though_their_tables_look_small(spark, monkeypatch):
    """An explode of 31 masks has 31 times the rows that Spark expects; no join may send it to the driver."""
    plans, write = {}, common.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(common, "written", seen)
    monkeypatch.setattr(simhash, "written", seen)
    df = spark.createDataFrame([(i, f"a b c d e f g h i j k{i % 30} l{i % 7}") for i in range(200)], "doc_id long, text string")
    few = sorted(simhash.simhash_components(df).collect())
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans["members"]) and plans["members"]
    # tables of more rows than a broadcast takes are shuffled as well
    plans.clear()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    many = simhash.simhash_components(df)
    assert not any("Broadcast" in p for name in ("members", "placed") for p in plans[name])
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString() and sorted(many.collect()) == few
