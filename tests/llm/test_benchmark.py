"""Decontamination against a plain greedy tiling over all pairs."""

import random

import pytest

from shelfspark.llm import benchmark as B
from tests.conftest import SMALL


def words(text):
    return [w for run in B.token_runs(text) for w in run]


def plain_tiles(text, item, least=5):
    """Longest common unmarked run first, until none of `least` tokens is left."""
    free_t, free_i = [True] * len(text), [True] * len(item)
    covered = 0
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while t + n < len(text) and p + n < len(item) and free_t[t + n] and free_i[p + n] and text[t + n] == item[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        n, t, p = best
        if n < least:
            return covered
        free_t[t:t + n] = [False] * n
        free_i[p:p + n] = [False] * n
        covered += n


def test_tiles_cover_what_plain_tiling_covers():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randint(1, 40) for _ in range(rng.randint(5, 40))]
        cut = rng.randint(0, len(item))
        text = [rng.randint(1, 40) for _ in range(10)] + item[cut:] + [rng.randint(1, 40) for _ in range(4)] + item[:cut]
        made = B.tiles(text, item)
        assert sum(n for *_, n in made) == plain_tiles(text, item)
        assert all(text[t:t + n] == item[p:p + n] for t, p, n in made)


@pytest.mark.parametrize("bound", [B.BROADCAST_BYTES, -1])
def test_reordered_passages(spark, monkeypatch, bound):
    monkeypatch.setattr(B, "BROADCAST_BYTES", bound)
    rng = random.Random(5)
    item = [f"Word{rng.randint(0, 500)}" for _ in range(40)]
    moved = " ".join(item[20:] + ["x", "y,"] + item[:20])
    filler = " ".join(f"f{i}" for i in range(200))
    docs = [(1, filler + " " + moved, "a"), (2, filler, "a"), (3, None, None), (4, "", "b"), (4, moved, "b"),
            (None, moved.upper(), "c"), (6, " ".join(item[:12]), "c"), (7, " ".join(item[:30]), "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item), 1), (11, "too short", 1), (12, None, 1), (None, " ".join(item), 1),
                                   (13, " ".join(item), 2)], "item_id long, text string, doc_id int")
    got = sorted((r["doc_id"] or 0, r["contaminated"], r["item_ids"]) for r in B.contaminated_documents(df, bench).collect())
    assert got == sorted([(1, True, [10, 13]), (2, False, []), (3, False, []), (4, False, []), (4, True, [10, 13]),
                          (0, True, [10, 13]), (6, False, []), (7, True, [10, 13])])
    kept = B.without_benchmark(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6]
    assert B.contaminated_documents(df.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in B.contaminated_documents(df, bench.limit(0)).collect())


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    grams = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    want = {}
    for r in docs.collect():
        text = words(r["text"])
        mine = {tuple(text[k:k + 5]) for k in range(len(text) - 4)}
        want[r["doc_id"]] = sorted(i for i in items if len(mine & grams[i]) > 1
                                   and plain_tiles(text, items[i]) >= 0.5 * len(items[i]))
    got = {r["doc_id"]: r["item_ids"] for r in B.contaminated_documents(docs, bench).collect()}
    assert got == want and any(want.values())
