"""Exact Jaccard components against brute force over all pairs, families near the threshold, long lists by centres."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import jaccard, queries
from tests.conftest import SMALL

SPACES = " \t\n\x0b\x0c\r"


def grams_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def slow(docs):
    sets = {at: grams_of(text) for at, (_, text) in enumerate(docs)}
    root = {at: at for at in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 90 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = {}
    for at, (doc, _) in enumerate(docs):
        if doc is not None:
            low[find(at)] = min(doc, low.get(find(at), doc))
    return sorted(((doc, len(sets[at]), low.get(find(at)) if sets[at] else doc) for at, (doc, _) in enumerate(docs)), key=str)


def found(frame, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame, **options).collect()), key=str)


def edited(rng, words, edits, word):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"{word}{rng.randrange(10 ** 9)}"
    return " ".join(words)


def family_docs(rng):
    """Families whose members are alike but mostly not linked, with and without the text they come from."""
    docs = []
    for family in range(3):
        base = [f"w{family}x{rng.randrange(500)}" for _ in range(100)]
        docs += [edited(rng, base, 1, "e") for _ in range(60)]
        docs += [edited(rng, base, 2, "f") for _ in range(20)]
        if family == 1:
            docs.append(" ".join(base))
        # a second family at a similarity of about 0.8 to the first
        other = base[:90] + [f"o{family}x{i}" for i in range(10)]
        docs += [edited(rng, other, rng.randrange(2), "g") for _ in range(30)]
        docs += [" ".join(base[:rng.randrange(85, 100)]) for _ in range(10)]
    docs += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    docs += [None, "", " \n", "one", "One", "two words", "two  WORDS", "a b c", "a b c", "x " * 500, "x " * 300]
    rng.shuffle(docs)
    return [(at * 3 % 1009, text) for at, text in enumerate(docs)]


@pytest.mark.parametrize("list_rows, rounds, plain_pairs", [(64, 6, 500_000), (4, 2, 0)])
def test_families_equal_brute_force(spark, list_rows, rounds, plain_pairs):
    docs = family_docs(random.Random(7))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame, list_rows=list_rows, rounds=rounds, plain_pairs=plain_pairs) == slow(docs)


def test_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op12_jaccard(spark, SMALL).collect()), key=str)
    assert got == slow(docs)


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    text = " ".join(map(str, range(50)))
    docs = [(None, text), (None, text), (5, text + " z"), (5, "other words stand here"), (5, None), (None, None), (9, "lone text of words"), (9, "lone text of words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select(
        "*", F.lit(1).alias("id"), F.lit(2).alias("root"), F.lit(3).alias("n"), F.lit(4).alias("component_id"))
    assert found(frame) == slow(docs)
    assert found(frame.limit(0)) == []


def test_all_pairs_of_two_large_families_are_not_formed(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    other = base[:108] + [f"c{i}" for i in range(12)]
    docs = list(enumerate([edited(rng, base, 1, "e") for _ in range(300)] + [edited(rng, other, 1, "f") for _ in range(300)]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    real = jaccard._list_pairs

    def counted(lists, percent):
        pairs = real(lists, percent)
        seen.append(pairs.count())
        return pairs
    jaccard._list_pairs = counted
    try:
        assert found(frame, plain_pairs=0) == slow(docs)
    finally:
        jaccard._list_pairs = real
    assert sum(seen) < 60 * len(docs)


def test_skipped_blocks_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = int(rng.integers(2, 60))
        n = rng.integers(20, 40, m)
        pos = rng.integers(0, 5, m)
        ids, root = np.arange(m), rng.integers(0, m, m)
        a, b = jaccard.skipping_pairs(ids, root, n, pos, n, 180 * n, 90)
        c, d = jaccard.block_pairs([ids, root, n, pos, n, 180 * n], np.array([0]), m, 90)
        plain = {(x, y) for x, y in itertools.combinations(range(m), 2)
                 if root[x] != root[y] and 9 * max(n[x], n[y]) <= 10 * min(n[x], n[y])
                 and 380 * min(n[x] - pos[x], n[y] - pos[y]) >= 180 * (n[x] + n[y])}
        assert set(zip(a.tolist(), b.tolist())) == set(zip(c.tolist(), d.tolist())) == plain
