"""The machine against held-out labels, its score against the formula, and pairs it must learn."""

import itertools
import math
import random
import zlib

import numpy as np

from shelfspark.llm import toxicity as T
from tests.conftest import SMALL

DATA = SMALL.replace("0.001", "0.01")


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    rows = T.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    pairs = [(a["score"], b["score"]) for a in held if a["toxic"] == 1 for b in held if b["toxic"] == 0]
    assert sum((x > y) + 0.5 * (x == y) for x, y in pairs) / len(pairs) > 0.85
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93
    # labels of held-out rows are not read
    flipped = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(T.held_out()).unionByName(labels.where(~T.held_out()))
    again = T.fit(docs, flipped)
    assert again.features == model.features and np.array_equal(again.weights, model.weights)


def test_scores_are_the_formula():
    rng = np.random.default_rng(1)
    model = T.FactorizationMachine({}, 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[], [2], [0, 1, 5], [0, 1, 2, 3, 4, 5]]
    got = model.scores([np.array(r, np.int64) for r in rows])
    for row, score in zip(rows, got):
        raw = 0.3 + sum(model.weights[i] for i in row) + sum(model.factors[i] @ model.factors[j] for i, j in itertools.combinations(row, 2))
        assert abs(score - 1 / (1 + math.exp(-raw))) < 1e-12


def test_interactions_are_learned():
    """Two terms that are toxic only together: no additive weights separate them."""
    rng = random.Random(3)
    rows, labels = [], []
    for _ in range(3000):
        row = [i for i in range(4) if rng.random() < 0.5]
        rows.append(np.array(row, np.int64))
        labels.append(float(0 in row and 1 in row or 0 not in row and 1 not in row))
    model = T._train({i: i for i in range(4)}, rows, np.array(labels), 0.0)
    assert ((model.scores(rows) >= 0.5) == np.array(labels)).mean() > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words", 5), (1, "good words", 5), (2, None, 1), (3, "", 1), (None, "idiot", 2)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(docs, none)
    out = T.score(docs, model).collect()
    assert len(out) == 5 and all(r["predicted"] == 0 for r in out)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 1), (3, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert T.score(docs, T.fit(docs, odd)).count() == 5
    kept = T.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == 5
    assert T.without_toxic(docs.limit(0), model).count() == 0
    assert T.distinct_words("A " * 10 + "b") == {"a", "b"}
