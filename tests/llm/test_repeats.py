"""Repeated strings against a count of every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfspark.llm import repeats as R
from tests.conftest import SMALL


def slow(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i:i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **kind):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = sorted((tuple(r) for r in R.without_repeats(df).collect()), key=str)
    assert got == slow(rows)
    return got


def sample_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéöß") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(20, 90)) for _ in range(6)] + ["x" * 230, "ab" * 150]
    rows = [(0, None), (1, ""), (2, "short"), (2, "short"), (3, "y" * 199), (4, "y" * 199), (5, "z" * 200), (6, "z" * 201), (None, "q" * 500)]
    for i in range(10, 60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
                parts.append(rng.choice([p, p[a:b]]))
            else:
                parts.append(text(rng.randint(1, 60)))
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(70, rows[20][1]), (71, rows[20][1]), (72, rows[21][1][:-1] + "!")]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, R.HOT_CONTEXTS), (2, R.HOT_CONTEXTS), (3, 1)])
def test_small(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(R, "HOT_CONTEXTS", hot)
    got = check(spark, sample_rows(seed))
    assert any(0 < r[2] < r[1] for r in got)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(spark, rows)


def test_empty_table(spark):
    assert R.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcdef") for _ in range(5000)) + b"a" * 700
    def places():
        out = []
        for buffer, segments, owners, offsets in R._buffers([text]):
            at, owner, h, ph = R._anchors(buffer, segments)
            out += list(zip((at - np.array([s[0] for s in segments])[owner] + np.array(offsets)[owner]).tolist(), h.tolist(), ph.tolist()))
        return sorted(set(out))
    want = places()
    monkeypatch.setattr(R, "BUFFER", 300)
    assert places() == want


def test_merge_of_shards():
    rng = np.random.default_rng(5)
    rows = rng.integers(97, 100, (300, R.CONTEXT), dtype=np.uint8)
    for i in range(100, 300):
        j = rng.integers(0, 100)
        a, b = sorted(rng.integers(0, R.CONTEXT, 2))
        rows[i, a:b] = rows[j, a:b]
    rows[5, :90] = R.OUTSIDE
    rows[6, :90] = R.OUTSIDE
    rows[6, 90:] = rows[5, 90:]
    want = np.zeros((300, R.LEFT + 1), bool)
    for a in range(R.LEFT + 1):
        windows = [rows[i, R.LEFT - a:R.LEFT - a + 200].tobytes() for i in range(300)]
        count = Counter(windows)
        want[:, a] = [count[w] > 1 and R.OUTSIDE not in w for w in windows]
    assert want.any()
    for size in (1, 7, 64, 1000):
        assert (R.repeated_windows(rows, size) == want).all()


def test_no_group_beyond_the_bound_in_one_task(spark, monkeypatch):
    """One string in many different surroundings: its contexts are counted in Spark, with the same spans."""
    monkeypatch.setattr(R, "HOT_CONTEXTS", 5)
    largest, plain = [], R._context_groups

    def watched(rows):
        largest.append(max((r["count"] for r in rows.groupBy("g").count().collect()), default=0))
        return plain(rows)
    monkeypatch.setattr(R, "_context_groups", watched)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    note = text(200)
    rows = [(i, text(170) + note + text(170)) for i in range(30)] + [(90, note + text(90)), (91, text(30) + note)]
    got = check(spark, rows)
    assert all(r[2] >= 200 for r in got)
    assert largest and max(largest) <= 5
