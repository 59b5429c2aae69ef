"""Repeated paragraphs against all pairs."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfspark.llm import paragraphs as P
from tests.conftest import SMALL


def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def slow(rows):
    items = []
    for n, (d, t) in enumerate(rows):
        for i, line in enumerate((t or "").split("\n")):
            words = [w for w in line.lower().replace("\t", " ").split(" ") if w]
            if len(words) >= 20:
                items.append(((d is not None, d or 0, n, i), words, shingles(words)))
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x, y in itertools.combinations(range(len(items)), 2):
        a, b = items[x][2], items[y][2]
        if items[x][1] == items[y][1] or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
            u, v = find(x), find(y)
            root[max(u, v)] = min(u, v)
    first = {}
    for x in sorted(range(len(items)), key=lambda x: items[x][0]):
        first.setdefault(find(x), x)
    return sorted(items[x][0][1:2] + items[x][0][3:] for x in range(len(items)) if first[find(x)] != x)


def test_small(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 90))) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (3, "short line\nshort line"), (None, base[0]), (None, base[0])]
    for i in range(10, 90):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base).split() if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(40)]
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row_id int").coalesce(1)
    got = P.repeated_paragraphs(df)
    removed = sorted((r["doc_id"] or 0, r["idx"]) for r in got.collect() if r["removed"])
    assert removed == slow(rows) and removed
    out = P.paragraph_report(df).collect()
    assert len(out) == len(rows)
    assert sum(r["n_removed"] for r in out) == len(removed)
    assert P.paragraph_report(df.limit(0)).count() == 0


def test_many_variants_of_one_paragraph(spark, monkeypatch):
    """Single edits of one text: the links that all pairs have, also where buckets are dealt again."""
    monkeypatch.setattr("shelfspark.llm.common.HOT_PARTS", 3)
    rng = random.Random(13)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"e{rng.randint(0, 99)}"
        rows.append((i, " ".join(words[:rng.choice([45, 60])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["idx"]) for r in P.repeated_paragraphs(df).where("removed").collect())
    assert got == slow(rows) and got


def test_variants_that_are_not_alike_make_no_pairs(spark, monkeypatch):
    """Texts with one common base that meet in buckets, but differ too much, are not compared pair by pair."""
    asked = []
    plain = P.link_within_buckets

    def counting(members, verified, *rest):
        def run(pairs):
            asked.append(pairs.count())
            return verified(pairs)
        return plain(members, run, *rest)

    monkeypatch.setattr(P, "link_within_buckets", counting)
    rng = random.Random(29)
    rows = []
    for i in range(150):
        words = [f"b{k}" for k in range(60)]
        for at in rng.sample(range(10, 50, 6), 2):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    # two that are alike
    rows.append((150, rows[7][1] + " end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["idx"]) for r in P.repeated_paragraphs(df).where("removed").collect())
    assert got == slow(rows) and (150, 0) in got
    # the first of each bucket with all others, then what may be a link
    assert sum(asked[1:]) < 50, asked


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    got = sorted((r["doc_id"], r["idx"]) for r in P.repeated_paragraphs(docs).where("removed").collect())
    assert got == slow(rows) and got


def test_passages_inside_lines_and_over_short_lines(spark):
    """Every run of 50 words that an earlier text holds loses words, and only words that stand elsewhere."""
    rng = random.Random(21)
    made = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    inline, spread = made(60), made(60)
    short = lambda words: "\n".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7))
    rows = []
    for i in range(12):
        rows.append((i, " ".join(made(40 + i) + inline + made(70 - i))))
        rows.append((100 + i, short(made(15 + i) + spread + made(20))))
    rows += [(200, " ".join(made(300))), (201, ""), (202, None), (203, "again " * 300), (204, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.paragraph_report(df).collect()}
    assert len(got) == len(rows) and not any(r["n_removed"] for r in got.values())
    for i in range(12):
        for doc, at in ((i, 40 + i), (100 + i, 15 + i)):
            spans = [(p["first"], p["first"] + p["n_words"]) for p in got[doc]["passages"]]
            assert bool(spans) == (i > 0)
            assert all(at <= a and b <= at + 60 and b - a >= 20 for a, b in spans)
    assert not any(got[d]["passages"] for d in (200, 201, 202, 204))
    # a text that repeats itself keeps its first words
    assert got[203]["passages"][0]["first"] >= 20


def test_words_of_passages(monkeypatch):
    """Words are hashed alike in one buffer, many or parts of a long text."""
    texts = [b"", b"  a b\tc\n", "\u00e9 x".encode(), b"word " * 50, b"a b c"]
    want = [w.tolist() for w in P._word_hashes(texts)]
    assert [len(w) for w in want] == [0, 3, 2, 50, 3] and want[1] == want[4] and len(set(want[3])) == 1
    monkeypatch.setattr(P, "BUFFER", 9)
    assert [w.tolist() for w in P._word_hashes(texts)] == want


def test_narrow_bands_miss_no_more():
    """A pair of hot buckets meets at least as surely as by the wide bands."""
    for similarity in (0.8, 0.81, 0.82, 0.85, 0.9, 0.95):
        wide = (1 - similarity ** P.BAND_ROWS) ** P.BANDS
        assert (1 - similarity ** P.NARROW_ROWS) ** P.NARROW_BANDS <= wide


def test_bands_of_a_large_batch_are_made_in_parts():
    class Task:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rng = np.random.default_rng(5)
    n, bands = 3_000, P.NARROW_BANDS
    hashes = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * 30, 30, dtype=np.int32)), pa.array(rng.integers(-1 << 62, 1 << 62, n * 30)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n) % 2_900), hashes], ["id", "hashes"])
    run = P._bands(Task(), bands, P.NARROW_ROWS)
    tracemalloc.start()
    ids, made = [], []
    for part in run(iter([batch])):
        assert len(part) <= P.SOME_ROWS
        ids += part.column(0).to_pylist()
        made.append(len(part.column(1).flatten()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(2_900)) and sum(made) == 2_900 * bands
    assert peak < 2_900 * bands * 8


def test_texts_are_cut_into_lines_twice_and_bands_are_those_of_the_lines(spark, monkeypatch):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(40))
    same = line()
    rows = [(1, f"{same}\nshort\n{line()}"), (2, None), (3, same), (None, "short\nlines"), (4, f"{line()}\n{same}\n{same} x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pages = P._pages(docs, "doc_id", "text").orderBy("row_id").collect()
    assert [[p["idx"] for p in r["lines"]] for r in pages] == [[0, 2], [], [0], [], [0, 1, 2]]
    made = [(b["id"], b["buckets"]) for r in pages for b in r["bands"]]
    lines = docs.select(F.explode(P._lines(F.coalesce("text", F.lit("")))).alias("p")).select(P._hashes(F.col("p.words")).alias("hashes"))
    want = P._bands(lines.select(F.xxhash64("hashes").alias("id"), "hashes"), P.BANDS, P.BAND_ROWS).collect()
    # equal lines of a batch once
    assert len(made) == 4 and sorted(made) == sorted((r["id"], r["buckets"]) for r in want)
    cut = []
    real = P.written
    monkeypatch.setattr(P, "written", lambda df, name: cut.append("lower(" in df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    P.paragraph_report(docs).collect()
    assert sum(cut) == 2
