"""Aligned tokenizers against brute force; runs and their merge against a counter."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import alignment, queries, runs
from tests.conftest import SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "A  b", "tab\tand \n line", "two  spaces   and\n\nlines ", "▁ marked", "a▁b", "<|endoftext|> <s>", "<0x0A>",
       "日本 語 text", "naïve café ﬁ 😀 🤖🤖", "x y z", "don't, won't!  (1,234.50)\r\n\x00end", "à b", "the the the", "the the the"]


@pytest.fixture(scope="module")
def slow():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = alignment.byte_level_decoder()

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(byte_of[c] for c in t)) for i, t in ((i, a.id_to_token(i)) for i in a.encode(" " + text, add_special_tokens=False).ids)]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                 for i in b.encode(text)]
        data = (" " + text).encode()
        return (left, right) if b"".join(t for _, t in left) == data == b"".join(t for _, t in right) else ([], [])

    def ends(side):
        at, out = 0, {}
        for k, (i, t) in enumerate(side):
            at += len(t)
            out[at] = (k, i)
        return out

    def run(docs):
        made, count = {}, Counter()
        for doc, text in docs:
            left, right = tokens(text)
            x, y = ends(left), ends(right)
            shared = sorted(set(x) & set(y))
            links = [(x[s][1], y[s][1]) for s in shared]
            count.update(links)
            groups, p, q = [], 0, 0
            for s in shared:
                groups.append(",".join(str(i) for i, _ in left[p:x[s][0] + 1]) + "|" + ",".join(str(i) for i, _ in right[q:y[s][0] + 1]))
                p, q = x[s][0] + 1, y[s][0] + 1
            made[doc] = (len(left), len(right), links, ";".join(groups))
        best = Counter()
        for (_, j), n in count.items():
            best[j] = max(best[j], n)
        return {doc: (n_a, n_b, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                      hashlib.sha256(text.encode()).hexdigest() if n_a else "") for doc, (n_a, n_b, links, text) in made.items()}, count, best
    return run


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, slow):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, SMALL).collect()}
    assert found == slow(docs)[0]


def test_odd_texts_and_many_small_runs(spark, slow):
    docs = list(enumerate(ODD * 3)) + [(1000, "word " * 30_000 + "end"), (1001, "x" * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("chunk"), F.lit(2).alias("n_a"))
    made, count, best = slow(docs)
    got = alignment.align(frame, A, B, chunk_records=10, radix=4, with_groups=True)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == made
    encoded = alignment.encode(frame, A, B, chunk_records=10, radix=4)
    counts = alignment.pair_counts(encoded, 4, fan_in=2)
    assert {(r.a, r.b): (r.n, r.best) for r in alignment.pairs(encoded, counts).collect()} == {
        p: (n, n == best[p[1]]) for p, n in count.items()}
    sums = alignment.contributions(encoded, counts, slice_runs=2).agg(F.sum("count_sum")).first()[0]
    assert sum(m[5] for m in made.values()) == sums


def test_empty_table_and_rows_without_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    rows = spark.createDataFrame([(None, "one"), (None, "one"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in alignment.align(rows, A, B).collect()) == [(0, 1, 2), (0, 1, 2), (1, 0, 0)]


def test_runs_round_trip_and_merge():
    rng = random.Random(1)
    total, made = Counter(), []
    for n in (0, 1, 50, 400, 3000):
        own = Counter((rng.randrange(20), rng.choice([0, 5, 1 << 40]) + rng.randrange(50)) for _ in range(n))
        total.update(own)
        rows = sorted((*k, c) for k, c in own.items())
        columns = [np.array(c, np.uint64) for c in zip(*rows)] or [np.empty(0, np.uint64)] * 3
        data = runs.pack(columns, block=7)
        assert [c.tolist() for c in runs.unpack(data)] == ([c.tolist() for c in columns] if n else [])
        made.append(data)
    out = [tuple(map(int, r)) for part in runs.merge([runs.blocks(d) for d in made]) for r in zip(*part)]
    assert out == sorted((*k, c) for k, c in total.items())


def test_merging_splits_large_partitions(spark):
    rng = random.Random(2)
    total, rows = Counter(), []
    for number in range(9):
        own = Counter(rng.randrange(5000) for _ in range(3000))
        total.update(own)
        columns = [np.array(c, np.uint64) for c in zip(*sorted(own.items()))]
        rows += [(part, number, runs.pack(some)) for part, some in runs.dealt(columns, 1, 2)]
    frame = spark.createDataFrame(rows, "part long, run long, data binary")
    out = runs.merged(frame, 2, 1, fan_in=2, part_bytes=4000).collect()
    assert len(out) == len({r.part for r in out}) > 2
    got = Counter()
    for r in out:
        for k, n in zip(*runs.unpack(bytes(r.data))):
            assert int(k) not in got
            got[int(k)] = int(n)
    assert got == total


def test_a_worker_remembers_no_more_units_than_it_may():
    aligner = alignment.Aligner(A, B, 50)
    texts = [" ".join(f"word{i * 20 + k}" for k in range(20)) for i in range(10)]
    for first in (0, 5):
        # as a task reads them: the texts end before the alignments
        for text, (found, _, _) in zip(texts[first:first + 5], aligner(texts[first:first + 5])):
            assert found == aligner.whole(text)
        assert len(aligner.known) == 50
