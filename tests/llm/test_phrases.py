"""Phrases against brute force; tries against a counter, spilling and bursting."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import phrases
from tests.conftest import SMALL


def slow(docs, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    f = {k: c for k, c in f.items() if c >= least}
    covers = Counter()
    for (lang, key), c in f.items():
        for size in range(2, len(key)):
            for i in range(len(key) - size + 1):
                covers[lang, key[i:i + size]] = max(covers[lang, key[i:i + size]], c)
    rows = []
    for (lang, key), a in f.items():
        if len(key) > 1 and not 100 * covers[lang, key] >= 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, key[:k]] + f[lang, key[k:]]), k, f[lang, key[:k]], f[lang, key[k:]])
                                 for k in range(1, len(key)))
            rows.append((lang, -score, -a, " ".join(key).encode(), l, r))
    out, ranks = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.add((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def found(frame, **options):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = phrases.phrases(frame, **options).select(columns).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_table_equals_brute_force(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r.lang, r.text) for r in frame.collect()]
    assert found(frame) == slow(docs)


def test_spills_ties_nulls_and_long_texts(spark):
    rng = random.Random(4)
    words = ["Al", "be", "ce", "über", "e\x0bf", "g'h", "日本"] + [f"w{i}" for i in range(30)]
    def text(size):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(size))
    docs = [(rng.choice(["en", "de", None, "und"]), text(rng.randrange(80))) for _ in range(400)] + [("en", None), ("fr", ""), (None, None), ("en", text(30_000))]
    docs += [("fr", "the same line")] * 40
    frame = spark.createDataFrame(docs, "lang string, text string").select("*", *[F.lit(1).alias(c) for c in ("key", "id", "f", "n", "score")]).repartition(3)
    assert found(frame, least=5, top=25, limit=200, fan_in=2) == slow(docs, 5, 25)
    assert found(frame.limit(0)) == set()


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER", 64)
    text = ("one two three. " * 40 + "x" * 300 + " four five").encode()
    parts = list(phrases._cut(text))
    assert b"".join(parts) == text and len(parts) > 3 and all(phrases._KIND[p[0]] == 2 for p in parts[1:])


def test_trie_counts_bursts_and_spills_subtrees():
    rng = np.random.default_rng(6)
    trie, total = phrases.HatTrie(3, burst=8, limit=300), Counter()
    out = Counter()
    for _ in range(40):
        words = rng.zipf(1.3, (200, 3)) % 40
        keys = (words[:, 0].astype(np.uint64) << np.uint64(32)) | (words[:, 1].astype(np.uint64) << np.uint64(16)) | words[:, 2].astype(np.uint64)
        total.update(keys.tolist())
        trie.add(*np.unique(keys, return_counts=True))
        if trie.full():
            assert any(isinstance(node, tuple) for node in trie.root.values())
            before = sum(trie.sizes.values())
            spilled = dict(zip(*map(np.ndarray.tolist, trie.spill(150))))
            assert sum(trie.sizes.values()) <= 150 and len(spilled) == before - sum(trie.sizes.values())
            out.update(spilled)
    out.update(dict(zip(*map(np.ndarray.tolist, trie.spill()))))
    assert out == total and not trie.root
