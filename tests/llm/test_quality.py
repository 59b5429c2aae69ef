"""Base counts against plain loops; the distance against its formula."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shelfspark.llm import quality as Q
from tests.conftest import SMALL


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, n_words int")
    got = {}
    for r in Q.quality(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc, text, _ in rows:
        r = got[doc][0]
        assert slow(text) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]), text
        assert not (r["base_failed"] and r["kept"])
    assert sum(map(len, got.values())) == len(rows)
    return got


def test_small(spark):
    rng = random.Random(12)
    bits = ["the", "of", "Word", "é", "#", "$$", " ", "\n", "\t", "\x0b", "\x85", "　", "a b c d e ", "line\n", "日本"]
    rows = [(0, None, "en"), (1, "", None), (2, " \n\t", "xx"), (2, " \n\t", "xx"), (None, "one two", "en")]
    rows += [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 80))), rng.choice(["en", "de", None, "xx"])) for i in range(10, 200)]
    check(spark, rows)
    assert Q.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_given_documents(spark):
    got = check(spark, [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])
    rows = [r for held in got.values() for r in held if not r["base_failed"]]
    assert sum(r["kept"] for r in rows) > 0.9 * len(rows)


def test_shouted_text_is_far_from_its_language(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "some", "more", "other", "plain", "words", "here", "to", "is"])
    rows = [(i, " ".join(word() for _ in range(120)) + f" end{i}.", "en") for i in range(40)]
    rows += [(100, " ".join(f"{word().upper()}{i}!!" for i in range(120)), "en")]
    got = {r["doc_id"]: r for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100]["kept"] and not got[100]["base_failed"] and got[100]["char_distance"] > Q.CHAR_LIMIT
    assert got[0]["char_distance"] < 0.2


def test_distance(spark):
    cases = [([1, 2, 3], [1, 2, 3]), ([1, 0], [0, 5]), ([3, 1, 0], [1, 1, 2]), ([0, 0], [1, 1]), ([], [])]
    df = spark.createDataFrame(cases, "p array<long>, q array<long>")
    got = [r["d"] for r in df.select(Q.distance(F.col("p"), F.col("q")).alias("d")).collect()]

    def plain(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)
    assert abs(got[0]) < 1e-7 and got[1] == 1.0 and abs(got[2] - plain(*cases[2])) < 1e-12
    assert got[3] is None
