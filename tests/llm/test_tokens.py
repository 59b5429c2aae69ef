"""Round trips: shards against plain encoding of every text, Elias-Fano against its input."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfspark.llm import tokens as T
from shelfspark.session import scratch_path
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_elias_fano():
    rng = random.Random(2)
    for n, top in ((1, 0), (1, 10), (5, 5), (300, 40), (1000, 10**9), (64, 64)):
        values = np.sort([rng.randint(0, top) for _ in range(n)])
        code = T.EliasFano.encode(values)
        ef = T.EliasFano(n, *code)
        assert ef.all().tolist() == values.tolist()
        assert [ef.select(i) for i in range(n)] == values.tolist()
        assert len(code[1]) + len(code[2]) <= n * (2 + np.log2(max(top, n) / n + 1)) / 8 + 17


def test_words_are_encoded_as_in_their_text():
    plain = Tokenizer.from_file(PATH)
    encoder = T.WordEncoder(PATH, 2)
    rng = random.Random(4)
    bits = ["a", "Word", " ", "  ", "\n", "\t", "é", "ß", "1", "99", ".", "'s", "'", "<|endoftext|>", "-", "日本", " ", " ", "x", "The", "\x1c", "\x85"]
    texts = ["", " ", "  a", "a  b", " \n b", "a\n b\n\nc", "don't 's t's", "a <|endoftext|> b<|endoftext|>c", " lead", "trail "]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    latin = [chr(c) for c in range(0x250)] + [" "] * 150 + list("aB1'") * 20
    texts += ["".join(rng.choice(latin) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    # without the characters that make a text odd, so that every class of letter is cut
    texts += ["".join(c for c in t if c in "\t\n\r" or ord(c) >= 0x20 and not 0x7f <= ord(c) < 0xa0) for t in texts[-4000:]]
    for first in range(0, len(texts), 100):
        some = texts[first:first + 100]
        made = [np.frombuffer(b, "<u2").tolist() for b in encoder(some)]
        assert made == [plain.encode(t, add_special_tokens=False).ids for t in some]


def test_shards(spark, monkeypatch):
    rows = [(5, "five words are in here", 1), (2, None, 2), (3, "", 3), (3, "again " * 50, 4), (None, "no id", 5), (-7, "below zero", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = scratch_path(spark, "shards")
    T.write_shards(df, PATH, out, parts=3)
    plain = Tokenizer.from_file(PATH)
    got = T.read_documents(spark, out, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -7, 2, 3, 3, 5]
    want = sorted((d is not None, d or 0, plain.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        at += r["n_tokens"]
    empty = scratch_path(spark, "shards")
    T.write_shards(df.limit(0), PATH, empty)
    assert T.read_documents(spark, empty).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = scratch_path(spark, "shards")
    T.write_shards(docs, PATH, out)
    plain = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.read_documents(spark, out).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = plain.encode(r["text"], add_special_tokens=False).ids + [0]
        assert got[r["doc_id"]] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
