"""Spans against Python's re with the base patterns, checksums against plain loops."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from shelfspark.llm import pii
from tests.conftest import SMALL

# The base patterns, in order.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(kind, m.start(), m.end()) for kind, pattern in BASE.items() for m in re.finditer(pattern, text or "")
            if valid(kind, m.group())]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kind int")
    got = {}
    for r in pii.report(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc, text in rows:
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[doc][0]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text, r["spans"], joined)
        assert ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in BASE) == joined
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
    return got


def test_base_spans(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "x.y+z@q-w.co.uk", "@", ".", "..", "a_d@e.f", "1.2.3.4", "255.255.255.256", "001.2.3.4.5", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "5500000000000004", "+1 (234) 567-8901", "+49 30 123456", "+", "-", " ", "é", "日", "\x01", "\x02", "7", "42",
            "99 ", "\n", "word ", "b.c@", "%"]
    rows = [(0, None), (1, ""), (2, "a@b.c_d@e.f g@h"), (3, "a@b@c.d"), (4, "x@y..z a@b.c.")]
    rows += [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(10, 400)]
    check(spark, rows)


def test_given_documents(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])


def test_long_texts(spark):
    """Neither deep recursion nor a search that starts again at every character."""
    n = 200_000
    rows = [(1, "1 " * n), (2, "a." * n + "@"), (3, "a@" + "b." * n + "c"), (4, "9" * n), (5, "+1" + "2" * n), (6, "1.2." * n), (7, "x" * n + "@y.z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert got[3]["n_email"] == got[7]["n_email"] == 1 and got[6]["n_ip"] == n // 2 and got[4]["n_card"] == 0


def test_method_adds_spans(spark):
    rows = [(1, "bank DE89370400440532013000 ok"), (2, "bank DE89370400440532013001 no"), (3, "GB82 WEST 1234 5698 7654 32."),
            (4, "my ssn is 123-45-6789"), (5, "nothing near 123-45-6789"), (6, "ssn 1123-45-67890"), (7, "example ssn 123-45-6789")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.report(df).collect()}
    assert got[1] == ("iban:5:27", "100") and got[3] == ("iban:0:27", "90") and got[4] == ("ssn:10:21", "50")
    assert [got[i][0] for i in (2, 5, 6, 7)] == [""] * 4
    assert pii.report(df.limit(0)).count() == 0


def test_checksums(spark):
    rng = random.Random(4)
    digits = ["".join(rng.choice("0123456789") for _ in range(rng.randint(13, 19))) for _ in range(300)]
    df = spark.createDataFrame([(d,) for d in digits], "d string")
    assert all(r["ok"] == plain_luhn(r["d"]) for r in df.select("d", pii.luhn(F.col("d")).alias("ok")).collect())
    texts = ["".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.randint(5, 34))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["m"] == int("".join(str(int(c, 36)) for c in r["t"])) % 97 for r in df.select("t", pii.mod97(F.col("t")).alias("m")).collect())
