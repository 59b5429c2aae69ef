"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the terms i that a text holds.
Terms are a text's words and the beginnings of words, hashed into 2 ** 24 places.  Of
these the places enter the model whose document counts in the training sample differ
between the classes by more than chance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_PLACES = 1 << 24
PREFIXES = (4, 5, 6, 7)
# labelled rows that the model is fitted on, as an expectation of the hash sample
TRAINING_ROWS = 20_000
MAX_FEATURES = 4096
LEAST_Z = 4.0
LEAST_DOCS = 5
RANK = 4
EPOCHS = 30
LEARNING_RATE = 0.05
L2 = 1e-4
SEED = 42
CHUNK_CHARS = 1 << 20
CACHED_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class FactorizationMachine:
    features: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return 1 / (1 + np.exp(-_raw(self.bias, self.weights, self.factors, at.astype(np.int64), owner, len(rows))[0]))


def _raw(bias, weights, factors, at, owner, n):
    linear = np.bincount(owner, weights[at], n) if len(at) else np.zeros(n)
    sums = np.zeros((n, factors.shape[1]))
    squares = np.zeros(n)
    if len(at):
        v = factors[at]
        for f in range(factors.shape[1]):
            sums[:, f] = np.bincount(owner, v[:, f], n)
        squares = np.bincount(owner, (v * v).sum(axis=1), n)
    return np.clip(bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), -30, 30), sums


def term_places(word: str) -> list[int]:
    """Hash places of a word: the whole word and its beginnings."""
    terms = [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) % HASH_PLACES for t in terms]


def distinct_words(text: str | None) -> set[str]:
    """Lower-cased words of the whole text; a long text is read in runs that end at white space."""
    words: set[str] = set()
    text = text or ""
    start = 0
    while start < len(text):
        end = min(start + CHUNK_CHARS, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        words.update(_WORD.findall(text[start:end].lower()))
        start = end
    return words


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, label) of a hash sample of about `rows` labelled rows that are not held out.

    Rows whose label or id is null are not used; of several labels of one id the largest counts.
    """
    usable = (labels.where("toxic is not null and doc_id is not null").where(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    total = usable.count()
    share = min(1.0, rows / max(total, 1))
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about `rows` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")


def class_counts(rows: DataFrame) -> DataFrame:
    """(place, toxic, clean): training texts of each class that hold a term of the place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            for label, chunks in held.items():
                places, n = np.unique(np.concatenate(chunks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.full(len(places), label)), pa.array(n)],
                                                 ["place", "label", "n"])
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                places = {p for w in distinct_words(text.as_py()) for p in term_places(w)}
                held.setdefault(label.as_py(), []).append(np.fromiter(places, np.int64, len(places)))
                size += len(places)
                if size > 4_000_000:
                    yield from packed()
                    held, size = {}, 0
        yield from packed()

    counts = rows.select("text", "label").mapInArrow(run, "place long, label long, n long")
    return counts.groupBy("place").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("clean"))


def features_of(words: set[str], features: dict[int, int], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    found: set[int] = set()
    for word in words:
        known = cache.get(word)
        if known is None:
            known = tuple({features[p] for p in term_places(word) if p in features})
            if len(cache) < CACHED_WORDS:
                cache[word] = known
        if known:
            found.update(known)
    return np.fromiter(sorted(found), np.int64, len(found))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> FactorizationMachine:
    """A model of `labels.toxic`, fitted on a bounded hash sample of the labelled rows.

    Without usable labels, or with one class only, the score is that class's share
    (0.0 without labels).  What comes to the driver is bounded by `rows` and
    MAX_FEATURES, not by the tables.
    """
    train = training_rows(docs, labels, rows)
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sum(n for label, n in sizes.items() if label != 1)
    prior = math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -30.0
    empty = FactorizationMachine({}, prior, np.zeros(1), np.zeros((1, RANK)))
    if not toxic or not clean:
        return empty
    p = (F.col("toxic") + F.col("clean")) / F.lit(toxic + clean)
    z = ((F.col("toxic") / F.lit(toxic) - F.col("clean") / F.lit(clean))
         / F.sqrt(p * (1 - p) * F.lit(1 / toxic + 1 / clean)))
    best = (class_counts(train).where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("z", z)
            .where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "place").limit(MAX_FEATURES))
    features = {r["place"]: at for at, r in enumerate(best.select("place").collect())}
    if not features:
        return empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [features_of(distinct_words(t.as_py()), features, cache).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64()))],
                                             ["doc_id", "label", "found"])

    sample = train.select("doc_id", "text", F.col("label").cast("long").alias("label")) \
        .mapInArrow(run, "doc_id long, label long, found array<long>").toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    return _train(features, [np.asarray(f, np.int64) for f in sample["found"]],
                  (sample["label"].to_numpy() == 1).astype(float), prior)


def _train(features, rows, labels, prior) -> FactorizationMachine:
    """Minibatch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(SEED)
    k = len(features)
    bias, weights, factors = prior, np.zeros(k), rng.normal(0, 0.01, (k, RANK))
    g_bias, g_weights, g_factors = 1e-8, np.full(k, 1e-8), np.full((k, RANK), 1e-8)
    lengths = np.array([len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.concatenate(rows)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), 256):
            part = order[first:first + 256]
            owner = np.repeat(np.arange(len(part)), lengths[part])
            at = np.concatenate([flat[starts[i]:starts[i + 1]] for i in part])
            raw, sums = _raw(bias, weights, factors, at, owner, len(part))
            error = (1 / (1 + np.exp(-raw)) - labels[part]) / len(part)
            used, slot = np.unique(at, return_inverse=True)
            grad_w = np.bincount(slot, error[owner], len(used)) + L2 * weights[used]
            pull = error[owner][:, None] * (sums[owner] - factors[at])
            grad_v = np.stack([np.bincount(slot, pull[:, f], len(used)) for f in range(RANK)], axis=1) + L2 * factors[used]
            grad_b = error.sum()
            g_bias += grad_b * grad_b
            g_weights[used] += grad_w * grad_w
            g_factors[used] += grad_v * grad_v
            bias -= LEARNING_RATE * grad_b / math.sqrt(g_bias)
            weights[used] -= 4 * LEARNING_RATE * grad_w / np.sqrt(g_weights[used])
            factors[used] -= LEARNING_RATE * grad_v / np.sqrt(g_factors[used])
    return FactorizationMachine(features, float(bias), weights, factors)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`.

    Only the text is read for the score.  Null and empty texts hold no term and get
    the bias alone.  A row without an id counts as held out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [features_of(distinct_words(t.as_py()), model.features, cache) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(found))], ["doc_id", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def without_toxic(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows of `docs` whose own text scores below 0.5, with all their columns."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            # a few rows at a time, as kept texts are copied
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [features_of(distinct_words(t.as_py()), model.features, cache) for t in part.column(place)]
                yield part.filter(pa.array(model.scores(found) < 0.5))

    return docs.mapInArrow(run, docs.schema)
