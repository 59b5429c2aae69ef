"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on seeds, runs of five equal tokens.  A pair whose
seeds could cover enough of the item is tiled: the longest common runs of unmarked tokens are
found by running Karp-Rabin hashes, marked, and searched again with shorter lengths.
Tiles need no order, so a passage whose sentences were moved is still covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import word_runs, written

SEED_TOKENS = 5
LEAST_COVERAGE = 0.5
# text of the items up to which their seeds go to every task; beyond, documents' seeds are shuffled
BROADCAST_BYTES = 16 << 20
_DROPPED = b".,;:!?\"'()[]"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MERSENNE = (1 << 61) - 1
_RADIX = 1_000_003


def token_runs(text: str | None) -> Iterator[list[bytes]]:
    """Tokens of a text: words without their punctuation, A-Z lower-cased."""
    for run in word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        yield b" ".join(run).translate(None, _DROPPED).split()


def token_hash(word: bytes) -> int:
    """A nonzero signed 64-bit number of a token."""
    return (xxhash.xxh64_intdigest(word) | 1) - (1 << 63)


def seed_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of every run of SEED_TOKENS tokens."""
    n = len(tokens) - SEED_TOKENS + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        unsigned = tokens.view(np.uint64)
        with np.errstate(over="ignore"):
            for at in range(SEED_TOKENS):
                out = out * _BASE + unsigned[at:at + n]
    return out.view(np.int64)


def benchmark_tokens(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens): one row per item with an id and at least SEED_TOKENS tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[token_hash(w) for run in token_runs(t.as_py()) for w in run] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["item_id", "tokens"])

    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .where("item_id is not null").mapInArrow(run, "item_id long, tokens array<long>")
            .where(F.size("tokens") >= SEED_TOKENS))


def seeds_of(rows: DataFrame, keys: str, kinds: str) -> DataFrame:
    """(keys..., seed): a row per run of SEED_TOKENS tokens; with `places`, only over adjacent places."""
    names = keys.split(",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = np.asarray(batch.column("tokens")[row].values, np.int64)
                seeds = seed_hashes(tokens)
                at = np.arange(len(seeds))
                if "places" in batch.schema.names and len(seeds):
                    places = np.asarray(batch.column("places")[row].values, np.int64)
                    at = at[places[SEED_TOKENS - 1:] - places[:len(seeds)] == SEED_TOKENS - 1]
                held = [pa.array([batch.column(k)[row].as_py()] * len(at), batch.column(k).type) for k in names]
                yield pa.RecordBatch.from_arrays([*held, pa.array(at), pa.array(seeds[at])], [*names, "at", "seed"])

    return rows.mapInArrow(run, f"{kinds}, at long, seed long")


def document_tokens(docs: DataFrame, words: dict[bytes, int] | None, seeds: np.ndarray | None) -> DataFrame:
    """(row_id, doc_id, places, tokens): the tokens of each document that a seed of the benchmark may cover.

    Without `words` and `seeds`, all tokens.  A tile is made of seeds, so nothing else
    can take part in a match.
    """
    def places_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found_at, found = [], []
        tail, start = np.empty(0, np.int64), 0
        for run in token_runs(text):
            if words is None:
                found_at.append(np.arange(start, start + len(run)))
                found.append(np.fromiter(map(token_hash, run), np.int64, len(run)))
                start += len(run)
                continue
            get = words.get
            tokens = np.concatenate((tail, np.fromiter([get(w, 0) for w in run], np.int64, len(run))))
            known = np.concatenate(([0], np.cumsum(tokens != 0)))
            n = len(tokens) - SEED_TOKENS + 1
            if n > 0:
                full = np.flatnonzero(known[SEED_TOKENS:] - known[:n] == SEED_TOKENS)
                if len(full):
                    hashes = seed_hashes(tokens)[full]
                    slot = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
                    hits = full[seeds[slot] == hashes]
                    covered = np.unique((hits[:, None] + np.arange(SEED_TOKENS)).ravel())
                    found_at.append(covered + start - len(tail))
                    found.append(tokens[covered])
            start += len(run)
            tail = tokens[max(0, len(tokens) - SEED_TOKENS + 1):]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, first = np.unique(np.concatenate(found_at), return_index=True)
        return at, np.concatenate(found)[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            made = [places_of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p for p, _ in made], kind), pa.array([t for _, t in made], kind)],
                ["row_id", "doc_id", "places", "tokens"])

    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "row_id long, doc_id long, places array<long>, tokens array<long>")


def tiles(text: list[int], item: list[int], least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length) of non-overlapping tiles.

    Both lists hold token numbers, 0 where a token takes no part.  Search lengths start at the item's
    length and halve down to `least`; of each length the longest tiles are marked first.
    """
    free_text, free_item = [t != 0 for t in text], [t != 0 for t in item]
    made = []
    length = max(len(item), least)
    while True:
        matches = _matches(text, item, free_text, free_item, length)
        for size, t, p in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            # of a match that an earlier tile cut, the free beginning is still a tile
            free = 0
            while free < size and free_text[t + free] and free_item[p + free]:
                free += 1
            if free >= length:
                free_text[t:t + free] = [False] * free
                free_item[p:p + free] = [False] * free
                made.append((t, p, free))
        # what the marks have cut may hold shorter tiles; search them at this length until none is left
        if matches and _matches(text, item, free_text, free_item, length):
            continue
        if length == least:
            return made
        length = max(least, length // 2)


def _rolling(tokens: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of `length` free tokens."""
    top = pow(_RADIX, length, _MERSENNE)
    value = run = 0
    for at, token in enumerate(tokens):
        if not free[at]:
            value = run = 0
            continue
        value = (value * _RADIX + token) % _MERSENNE
        run += 1
        if run > length:
            value = (value - tokens[at - length] * top) % _MERSENNE
        if run >= length:
            yield at - length + 1, value


def _matches(text, item, free_text, free_item, length) -> list[tuple[int, int, int]]:
    """(length, start in text, start in item) of matches of at least `length` that cannot grow to the left."""
    table: dict[int, list[int]] = {}
    for p, value in _rolling(item, free_item, length):
        table.setdefault(value, []).append(p)
    found = []
    for t, value in _rolling(text, free_text, length):
        for p in table.get(value, ()):
            if t and p and free_text[t - 1] and free_item[p - 1] and text[t - 1] == item[p - 1]:
                continue
            size = 0
            while (t + size < len(text) and p + size < len(item) and free_text[t + size] and free_item[p + size]
                   and text[t + size] == item[p + size]):
                size += 1
            if size >= length:
                found.append((size, t, p))
    return found


def spaced(places: np.ndarray, tokens: np.ndarray) -> list[int]:
    """The tokens in order with one 0 for every gap between places."""
    out: list[int] = []
    last = None
    for place, token in zip(places.tolist(), tokens.tolist()):
        if last is not None and place != last + 1:
            out.append(0)
        out.append(token)
        last = place
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least_coverage: float = LEAST_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(rows, matches) of `docs` against the items of `benchmark`.

    rows(row_id, doc_id): every row of `docs`.  matches(row_id, item_id, coverage): pairs
    whose tiles cover at least `least_coverage` of the item's tokens.  Null or empty texts
    match nothing; items without an id or with fewer than SEED_TOKENS tokens are not searched.
    Equal items each give a match.
    """
    items = written(benchmark_tokens(benchmark), "items")
    seeds = written(seeds_of(items, "item_id", "item_id long").withColumnRenamed("at", "item_at"), "seeds")
    size = items.agg(F.coalesce(F.sum(F.size("tokens") * 8), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        # both are bounded by the size just counted
        known = np.array(sorted({r[0] for r in seeds.select("seed").distinct().collect()}), np.int64)
        words = {w: token_hash(w) for r in benchmark.where("item_id is not null").select(F.col("text").cast("string")).collect()
                 for run in token_runs(r[0]) for w in run} if len(known) else {}
        tokens = document_tokens(docs, words if len(known) else {}, known if len(known) else np.array([0], np.int64))
    else:
        tokens = document_tokens(docs, None, None)
    tokens = written(tokens, "document-tokens")
    held = tokens.where(F.size("tokens") >= SEED_TOKENS)
    doc_seeds = seeds_of(held.select("row_id", "places", "tokens"), "row_id", "row_id long").select("row_id", "seed").distinct()
    sizes = items.select("item_id", F.size("tokens").alias("n"))
    # a seed at an item's place covers SEED_TOKENS of its places
    covered = (doc_seeds.join(seeds, "seed").select("row_id", "item_id", "item_at").distinct()
               .groupBy("row_id", "item_id").agg(F.count("*").alias("places")))
    pairs = (covered.join(sizes, "item_id")
             .where(F.least(F.col("places") * SEED_TOKENS, F.col("n")) >= F.col("n") * least_coverage)
             .select("row_id", "item_id"))
    pairs = written(pairs, "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for row in range(batch.num_rows):
                text = spaced(np.asarray(batch.column(2)[row].values, np.int64), np.asarray(batch.column(3)[row].values, np.int64))
                item = batch.column(4)[row].as_py()
                share.append(sum(size for _, _, size in tiles(text, item)) / len(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())],
                                             ["row_id", "item_id", "coverage"])

    matches = (pairs.join(held, "row_id").join(items.withColumnRenamed("tokens", "item"), "item_id")
               .select("row_id", "item_id", "places", "tokens", "item")
               .mapInArrow(run, "row_id long, item_id long, coverage double")
               .where(F.col("coverage") >= least_coverage))
    return tokens.select("row_id", "doc_id"), matches


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, coverage): one row per row of `docs`."""
    rows, matches = contamination(docs, benchmark)
    found = matches.groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"),
                                          F.max("coverage").alias("coverage"))
    return rows.join(found, "row_id", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that no item contaminates; equal texts share the verdict, rows without a doc_id too."""
    numbered = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    rows, matches = contamination(numbered, benchmark)
    bad = rows.join(matches.select("row_id").distinct(), "row_id").select("doc_id").distinct()
    key = F.xxhash64("text")
    return docs.join(bad.select(F.col("doc_id").alias("_bad")), key == F.col("_bad"), "left_anti")
