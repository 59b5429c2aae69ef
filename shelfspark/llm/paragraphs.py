"""Repeated paragraphs: MinHash banding, exact Jaccard of colliding paragraphs, removal by components.
Repeated passages inside lines or over several lines: runs of words from places that the words choose.

A paragraph is a line.  Equal paragraphs (by their lower-cased words) are one vertex, so a
paragraph of a third of all documents is banded once.  The bands are tuned for recall: at a similarity of
0.8 a pair meets in one of 14 bands of 5 with probability 1 - (1 - 0.8 ** 5) ** 14 = 0.996.  A bucket of
very many unlinked paragraphs, such as single edits of one text, is dealt again by 200 bands of 16: there a pair of
0.8 meets with probability 0.997, so no less often than by the wide bands, and one of 0.6 with 0.05 instead of 0.68.

A passage is a run of words of a document, whatever its lines.  Of every PICK_WINDOW places next to each
other the run of RUN_WORDS words with the least hash is picked, so two documents that share
RUN_WORDS + PICK_WINDOW - 1 = 50 words in a row pick an equal run in them.  Equal runs, and equal stretches from one
pick to the end of the next, are removed but for the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import key_filter, link_within_buckets, may_hold, text_or_empty, with_components, written
from shelfspark.llm.repeats import _TABLE, _mixed, _power_tables

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 14
BAND_ROWS = 5
# for members of buckets with very many components: variants of one paragraph that are alike, but not alike enough
NARROW_BANDS = 200
NARROW_ROWS = 16
# shorter paragraphs, such as titles and license lines, are never removed
LEAST_WORDS = 20
SEED = 42
# parities of a paragraph's shingles
SKETCH_BITS = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
# shingles that are hashed at once
BLOCK = 1 << 16
# words of a picked run, and places of which one at least is picked
RUN_WORDS = 20
PICK_WINDOW = 31
# keys that a task holds before it adds them up
HELD_KEYS = 1 << 20
# rows of an Arrow batch that a task works on at once, whatever the session's batches hold
SOME_ROWS = 512
# bytes whose words are hashed at once
BUFFER = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SOME_ROWS rows: what is made of a row is many times as large as the row."""
    for batch in batches:
        for first in range(0, len(batch), SOME_ROWS):
            yield batch.slice(first, SOME_ROWS)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def band_keys(words: pa.ListArray, bands: int = BANDS, band_rows: int = BAND_ROWS, seed: int = SEED) -> pa.ListArray:
    """`bands` keys per list of word hashes; every list has at least SHINGLE_WORDS words.

    The MinHash values of all lists of the batch are taken together, one permutation
    (a product and a sum modulo 2 ** 64, compared by their high bits) at a time.
    """
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.diff(words.offsets.to_numpy())
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * band_rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * band_rows, np.uint64)
    keys = np.zeros((len(lengths), bands), np.uint64)
    first, start = 0, 0
    with np.errstate(over="ignore"):
        while first < len(lengths):
            upto = max(first + 1, int(np.searchsorted(np.cumsum(lengths[first:]), BLOCK)) + first)
            sizes = lengths[first:upto]
            part = flat[start:start + int(sizes.sum())]
            shingles = np.zeros(len(part), np.uint64)
            for k in range(SHINGLE_WORDS):
                shingles = shingles * _BASE
                shingles[: len(part) - k] += part[k:]
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            # runs that leave their list have no place in it
            inside = np.ones(len(part), bool)
            for k in range(1, SHINGLE_WORDS):
                inside[begins + sizes - k] = False
            shingles = shingles[inside]
            shingles ^= shingles >> np.uint64(29)
            counts = sizes - SHINGLE_WORDS + 1
            at = np.concatenate(([0], np.cumsum(counts)[:-1]))
            for band in range(bands):
                key = np.zeros(len(sizes), np.uint64)
                for row in range(band * band_rows, (band + 1) * band_rows):
                    least = np.minimum.reduceat(shingles * factors[row] + shifts[row], at)
                    key = (key ^ least) * _BASE + (key >> np.uint64(31))
                keys[first:upto, band] = key
            first, start = upto, start + len(part)
    offsets = pa.array(np.arange(0, (len(lengths) + 1) * bands, bands, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))


def jaccard(a: str, b: str, words_per_shingle: int = SHINGLE_WORDS) -> float:
    """Share of common word shingles of two texts of words joined by single spaces."""
    def shingles(text):
        words = text.split(" ")
        return {tuple(words[i:i + words_per_shingle]) for i in range(len(words) - words_per_shingle + 1)}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def _word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """A 64-bit hash of each word of each text, many texts at a time; a long text is read in parts that end at white space."""
    def hashed(parts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        bounds = np.cumsum([1] + [len(p) + 1 for p in parts])
        powers, inverses = _power_tables(max(len(data), BUFFER * 2 - 1))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        words = _mixed((sums[ends] - sums[starts]) * inverses[starts])
        return np.split(words, np.searchsorted(starts, bounds[1:-1]))

    held: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for text in texts:
            if held and size + len(text) > BUFFER:
                yield from hashed(held)
                held, size = [], 0
            if len(text) <= BUFFER:
                held.append(text)
                size += len(text)
                continue
            found, start = [], 0
            while start < len(text):
                end = min(start + BUFFER, len(text))
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
                found += hashed([text[start:end]])
                start = end
            yield np.concatenate(found)
        if held:
            yield from hashed(held)


def picked_runs(words: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number of words, key) of the picked runs of a text and of the stretches between two picks, ends included.

    With a filter of the keys that stand in several places, only those runs and the stretches between two of them: a
    stretch that is repeated has repeated ends.
    """
    at, runs, sums = _picks(words)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    keep = np.ones(len(at), bool) if shared is None else may_hold(shared, runs.view(np.int64))
    both = np.flatnonzero(keep[:-1] & keep[1:])
    with np.errstate(over="ignore"):
        _, inverses = _power_tables(max(len(words), BUFFER * 2 - 1))
        begin, end = at[both], at[both + 1] + RUN_WORDS
        sizes = end - begin
        stretches = _mixed((sums[end] - sums[begin]) * inverses[begin] + sizes.astype(np.uint64))
    return (np.concatenate((at[keep], begin)), np.concatenate((np.full(int(keep.sum()), RUN_WORDS), sizes)),
            np.concatenate((runs[keep], stretches)).view(np.int64))


def _picks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, keys) of the picked runs, and the running sums of the words' hashes."""
    n = len(words) - RUN_WORDS + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers, inverses = _power_tables(max(len(words), BUFFER * 2 - 1))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[: len(words)], out=sums[1:])
        runs = _mixed((sums[RUN_WORDS:] - sums[:-RUN_WORDS]) * inverses[:n])
        width = min(PICK_WINDOW, n)
        least = np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1)
        at = np.unique(np.arange(len(least)) + least)
    return at, runs[at], sums


def _shared_runs(docs: DataFrame, text_col: str) -> np.ndarray:
    """A filter of the keys of picked runs that stand in two places or more; a task adds its own up before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            # twice is as good as often
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["key", "n"])

        for batch in _some(batches):
            for words in _word_hashes([t.as_py().lower().encode("utf-8", "surrogatepass") for t in batch.column(0)]):
                held.append(_picks(words)[1])
                size += len(held[-1])
                if size >= HELD_KEYS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "key long, n int")
    return key_filter(written(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "shared-keys"), "key")


def _lines(text: Column) -> Column:
    """(idx, words) of each line of a text with LEAST_WORDS words."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("idx"), _words(line).alias("words")))
    return F.filter(lines, lambda s: F.size(s["words"]) >= LEAST_WORDS)


def _pages(docs: DataFrame, id_col: str, text_col: str, shared: np.ndarray | None = None) -> DataFrame:
    """(row_id, doc_id, lines, bands, runs): one row per row of `docs`, whose texts are cut into lines and hashed once for all three.

    lines: (idx, n_words, pid) of the long lines; bands: (id, buckets) of their kinds, equal lines of a batch once;
    runs: (place, n_words, key) of the picked runs and stretches, with a filter of shared runs those it holds alone.
    """
    line = pa.struct([("idx", pa.int32()), ("n_words", pa.int32()), ("pid", pa.int64())])
    band = pa.struct([("id", pa.int64()), ("buckets", pa.list_(pa.int64()))])
    kind = pa.struct([("place", pa.int32()), ("n_words", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            ends = batch.column(3).offsets.to_numpy()
            each = batch.column(3).flatten()
            lines = pa.StructArray.from_arrays([each.field(name) for name in ("idx", "n_words", "pid")], fields=list(line))
            line_ends = pa.array(ends - ends[0])
            _, first = np.unique(each.field("pid").to_numpy(), return_index=True)
            first.sort()
            buckets = _buckets(each.field("hashes").take(pa.array(first)), BANDS, BAND_ROWS)
            bands = pa.StructArray.from_arrays([each.field("pid").take(pa.array(first)), buckets], fields=list(band))
            band_ends = np.searchsorted(first, ends - ends[0]).astype(np.int32)
            texts = [t.as_py().lower().encode("utf-8", "surrogatepass") for t in batch.column(2)]
            made = [picked_runs(words, shared) for words in _word_hashes(texts)]
            place, n_words, key = (np.concatenate([m[k] for m in made]) if made else np.empty(0, np.int64) for k in range(3))
            runs = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(n_words, pa.int32()), pa.array(key, pa.int64())],
                                              fields=list(kind))
            run_ends = np.concatenate(([0], np.cumsum([len(m[0]) for m in made]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(line_ends, lines),
                                              pa.ListArray.from_arrays(pa.array(band_ends), bands),
                                              pa.ListArray.from_arrays(pa.array(run_ends), runs)], ["row_id", "doc_id", "lines", "bands", "runs"])

    hashed = F.transform(_lines(F.col("text")), lambda s: F.struct(s["idx"].alias("idx"), _hashes(s["words"]).alias("hashes")))
    lines = F.transform(hashed, lambda s: F.struct(
        s["idx"].alias("idx"), F.size(s["hashes"]).alias("n_words"), F.xxhash64(s["hashes"]).alias("pid"), s["hashes"].alias("hashes")))
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
                           text_or_empty(text_col).alias("text"))
    return written(numbered.select("row_id", "doc_id", "text", lines.alias("lines")).mapInArrow(
        run, "row_id long, doc_id long, lines array<struct<idx:int,n_words:int,pid:long>>, "
             "bands array<struct<id:long,buckets:array<long>>>, runs array<struct<place:int,n_words:int,key:long>>"), "paragraphs")


def _buckets(hashes: pa.ListArray, bands: int, band_rows: int) -> pa.ListArray:
    """A number for each band of each list of hashes."""
    keys = band_keys(hashes, bands, band_rows)
    with np.errstate(over="ignore"):
        flat = keys.values.to_numpy().view(np.uint64).reshape(-1, bands) + np.arange(bands, dtype=np.uint64) * _BASE
        return pa.ListArray.from_arrays(keys.offsets, pa.array(_mixed(flat).view(np.int64).ravel()))


def _bands(texts: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """(id, buckets): a number for each band of texts(id, hashes); equal texts of a batch once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            for some in _some([batch.take(pa.array(first))]):
                yield pa.RecordBatch.from_arrays([some.column(0), _buckets(some.column(1), bands, band_rows)], ["id", "buckets"])

    return texts.mapInArrow(run, "id long, buckets array<long>")


def _members(banded: DataFrame, bands: int) -> DataFrame:
    """(bucket, id): the ids of banded(id, buckets) in those buckets that hold several.

    `banded` is a written table.  Buckets are counted without their texts; then only rows of shared buckets are made.
    """
    # two texts differ in the low half of their hashes too, but for one pair in 2 ** 32
    each = banded.select(F.explode("buckets").alias("bucket"), F.col("id").bitwiseAND(0xFFFFFFFF).alias("part"))
    several = each.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("bucket")
    shared = key_filter(written(several, "shared-buckets"), "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            flat = batch.column(1).flatten().to_numpy()
            keep = may_hold(shared, flat)
            owner = np.repeat(batch.column(0).to_numpy(), bands)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(owner)], ["bucket", "id"])

    return banded.select("id", "buckets").mapInArrow(run, "bucket long, id long").distinct()


def _sketched(texts: DataFrame) -> DataFrame:
    """texts(id, words) with `sketch`: the number of distinct shingles, and SKETCH_BITS parities of how many lie at each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            n, bits = [], []
            # hashes of whole words, so that equal shingles are equal numbers and cancel out between two texts
            for words in batch.column(2):
                words = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                made = np.zeros(len(words) - SHINGLE_WORDS + 1, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(SHINGLE_WORDS):
                        made = made * _BASE + words[k:len(words) - SHINGLE_WORDS + 1 + k]
                    made = np.unique(_mixed(made))
                counts = np.bincount((made & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
                n.append(len(made))
                bits.append(np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SKETCH_BITS // 64))
            flat = np.concatenate(bits) if bits else np.empty(0, np.int64)
            sketch = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["n", "bits"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sketch], ["id", "words", "sketch"])

    return texts.select("id", "words", _hashes(F.split("words", " ")).alias("hashes")) \
        .mapInArrow(run, "id long, words string, sketch struct<n:int,bits:array<long>>")


def may_be_alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sketches can be of texts with so high a Jaccard similarity.

    Two sets differ in at least as many shingles as parities; of the sum of their sizes the share (1 - similarity) / (1 + similarity) may differ.
    """
    differ = reduce(Column.__add__, [F.bit_count(F.get(x["bits"], F.lit(i)).bitwiseXOR(F.get(y["bits"], F.lit(i)))) for i in range(SKETCH_BITS // 64)])
    return differ * (1 + similarity) <= (x["n"] + y["n"]) * (1 - similarity) + 1e-6


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        similarity: float = SIMILARITY) -> DataFrame:
    """(row_id, doc_id, idx, n_words, component_id, removed): one row per long paragraph of every row of `docs`.

    Paragraphs are linked that have one sequence of words (A-Z and a-z alike), or share
    at least `similarity` of their shingles; a component's first paragraph, by (doc_id, row, line), stays.
    idx counts lines from 0.  A document without long paragraphs (null or empty texts too)
    gives one row whose idx is null.  Rows without a doc_id stand before all others.
    """
    return _removed_lines(_pages(docs, id_col, text_col), docs, text_col, similarity)


def _removed_lines(pages: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    rows = pages.select("row_id", "doc_id", F.explode("lines").alias("p")).select("row_id", "doc_id", "p.*")
    words = docs.select(F.explode(_lines(text_or_empty(text_col))).alias("p")).select("p.words")
    texts = words.select(F.xxhash64(_hashes(F.col("words"))).alias("id"), F.concat_ws(" ", "words").alias("words"))
    members = _members(pages.select(F.explode("bands").alias("b")).select("b.id", "b.buckets"), BANDS)
    held: list[DataFrame] = []

    def prepare(ids: DataFrame) -> None:
        """The words of one paragraph of each colliding kind; a filter lets few others move."""
        ids = written(ids, "colliding")
        bits = key_filter(ids, "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_hold(bits, batch.column(0).to_numpy())))

        some = texts.select("id", "words").mapInArrow(run, "id long, words string").join(ids, "id", "left_semi")
        one = some.groupBy("id").agg(F.first("words").alias("words"))
        held.append(written(_sketched(one), "colliding-texts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            same = [jaccard(x, y) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        x = held[0].select(F.col("id").alias("a"), F.col("words").alias("x"))
        y = held[0].select(F.col("id").alias("b"), F.col("words").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    def narrow(ids: DataFrame) -> DataFrame:
        some = held[0].join(ids, "id", "left_semi")
        hashed = some.select("id", _hashes(F.split("words", " ")).alias("hashes"))
        return _members(written(_bands(hashed, NARROW_BANDS, NARROW_ROWS), "bands"), NARROW_BANDS)

    roots = link_within_buckets(members, verified, prepare, narrow, lambda: held[0].select("id", "sketch"),
                                lambda x, y: may_be_alike(x, y, similarity))
    placed = written(with_components(rows, roots, "pid"), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct("doc_id", "row_id", "idx")).alias("first"))
    marked = placed.join(first, "root").select(
        "row_id", "doc_id", "idx", "n_words", F.col("root").alias("component_id"),
        (F.struct("row_id", "idx") != F.struct("first.row_id", "first.idx")).alias("removed"))
    none = pages.where(F.size("lines") == 0).select(
        "row_id", "doc_id", F.lit(None).cast("int").alias("idx"), F.lit(0).alias("n_words"),
        F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("removed"))
    return marked.unionByName(none)


def _removed_passages(pages: DataFrame) -> DataFrame:
    """(row_id, passages): runs of words (first, n_words) that repeat an earlier one, by (doc_id, row, place)."""
    runs = pages.select("row_id", "doc_id", F.explode("runs").alias("r")).select("row_id", "doc_id", "r.*")
    shared = runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(runs.join(shared, "key"), "shared-runs")
    first = shared.groupBy("key").agg(F.min(F.struct("doc_id", "row_id", "place")).alias("first"))
    # a run that overlaps the first one in its own document is a part of what stays
    again = shared.join(first, "key").where(
        (F.col("row_id") != F.col("first.row_id")) | (F.col("place") >= F.col("first.place") + F.col("n_words")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            made = []
            for items in batch.column(1).to_pylist():
                spans: list[list[int]] = []
                for place, end in sorted((r["place"], r["place"] + r["n_words"]) for r in items):
                    if spans and place <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([place, end])
                made.append([{"first": a, "n_words": b - a} for a, b in spans])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("n_words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["row_id", "passages"])

    return (again.groupBy("row_id").agg(F.collect_list(F.struct("place", "n_words")).alias("found"))
            .mapInArrow(merge, "row_id long, passages array<struct<first:int,n_words:int>>"))


def paragraph_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_paragraphs, n_removed, removed, components, passages), one row per row of `docs`.

    removed: the lines to remove; components: of the document's long paragraphs, in order of their lines;
    passages: the words (first, n_words) to remove, counted from 0 over all lines, long or short.
    """
    pages = _pages(docs, id_col, text_col, _shared_runs(docs, text_col))
    found = _removed_lines(pages, docs, text_col, similarity)
    listed = F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "component_id", "removed"))))
    rows = found.groupBy("row_id", "doc_id").agg(listed.alias("p"))
    return rows.join(_removed_passages(pages), "row_id", "left").select(
        "doc_id", F.size("p").cast("long").alias("n_paragraphs"),
        F.size(F.filter("p", lambda s: s["removed"])).cast("long").alias("n_removed"),
        F.transform(F.filter("p", lambda s: s["removed"]), lambda s: s["idx"]).alias("removed"),
        F.transform("p", lambda s: s["component_id"]).alias("components"),
        F.coalesce("passages", F.array().cast("array<struct<first:int,n_words:int>>")).alias("passages"))
