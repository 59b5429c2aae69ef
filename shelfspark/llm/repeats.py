"""Repeated 200-byte strings, by merging shard Burrows-Wheeler transforms.

Sorting every suffix of a corpus in one place is out of reach, so the work is first dealt
out by content.  In each window of 200 bytes the gram of GRAM bytes with the least hash is its
anchor.  Equal windows have equal anchors at equal places, so a window can only be repeated
where its anchor is, and all that bears on an anchor are the bytes around it (its
*context*, 168 before and 200 from its start).

* Anchors that stand in one place only are dropped by counting their hashes.
* Contexts that are equal as a whole need no comparison: all their windows are repeated.
* The different contexts of an anchor are compared by their transforms.  Contexts are
  aligned on the anchor, so the collection's transform is a matrix: column c holds, in
  the order of the suffixes from column c + 1, the byte before each suffix.  A shard of
  contexts makes its own transform.  Shards are merged by refining an interleave: going to the
  left, the bytes are read from the shards' columns in the order of the interleave, and
  the interleave is stably partitioned by them.  The suffixes themselves are not sorted
  again.  Common prefixes follow along: that of two neighbours with one byte is 1 + the
  least of those between them a column before.  Neighbours with 200 or more
  common bytes are a repeated interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty, written

LENGTH = 200
GRAM = 32
LEFT = LENGTH - GRAM
CONTEXT = LEFT + LENGTH
# a byte that UTF-8 never holds stands outside a text, and equals nothing
OUTSIDE = 255
BUFFER = 1 << 20
SHARD_ROWS = 4096
MERGED_ROWS = 1 << 15
# contexts of an anchor beyond which their windows are counted by hashes, so that no task holds a larger group
HOT_CONTEXTS = 20_000
# contexts whose windows are hashed at once
HASHED_ROWS = 512
_RNG = np.random.default_rng(42)
_TABLE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1).bit_length()
    if size not in _powers:
        _powers.clear()
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[size] = (made[0], made[1])
    return _powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def _anchors(data: np.ndarray, segments: list[tuple[int, int, int, int]]):
    """(place, gram hash, context hash) of the anchors of all windows in a buffer.

    segments: (start, end, first window, last window + 1) of each text in the buffer; no
    window leaves its segment.
    """
    n = len(data)
    with np.errstate(over="ignore"):
        powers, inverses = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[:n], out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverses[: n - GRAM + 1])
        # the least hash of a window, the leftmost if several: its place fills the low bits
        low = np.uint64((1 << 24) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width = LEFT + 1
        rows = -(-len(keys) // width) + 1
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        blocks = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        valid = np.zeros(len(keys), bool)
        for _, _, first, last in segments:
            valid[first:last] = True
        starts = np.flatnonzero(valid)
        least = np.minimum(back[starts], ahead[starts + width - 1]) & low
        places = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
        owner = np.searchsorted([s[0] for s in segments], places, side="right") - 1
        begin = np.maximum(np.array([s[0] for s in segments])[owner], places - LEFT)
        end = np.minimum(np.array([s[1] for s in segments])[owner], places + LENGTH)
        around = (sums[end] - sums[begin]) * inverses[begin]
        around += (places - begin).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        around += (end - places).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        return places, owner, grams[places].view(np.int64), _mixed(around).view(np.int64)


def _buffers(texts: list[bytes]):
    """Texts packed into buffers of about BUFFER bytes, as (data, segments, owners, offsets); long texts in overlapping parts."""
    held, segments, owners, offsets, size = [], [], [], [], 0
    for at, text in enumerate(texts):
        windows = len(text) - LENGTH + 1
        for first in range(0, windows, BUFFER):
            last = min(first + BUFFER, windows)
            # enough around the windows for the contexts of their anchors
            begin, end = max(0, first - LEFT), min(len(text), last + LEFT + LENGTH)
            held.append(text[begin:end])
            segments.append((size, size + end - begin, size + first - begin, size + last - begin))
            owners.append(at)
            offsets.append(begin)
            size += end - begin
            if size >= BUFFER:
                yield np.frombuffer(b"".join(held), np.uint8), segments, owners, offsets
                held, segments, owners, offsets, size = [], [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), segments, owners, offsets


def anchors(texts: DataFrame) -> DataFrame:
    """(h, ph, key, pos, n_bytes): the anchors of texts(key, text), each place once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(1)]
            sizes = np.array([len(d) for d in data])
            last = (-1, -1)
            for buffer, segments, owners, offsets in _buffers(data):
                places, owner, h, ph = _anchors(buffer, segments)
                text = np.array(owners)[owner]
                pos = places - np.array([s[0] for s in segments])[owner] + np.array(offsets)[owner]
                # two parts of a long text can share an anchor
                fresh = np.concatenate(([(int(text[0]), int(pos[0])) != last], (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])))
                last = (int(text[-1]), int(pos[-1]))
                text, pos, h, ph = text[fresh], pos[fresh], h[fresh], ph[fresh]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(ph), pa.array(keys[text]), pa.array(pos.astype(np.int32)),
                     pa.array(sizes[text].astype(np.int32))], ["h", "ph", "key", "pos", "n_bytes"])

    return texts.mapInArrow(run, "h long, ph long, key long, pos int, n_bytes int")


def repeated_windows(contexts: np.ndarray, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """For contexts (rows x CONTEXT bytes): [row, a] is whether the window that starts a bytes before the anchor is repeated.

    Every shard of rows keeps the order of its suffixes and reads off its transform's
    column; the merged side sees only these columns and the interleave.
    """
    n = len(contexts)
    marks = np.zeros((n, LEFT + 1), bool)
    if n < 2:
        return marks
    columns = np.ascontiguousarray(contexts.T)
    bounds = [(a, min(a + shard_rows, n)) for a in range(0, n, shard_rows)]
    orders = [np.arange(a, b) for a, b in bounds]
    kind = np.uint8 if len(bounds) <= 256 else np.uint16 if len(bounds) <= 65536 else np.int64
    interleave = np.repeat(np.arange(len(bounds)), [b - a for a, b in bounds]).astype(kind)
    slots = np.arange(n)
    # common bytes of each suffix and the one before it in the merged order; the last stands for the end
    common = np.zeros(n + 1, np.uint16)
    for c in range(CONTEXT - 1, -1, -1):
        transform = []
        for s, order in enumerate(orders):
            column = columns[c][order]
            transform.append(column)
            orders[s] = order[np.argsort(column, kind="stable")]
        merged = np.empty(n, np.uint8)
        merged[slots] = np.concatenate(transform)
        refined = np.argsort(merged, kind="stable")
        interleave = interleave[refined]
        before, after = refined[:-1], refined[1:]
        same = np.flatnonzero((merged[before] == merged[after]) & (merged[after] != OUTSIDE))
        fresh = np.zeros(n + 1, np.uint16)
        if len(same):
            spans = np.stack((before[same] + 1, after[same] + 1), axis=1).ravel()
            fresh[same + 1] = np.minimum.reduceat(common, spans)[::2] + 1
        common = fresh
        slots = np.argsort(interleave, kind="stable")
        if c <= LEFT:
            long_enough = common >= LENGTH
            repeated = long_enough[:-1] | long_enough[1:]
            if repeated.any():
                row = np.empty(n, np.int64)
                row[slots] = np.concatenate(orders)
                marks[row[repeated], LEFT - c] = True
    return marks


def _context_groups(rows: DataFrame) -> DataFrame:
    """(h, ph, a, b): runs of repeated window starts, a to b bytes before the anchor, from rows(g, h, ph, context) sorted by g."""
    schema = "h long, ph long, a int, b int"

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
        marks = np.pad(repeated_windows(flat).astype(np.int8), ((0, 0), (1, 1)))
        steps = np.diff(marks, axis=1)
        row, a = np.nonzero(steps == 1)
        _, b = np.nonzero(steps == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("h").to_numpy()[row]), pa.array(table.column("ph").to_numpy()[row]),
             pa.array(a.astype(np.int32)), pa.array((b - 1).astype(np.int32))], ["h", "ph", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).to_numpy()
            if held and size >= MERGED_ROWS:
                # groups stay whole: the last one held may go on in this batch
                cut = int(np.searchsorted(groups != held[-1].column(0)[held[-1].num_rows - 1].as_py(), True))
                if cut < len(groups):
                    held.append(batch.slice(0, cut))
                    yield merged(held)
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield merged(held)

    return rows.mapInArrow(run, schema)


def _hot_runs(rows: DataFrame) -> DataFrame:
    """The same as of _context_groups, from rows(h, ph, context): windows are counted by 64-bit hashes, combined on the map side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, inverses = _power_tables(CONTEXT)
        powers = _power_tables(CONTEXT)[0][:CONTEXT]
        for batch in batches:
            for at in range(0, batch.num_rows, HASHED_ROWS):
                part = batch.slice(at, HASHED_ROWS)
                flat = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, CONTEXT)
                h, ph = part.column(0).to_numpy(), part.column(1).to_numpy()
                with np.errstate(over="ignore"):
                    sums = np.zeros((len(flat), CONTEXT + 1), np.uint64)
                    np.cumsum(_TABLE[flat] * powers, axis=1, out=sums[:, 1:])
                    # column c: the window that starts LEFT - c bytes before the anchor
                    windows = (sums[:, LENGTH:] - sums[:, : LEFT + 1]) * inverses[: LEFT + 1]
                    windows += (h.view(np.uint64) * np.uint64(0x632BE59BD9B4E019))[:, None]
                    windows += np.arange(LEFT + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
                    windows = _mixed(windows)
                outside = np.zeros((len(flat), CONTEXT + 1), np.int32)
                np.cumsum(flat == OUTSIDE, axis=1, out=outside[:, 1:])
                row, column = np.nonzero(outside[:, LENGTH:] == outside[:, : LEFT + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows[row, column].view(np.int64)), pa.array(h[row]), pa.array(ph[row]),
                     pa.array((LEFT - column).astype(np.int32))], ["w", "h", "ph", "a"])

    windows = written(rows.mapInArrow(run, "w long, h long, ph long, a int"), "hot-windows")
    repeated = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    starts = windows.join(repeated, "w").groupBy("h", "ph").agg(F.sort_array(F.collect_list("a")).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1) != x - 1))
    last = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1) != x + 1, F.lit(True)))
    return starts.select("h", "ph", F.explode(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("r")) \
        .select("h", "ph", "r.a", "r.b")


def _window_runs(docs: DataFrame) -> DataFrame:
    """(key, first, last): runs of starts of repeated windows in the distinct texts of docs(key, text)."""
    found = anchors(docs)
    place = F.xxhash64("key", "pos")
    shared = (found.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high"))
              .where("low <> high").select("h"))
    cand = written(found.join(shared, "h").distinct(), "anchors")
    kinds = written(cand.groupBy("h", "ph").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("at")), "contexts")
    first = F.greatest(F.col("pos") - LEFT, F.lit(0))
    last = F.least(F.col("pos"), F.col("n_bytes") - LENGTH)
    whole = (cand.join(kinds.where("n > 1").select("h", "ph"), ["h", "ph"])
             .select("key", first.alias("first"), last.alias("last")))

    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    one_each = docs.groupBy("key").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "ph", "kinds", "context"]
        kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for text, items in zip(batch.column(0), batch.column(1)):
                data = bytes([OUTSIDE]) * LEFT + text.as_py().encode("utf-8", "surrogatepass") + bytes([OUTSIDE]) * LENGTH
                rows = items.as_py()
                for some in range(0, len(rows), 10_000):
                    part = rows[some:some + 10_000]
                    columns = [[r["h"] for r in part], [r["ph"] for r in part], [r["kinds"] for r in part],
                               [data[r["pos"]:r["pos"] + CONTEXT] for r in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds_of)], names)

    def contexts_of(anchors_: DataFrame) -> DataFrame:
        wanted = (kinds.join(anchors_, "h").select("at.key", F.struct("at.pos", "h", "ph", "kinds").alias("anchor"))
                  .groupBy("key").agg(F.collect_list("anchor").alias("wanted")))
        return one_each.join(wanted, "key").select("text", "wanted").mapInArrow(
            cut, "h long, ph long, kinds long, context binary")

    few, many = several.where(F.col("kinds") <= HOT_CONTEXTS), several.where(F.col("kinds") > HOT_CONTEXTS)
    dealt = contexts_of(few).select(F.col("h").alias("g"), "h", "ph", "context").repartition("g").sortWithinPartitions("g")
    runs = _context_groups(dealt)
    if not many.isEmpty():
        runs = runs.unionByName(_hot_runs(contexts_of(many).select("h", "ph", "context")))
    runs = written(runs, "window-runs")
    partial = cand.join(runs, ["h", "ph"]).select(
        "key", (F.col("pos") - F.col("b")).alias("first"), (F.col("pos") - F.col("a")).alias("last"))
    return whole.where("first <= last").unionByName(partial)


def removed_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows starting in `runs` (first, last) cover."""
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        end = min(last + LENGTH, len(text))
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return [(a, b) for a, b in spans]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of `docs`.

    Every byte is removed that a string of LENGTH bytes covers which also starts anywhere
    else in the table.  Copies of a text of LENGTH bytes or more lose all of it.  Null texts are
    empty; rows without an id take part like others.  Texts are told apart by 64-bit
    hashes of their bytes, copies by two of them.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .withColumn("key", F.xxhash64("text"))
    small = written(keyed.select("doc_id", "key", F.xxhash64(F.lit(1), "text").alias("key2"),
                                 F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")),
                    "texts")
    copies = written(small.groupBy("key", "key2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    long_enough = keyed.where(F.octet_length("text") >= LENGTH).select("key", "text")
    runs = _window_runs(long_enough)
    per_text = (runs.join(copies.select("key").distinct(), "key", "left_anti")
                .groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, items in zip(*[batch.column(k) for k in range(3)]):
                data = text.as_py().encode("utf-8", "surrogatepass")
                spans = removed_spans(data, [(r["first"], r["last"]) for r in items.as_py()])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                for column, value in zip(out, (key.as_py(), sum(b - a for a, b in spans), len(spans), kept.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["key", "n_removed", "n_spans", "kept"])

    results = long_enough.join(per_text, "key").select("key", "text", "runs").mapInArrow(
        cut, "key long, n_removed long, n_spans long, kept string")
    joined = small.join(copies, ["key", "key2"], "left").join(written(results, "cut-texts"), "key", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, part, none: F.when(gone, all_).otherwise(F.coalesce(part, none))
    return joined.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept"), F.col("sha")).alias("kept_sha256"))
