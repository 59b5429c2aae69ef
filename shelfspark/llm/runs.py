"""Sorted runs of counted keys as zstd blocks, and their k-way merge by a heap.

A run holds records of several whole-number columns in ascending order of its leading key columns, the last of
which is a count where runs are merged.  It is a sequence of blocks; each is compressed on its own, so a merge holds
one block of each run at a time.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import written

BLOCK = 1 << 12
# runs that one merge reads
FAN_IN = 512
# bytes of runs that one partition may hold before the next merge splits it
PART_BYTES = 64 << 20
_HEAD = struct.Struct("<III")
_MIX = np.uint64(0x9E3779B97F4A7C15)

Columns = list[np.ndarray]


def pack(columns: Sequence[np.ndarray], block: int = BLOCK) -> bytes:
    """Columns of one length, rows in order, as a run."""
    packer = zstandard.ZstdCompressor(level=3)
    out = []
    n = len(columns[0])
    for at in range(0, n, block):
        part = [np.ascontiguousarray(c[at:at + block], np.uint64) for c in columns]
        # neighbours share their first column, and high bytes are mostly zero
        with np.errstate(over="ignore"):
            part[0] = np.diff(part[0], prepend=np.uint64(0))
        planes = b"".join(p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in part)
        data = packer.compress(planes)
        out += [_HEAD.pack(len(part[0]), len(part), len(data)), data]
    return b"".join(out)


def blocks(data: bytes) -> Iterator[Columns]:
    """The blocks of a run, each as its columns (uint64)."""
    unpacker = zstandard.ZstdDecompressor()
    at = 0
    while at < len(data):
        n, width, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        planes = np.frombuffer(unpacker.decompress(data[at:at + size], max_output_size=n * width * 8), np.uint8)
        at += size
        part = [np.ascontiguousarray(p.reshape(8, n).T).view(np.uint64).ravel() for p in planes.reshape(width, 8 * n)]
        part[0] = np.cumsum(part[0], dtype=np.uint64)
        yield part


def unpack(data: bytes) -> Columns:
    """All of a run at once."""
    found = list(blocks(data))
    return [np.concatenate(column) for column in zip(*found)] if found else []


def combine(columns: Columns) -> Columns:
    """Records sorted by all columns but the last, which is summed over equal ones."""
    *keys, counts = columns
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(fresh)
    return [*[k[starts] for k in keys], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]]


def _upto(columns: Columns, bound: tuple[int, ...]) -> int:
    """How many records have keys of at most `bound`."""
    low, high = 0, len(columns[0])
    for column, value in zip(columns, bound):
        part, value = column[low:high], np.uint64(value)
        low, high = low + int(np.searchsorted(part, value, "left")), low + int(np.searchsorted(part, value, "right"))
    return high


def merge(runs: Iterable[Iterator[Columns]]) -> Iterator[Columns]:
    """Runs of (keys..., count) in one order, counts of equal keys summed; blocks come as they are ready.

    A heap names the block that ends first.  Up to its end nothing smaller can follow in any run, so all records up to
    there are taken from the blocks whose first key, on a second heap, is not beyond it.
    """
    sources = list(runs)
    held: list[Columns | None] = [None] * len(sources)
    heads: list[tuple] = []
    ends: list[tuple] = []

    def key(columns: Columns, at: int) -> tuple[int, ...]:
        return tuple(int(c[at]) for c in columns[:-1])

    def fill(i: int) -> None:
        held[i] = next(sources[i], None)
        if held[i] is not None:
            heapq.heappush(heads, (key(held[i], 0), i))
            heapq.heappush(ends, (key(held[i], -1), i))

    for i in range(len(sources)):
        fill(i)
    while ends:
        bound = ends[0][0]
        taken = []
        again = []
        while heads and heads[0][0] <= bound:
            _, i = heapq.heappop(heads)
            n = _upto(held[i][:-1], bound)
            taken.append([c[:n] for c in held[i]])
            held[i] = [c[n:] for c in held[i]]
            again.append(i)
        while ends and ends[0][0] == bound:
            heapq.heappop(ends)
        for i in again:
            if len(held[i][0]):
                heapq.heappush(heads, (key(held[i], 0), i))
            else:
                fill(i)
        yield combine([np.concatenate(c) for c in zip(*taken)]) if len(taken) > 1 else taken[0]


def part_of(keys: Sequence[np.ndarray], parts: int) -> np.ndarray:
    """The partition of each key; those of twice as many parts refine it."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            mixed = (mixed ^ np.asarray(k, np.uint64)) * _MIX
            mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(parts)).astype(np.int64)


def dealt(columns: Columns, prefix: int, parts: int) -> Iterator[tuple[int, Columns]]:
    """(part, its records in their order) by the first `prefix` columns."""
    part = part_of(columns[:prefix], parts)
    order = np.argsort(part, kind="stable")
    at = part[order]
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else []
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        yield int(at[a]), [c[order[a:b]] for c in columns]


def merged(runs: DataFrame, parts: int, prefix: int, fan_in: int = FAN_IN, part_bytes: int = PART_BYTES) -> DataFrame:
    """runs(part, run, data) of `parts` partitions -> (part, data) with one run for each partition.

    `part` is `part_of` the first `prefix` key columns.  A task merges about `fan_in` runs; a partition of more
    runs takes several levels, and one that outgrows `part_bytes` is split by its keys on the way, so no task holds more
    when the input grows.  Each level is written to the shared folder.
    """
    def level(split: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            out: dict[int, list[Columns]] = {}
            made: dict[int, list[bytes]] = {}

            def flush(part: int) -> None:
                found = out.pop(part)
                made.setdefault(part, []).append(pack([np.concatenate(c) for c in zip(*found)]))

            size: dict[int, int] = {}
            for columns in merge([blocks(d.as_py()) for d in table.column("data")]):
                for part, some in dealt(columns, prefix, split):
                    out.setdefault(part, []).append(some)
                    size[part] = size.get(part, 0) + len(some[0])
                    if size[part] >= BLOCK:
                        flush(part)
                        size[part] = 0
            for part in list(out):
                flush(part)
            rows = [(part, key[1].as_py(), b"".join(data)) for part, data in sorted(made.items())]
            return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "run": pa.array([r[1] for r in rows], pa.int64()),
                             "data": pa.array([r[2] for r in rows], pa.binary())})
        return run

    while True:
        seen = runs.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("size")) \
            .agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
        if not seen["n"] or seen["n"] == 1:
            return runs.select("part", "data")
        groups = -(-seen["n"] // fan_in)
        parts *= 1 << max(0, (seen["size"] // part_bytes).bit_length())
        # a run's number does not tell which runs are alike, so its hash deals them evenly
        keyed = runs.select("part", F.pmod(F.xxhash64("run", F.lit(seen["n"])), F.lit(groups)).alias("g"), "data")
        runs = written(keyed.groupBy("part", "g").applyInArrow(level(parts), "part long, run long, data binary"), "merged-runs")
