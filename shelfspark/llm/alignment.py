"""Two tokenizers aligned on the same texts, their linked token pairs counted over the corpus by spilled runs.

Tokens of both sides cover the same bytes.  Where a token of each ends at one offset, the two are linked, and these
offsets cut both sequences into groups.  How often a pair of ids is linked in the whole corpus is counted outside
memory:

* A task holds records (pair, document, number of links).  When it has CHUNK_RECORDS of them, they are sorted by
  the pair, the second tokenizer's id first, dealt to radix partitions of that id, and written as zstd runs: the pairs'
  counts (`head`) apart from their documents (`body`).
* The heads of a partition are merged k ways by a heap, which sums each pair; more than FAN_IN runs take several levels,
  so a pair that every document holds is one row per run and never a group of documents.
* A merged run is in the order of the second side, so all pairs of one of its ids are neighbours and their highest count is
  known when the last is read.  The counts then go past each body in the same order and add up per document.

Texts are cut into units where both tokenizers end a token whatever follows: before a space after a printable ASCII or
Latin letter.  The byte-level tokenizer's pattern never goes on there, and no piece of the other holds a space behind
another character (tested when it is loaded; else whole texts are encoded).  A mark at a unit's end is cut off in the same way.  Units are remembered between texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import runs
from shelfspark.llm.common import written

# records that a task sorts at once
CHUNK_RECORDS = 1 << 19
RADIX = 32
# bodies that one task reads with the counts of their partition
SLICE_RUNS = 32
# units a worker remembers
CACHED_UNITS = 500_000
# new units that are encoded in one call
CALL_UNITS = 200
_SAFE = "!-~À-ɏ"
_ODD = re.compile(f"(?:^|[^{_SAFE}]) ")
# the characters a unit may end with, and those of them that are letters
_END = {chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x250)]}
_LETTER = {c for c in _END if c.isalpha()}
_MARKS = ".,;:!?"

DOCS = ("chunk long, doc_no int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups string, groups_sha256 string, radix int, head binary, body binary")


def byte_level_decoder() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(odd)}


class Aligned(NamedTuple):
    """What is known of a unit or a text: tokens, groups, the groups' ids, and its links (second id << 32 | first id) as bytes."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    links: bytes


EMPTY = Aligned(0, 0, 0, "", b"")


class Aligner:
    """Aligns texts by a byte-level tokenizer (file for tokenizers) and a piece model (file for sentencepiece)."""

    def __init__(self, path_a: str, path_b: str, cached_units: int = CACHED_UNITS):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        # their strings in a text are ordinary text
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_level_decoder()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, at in self.a.get_vocab().items():
            self.bytes_a[at] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        # a mark behind a letter is a token's end and beginning on both sides where no piece holds the two
        marks = [m for m in _MARKS if not any(re.search(f"[^\\W\\d_]{re.escape(m)}", p) for p in pieces)]
        self.marks = {m: self._cut(self._ids("a" + m), [2, 3])[1] for m in marks}
        self.known: dict[str, Aligned | None] = {}
        self.cached_units = cached_units

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, ends) of space+text by either side; None where bytes do not fit."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        data = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        return ids_a, np.cumsum(self.size_a[ids_a]), ids_b, np.cumsum(self.size_b[ids_b])

    def _cut(self, found: tuple, stops: list[int]) -> list[Aligned]:
        """The texts that end at the byte offsets `stops`, each of which ends a token of both sides."""
        ids_a, ends_a, ids_b, ends_b = found
        shared = np.intersect1d(ends_a, ends_b)
        # every token that ends at a shared offset has bytes, so there is one of each side
        upto_a = np.searchsorted(ends_a, shared, "right")
        upto_b = np.searchsorted(ends_b, shared, "right")
        links = (ids_b[upto_b - 1].astype(np.uint64) << np.uint64(32) | ids_a[upto_a - 1].astype(np.uint64)).tobytes()
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        cuts_a, cuts_b = [0, *upto_a.tolist()], [0, *upto_b.tolist()]
        # most groups are one token of either side
        groups = [text_a[a] + "|" + text_b[b] if c - a == 1 == d - b else ",".join(text_a[a:c]) + "|" + ",".join(text_b[b:d])
                  for a, c, b, d in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        out, first = [], 0
        for last in np.searchsorted(shared, stops, "right").tolist():
            out.append(Aligned(cuts_a[last] - cuts_a[first], cuts_b[last] - cuts_b[first], last - first,
                               ";".join(groups[first:last]), links[8 * first:8 * last]))
            first = last
        return out

    def whole(self, text: str) -> Aligned:
        """A text by itself."""
        found = self._ids(text) if text else None
        return self._cut(found, [int(found[1][-1])])[0] if found else EMPTY

    def _learn(self, units: list[str]) -> None:
        joined = [u for u in units if u[-1:] in _END]
        for u in units:
            if u[-1:] not in _END:
                found = self._ids(u)
                self.known[u] = self._cut(found, [int(found[1][-1])])[0] if found else None
        for first in range(0, len(joined), CALL_UNITS):
            some = joined[first:first + CALL_UNITS]
            found = self._ids(" ".join(some))
            if found:
                stops = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in some]).tolist()
                self.known.update(zip(some, self._cut(found, stops)))
                continue
            for u in some:
                found = self._ids(u)
                self.known[u] = self._cut(found, [int(found[1][-1])])[0] if found else None

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of space+text, each without its first space."""
        parts = text.split(" ")
        if not _ODD.search(text):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            if out[-1][-1:] in _END:
                out.append(part)
            else:
                out[-1] += " " + part
        return out

    def __call__(self, texts: list[str]) -> list[tuple[Aligned, np.ndarray, np.ndarray]]:
        """(alignment, distinct links, how often each) of each text.

        A list: what lies behind the last `yield` of a generator does not run where its reader stops at the last text.
        """
        room = self.cached_units - len(self.known)
        marks, known = self.marks, self.known
        cut = [[(u[:-1], u[-1]) if u[-1:] in marks and u[-2:-1] in _LETTER else (u, None) for u in self.units(t)] if t and self.apart else []
               for t in texts]
        fresh = {u for units in cut for u, _ in units}.difference(known)
        if fresh:
            self._learn(list(fresh))
        made = []
        for text, units in zip(texts, cut):
            parts = []
            for unit, mark in units:
                parts.append(known[unit])
                if mark:
                    parts.append(marks[mark])
            if not units or None in parts:
                all_of = self.whole(text)
            else:
                n_a, n_b, n_groups, ids, links = zip(*parts)
                all_of = Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(ids), b"".join(links))
            made.append((all_of, *np.unique(np.frombuffer(all_of.links, np.uint64), return_counts=True)))
        # of the new units those that fit stay, those met first: frequent ones come early
        for unit in sorted(fresh, key=len)[max(room, 0):]:
            del self.known[unit]
        return made


_aligners: dict[tuple, Aligner] = {}


def _aligner(*of: str | int) -> Aligner:
    """One aligner per worker process; workers are used for many tasks."""
    if of not in _aligners:
        _aligners.clear()
        _aligners[of] = Aligner(*of)
    return _aligners[of]


def _release() -> None:
    """A worker that goes on to other tasks keeps no aligner."""
    _aligners.clear()


def _spilled(chunk: int, links: list[np.ndarray], times: list[np.ndarray], radix: int) -> pa.RecordBatch:
    """The runs of a chunk's records, a row for each radix partition."""
    docs = np.repeat(np.arange(len(links), dtype=np.uint64), [len(p) for p in links])
    pairs, n = np.concatenate(links), np.concatenate(times).astype(np.uint64)
    order = np.lexsort((docs, pairs))
    pairs, docs, n = pairs[order], docs[order], n[order]
    b, a = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    made = []
    for part, (pb, pa_, pd, pn) in runs.dealt([b, a, docs, n], 1, radix):
        head = runs.combine([pb, pa_, pn])
        made.append((part, runs.pack(head), runs.pack([pb, pa_, pd, pn])))
    return _rows(len(made), chunk=[chunk] * len(made), radix=[m[0] for m in made], head=[m[1] for m in made], body=[m[2] for m in made])


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(n: int, **columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in DOCS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), _KINDS[kind]) for name, kind in fields],
                                      [name for name, _ in fields])


def encode(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
           chunk_records: int = CHUNK_RECORDS, radix: int = RADIX, cached_units: int = CACHED_UNITS) -> DataFrame:
    """One pass over the texts, written: a row per document (radix null) and the runs of each chunk (doc_no null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(path_a, path_b, cached_units)
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for first in range(0, len(batch), 500):
                some = batch.slice(first, 500)
                rows = []
                for doc, (found, links, times) in zip(some.column(0).to_pylist(), aligner([t or "" for t in some.column(1).to_pylist()])):
                    digest = hashlib.sha256(found.text.encode()).hexdigest() if found.n_a else ""
                    rows.append((chunk, len(held), doc, found.n_a, found.n_b, found.n_groups, len(found.links) // 8,
                                 found.text if with_groups else None, digest))
                    held.append((links, times))
                    size += len(links)
                    if size >= chunk_records:
                        yield _spilled(chunk, *zip(*held), radix)
                        chunk, held, size = chunk + 1, [], 0
                names = ["chunk", "doc_no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]
                yield _rows(len(rows), **dict(zip(names, map(list, zip(*rows)))))
        if size:
            yield _spilled(chunk, *zip(*held), radix)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(texts.mapInArrow(run, DOCS), "aligned")


def pair_counts(encoded: DataFrame, radix: int = RADIX, fan_in: int = runs.FAN_IN) -> DataFrame:
    """(part, data): a run (b, a, count, 1 where the count is the highest of b) of each radix partition."""
    heads = encoded.where("radix is not null").select(F.col("radix").cast("long").alias("part"), F.col("chunk").alias("run"), F.col("head").alias("data"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                b, a, count = runs.unpack(data.as_py())
                # all pairs of one id of the second side are neighbours
                starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                most = np.repeat(np.maximum.reduceat(count, starts), np.diff(np.append(starts, len(b))))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([runs.pack([b, a, count, count == most])], pa.binary())],
                                                 ["part", "data"])

    # pairs are at most one vocabulary times the other, so partitions need no split
    one = runs.merged(heads, radix, 1, fan_in, part_bytes=1 << 62)
    return written(one.mapInArrow(mark, "part long, data binary"), "pair-counts")


def contributions(encoded: DataFrame, counts: DataFrame, slice_runs: int = SLICE_RUNS) -> DataFrame:
    """(chunk, doc_no, n_best, count_sum): the counts streamed back past the bodies."""
    bodies = encoded.where("radix is not null").select("chunk", "radix", "body")
    slices = max(1, -(-bodies.select("chunk").distinct().count() // slice_runs))
    left = bodies.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int"))
    right = counts.select(F.col("part").cast("int").alias("radix"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "data")

    def run(bodies: pa.Table, totals: pa.Table) -> pa.Table:
        _release()
        out = {"chunk": [], "doc_no": [], "n_best": [], "count_sum": []}
        if len(bodies):
            b, a, count, best = runs.unpack(totals.column("data")[0].as_py())
            code = b << np.uint64(32) | a
            for chunk, body in zip(bodies.column("chunk").to_pylist(), bodies.column("body")):
                found: list[tuple] = []
                for xb, xa, doc, n in runs.blocks(body.as_py()):
                    at = np.searchsorted(code, xb << np.uint64(32) | xa)
                    found.append((doc.astype(np.int64), (n * count[at]).astype(np.int64), (n * best[at]).astype(np.int64)))
                doc, sums, bests = (np.concatenate(c) for c in zip(*found))
                size = int(doc.max()) + 1
                all_sums, all_bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(all_sums, doc, sums)
                np.add.at(all_bests, doc, bests)
                docs = np.flatnonzero(all_sums)
                out["chunk"].append(np.full(len(docs), chunk))
                out["doc_no"].append(docs)
                out["n_best"].append(all_bests[docs])
                out["count_sum"].append(all_sums[docs])
        cat = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}
        return pa.table({"chunk": pa.array(cat["chunk"], pa.int64()), "doc_no": pa.array(cat["doc_no"].astype(np.int32), pa.int32()),
                         "n_best": pa.array(cat["n_best"], pa.int64()), "count_sum": pa.array(cat["count_sum"], pa.int64())})

    parts = (left.groupBy("radix", "slice").cogroup(right.groupBy("radix", "slice"))
             .applyInArrow(run, "chunk long, doc_no int, n_best long, count_sum long"))
    return parts.groupBy("chunk", "doc_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256), one row per row of `docs`.

    groups is `a1,a2|b1;a3|b2,b3` (null unless `with_groups`), groups_sha256 its digest.  A null or empty text, and one
    that a tokenizer does not give back byte for byte, has no tokens: zeros and ''.  Very long texts are cut into
    units like any other.  Repeated rows count as often as they stand there; rows without a doc_id stay; other columns of `docs` are not
    read.  An empty table gives an empty one.  n_best counts links whose pair has the highest count of its second id, ties included.
    """
    encoded = encode(docs, path_a, path_b, **options)
    radix = options.get("radix", RADIX)
    found = contributions(encoded, pair_counts(encoded, radix))
    rows = encoded.where("doc_no is not null").drop("radix", "head", "body")
    zero = F.lit(0).cast("long")
    return rows.join(found, ["chunk", "doc_no"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups", "groups_sha256")


def pairs(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, n, best): every linked pair of ids with its count in the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for b, a, count, best in runs.blocks(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(count.astype(np.int64)),
                                                      pa.array(best.astype(bool))], ["a", "b", "n", "best"])

    return counts.select("data").mapInArrow(run, "a long, b long, n long, best boolean")
