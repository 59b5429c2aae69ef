"""Token ids as binary shards with Elias-Fano document boundaries.

Layout of a written folder: a Parquet table with one row per shard, so Spark's committer
makes each write whole or absent, on any store.  Columns of a shard:

    part, piece    place in the ascending order of documents
    n_docs, n_ids  number of documents and of ids
    ids            all ids of the shard in one array, little-endian, `width` bytes each
    width          2 if the vocabulary fits into 16 bits, else 4
    low_bits, low, high
                   Elias-Fano code of the n_docs end offsets: the low bits of each end packed
                   after each other, the high parts as unary gaps in a bit vector
    doc_ids        the documents' ids, 8 bytes each; nulls are marked in `no_id`

A boundary costs about 2 + log2(n_ids / n_docs) bits; end i is found by a select of the i-th
one-bit in `high`, with one counter per 64-bit word.  A shard ends after SHARD_IDS ids or
with its partition; a longer document is a shard of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_IDS = 1 << 20
END_ID = 0
# words whose ids a task remembers
CACHED_WORDS = 400_000
# new words that go through the tokenizer in one call
CALL_WORDS = 200
# Fixed value: the byte-level tokenizer's pattern; its letters, numbers and spaces up to U+024F.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r\xa0"
_PIECE = re.compile(f" ?[{_L}]+|'(?:[sdmt]|ll|ve|re)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-\u024f]|<\\|")
_PART = re.compile(r" ?[^ ]+(?: (?![A-Za-z])[^ ]*)*")
FORMAT = ("part int, piece int, n_docs long, n_ids long, ids binary, width int, low_bits int, "
          "low binary, high binary, doc_ids binary, no_id binary")


class EliasFano:
    """A sequence of n nondecreasing numbers below a bound, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self._low = np.frombuffer(low, np.uint8)
        words = np.frombuffer(high, "<u8")
        self._high = words
        self._ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
        """(low_bits, low, high) of nondecreasing values."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        places = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = int(ones[-1]) + 1 if n else 0
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[ones] = 1
        return low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """Value i, without decoding the others."""
        word = int(np.searchsorted(self._ranks, i, side="right")) - 1
        bits = int(self._high[word])
        for _ in range(i - int(self._ranks[word])):
            bits &= bits - 1
        one = word * 64 + (bits & -bits).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self._low[at >> 3]) >> (at & 7) & 1) << k
        return (one - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high.view(np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self._low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (high + (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


class WordEncoder:
    """Ids of texts by a byte-level tokenizer, with the ids of words kept between texts.

    The tokenizer first cuts a text into pieces by a pattern, and its merges never cross them.  So a text
    is cut here where pieces end, known parts are looked up, and the rest goes
    through the tokenizer, many parts in one call.
    """

    def __init__(self, path: str, width: int, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.known: dict[str, bytes] = {}
        self.cached_words = cached_words
        space = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, at in self.tokenizer.get_vocab().items():
            space[at] = token.startswith("Ġ")
        self.starts_word = space

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [self._parts(t) for t in texts]
        pieces = set()
        for parts in cut:
            pieces.update(parts)
        fresh = self._words(list(pieces.difference(known)))
        room = self.cached_words - len(known)
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        # of the new pieces those that fit stay; long ones seldom come again
        for piece in fresh:
            if room > 0 and len(piece) <= 40:
                room -= 1
            else:
                del known[piece]
        return out

    @staticmethod
    def _parts(text: str) -> list[str]:
        """The pieces of the tokenizer's pattern, or larger parts that end where pieces end.

        Texts of other scripts, with control characters or with special tokens are cut only before each single space
        that an ASCII letter follows: which characters are letters there depends on the Unicode version.
        """
        if not _ODD.search(text):
            return _PIECE.findall(text)
        parts = _PART.findall(text)
        if sum(map(len, parts)) == len(text):
            return parts
        # two spaces or more at its beginning
        lead = len(text) - len(text.lstrip(" "))
        if lead == len(text):
            return [text]
        rest = WordEncoder._parts(text[lead:])
        if text[lead].isascii() and text[lead].isalpha():
            return [text[:lead - 1], " " + rest[0], *rest[1:]]
        return [text[:lead] + rest[0], *rest[1:]]

    def _words(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts; those of the form ' word' are encoded as one text and told apart at their space."""
        plain = [p for p in parts if p[0] == " " and len(p) > 1 and p[1].isalpha() and " " not in p[1:]]
        single = set(plain)
        fresh = {p: self._encode(p) for p in parts if p not in single}
        for first in range(0, len(plain), CALL_WORDS):
            some = plain[first:first + CALL_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            at = np.flatnonzero(self.starts_word[ids])
            if len(at) != len(some):  # a special token's text inside a word
                fresh.update({p: self._encode(p) for p in some})
                continue
            packed = ids.astype(self.dtype)
            ends = np.append(at[1:], len(ids))
            for p, a, b in zip(some, at.tolist(), ends.tolist()):
                fresh[p] = packed[a:b].tobytes()
        return fresh


def _encoded(encoder: WordEncoder, texts: pa.Array, rows: int = 1000) -> Iterator[bytes]:
    """Ids of each text, some texts at a time."""
    for first in range(0, len(texts), rows):
        yield from encoder(texts.slice(first, rows).to_pylist())


_encoders: dict[tuple[str, int, int], WordEncoder] = {}


def _encoder(*of: str | int) -> WordEncoder:
    """One encoder per worker process; workers are used for many tasks."""
    if of not in _encoders:
        _encoders[of] = WordEncoder(*of)
    return _encoders[of]


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = END_ID, parts: int | None = None,
                 cached_words: int = CACHED_WORDS) -> None:
    """Encode `docs(doc_id, text)` and write shards in ascending doc_id order to `out`.

    Rows without a doc_id come first; rows with one doc_id are ordered by a hash of their texts, then by
    the texts.  The texts are range-partitioned before they are encoded: Spark samples what it
    partitions, and would encode everything twice the other way round.  A worker keeps the ids of
    `cached_words` words, about 250 bytes each.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if _vocabulary(path) <= 1 << 16 else 4
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
               .repartitionByRange(parts, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        encoder = _encoder(path, width, cached_words)
        end = np.array([end_id], encoder.dtype).tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for batch in batches:
            for doc, made in zip(batch.column(0).to_pylist(), _encoded(encoder, batch.column(1))):
                data = made + end
                if held and size + len(data) // width > SHARD_IDS:
                    yield _shard(part, piece, held, width)
                    held, size, piece = [], 0, piece + 1
                held.append((doc, data))
                size += len(data) // width
        if held:
            yield _shard(part, piece, held, width)

    ordered.mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(out)


def _shard(part: int, piece: int, held: list[tuple[int | None, bytes]], width: int) -> pa.RecordBatch:
    ends = np.cumsum([len(data) // width for _, data in held])
    low_bits, low, high = EliasFano.encode(ends)
    row = [part, piece, len(held), int(ends[-1]), b"".join(data for _, data in held), width, low_bits, low, high,
           np.array([doc or 0 for doc, _ in held], "<i8").tobytes(),
           np.packbits([doc is None for doc, _ in held], bitorder="little").tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], FORMAT.replace(",", "").split()[::2])


def read_documents(spark, out: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of written shards, each document found by its boundaries.

    start counts the ids of all documents before it, ids_crc32 is taken over the ids as
    little-endian unsigned 32-bit integers.
    """
    shards = spark.read.parquet(out)
    # one row of four numbers per shard; parts first, so that no window spans all shards of a large table
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = per_part.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (shards.select("part", "piece", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)))
              .join(before_part, "part").select("part", "piece", (F.col("part_start") + F.col("inside")).alias("shard_start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                ends = EliasFano(n, row["low_bits"], row["low"], row["high"]).all()
                begins = np.concatenate(([0], ends[:-1]))
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                docs = np.frombuffer(row["doc_ids"], "<i8")
                no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), bitorder="little", count=n).astype(bool)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(docs, mask=no_id), pa.array(begins + row["shard_start"]), pa.array(ends - begins),
                           pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(begins, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return shards.join(starts, ["part", "piece"]).mapInArrow(run, schema)
