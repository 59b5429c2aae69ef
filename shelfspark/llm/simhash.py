"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit place gets a vector of `radius + 1` bits.  A table belongs to each nonzero
vector v of that length, and keeps the places whose vector has an odd product with v.
Two fingerprints that differ in at most `radius` places leave some v whose products
with all these places' vectors are even: `radius` vectors cannot span the whole space.
In that table the pair has equal keys, so no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import by_rows, link_within_buckets, with_components, word_runs, written

SHINGLE_WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
# shingle hashes whose bits are counted at once
COUNT_BLOCK = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half of the shingle hashes.

    Only A-Z are lower-cased.  Repeated shingles count as often as they occur; a text of
    fewer words is one shingle, a text without words (or null) gives 0.
    """
    counts = np.zeros(BITS, np.int64)
    total = 0
    carried: list[bytes] = []
    for run in word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + run
        if len(words) < words_per_shingle:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        n = len(words) - words_per_shingle + 1
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        stops = (ends[words_per_shingle - 1:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)
        for at in range(0, n, COUNT_BLOCK):
            octets = hashes[at:at + COUNT_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        carried = words[n:]
    if total == 0 and carried:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of `docs`, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)]
            signed = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = SEED) -> list[int]:
    """The `2 ** (radius + 1) - 1` masks, as signed longs.

    The places get all nonzero vectors in turn, in a seeded order, so each table keeps
    about half of the places.
    """
    space = 1 << (radius + 1)
    order = np.random.default_rng(seed).permutation(bits)
    vectors = [1 + int(order[place]) % (space - 1) for place in range(bits)]
    masks = []
    for v in range(1, space):
        mask = sum(1 << place for place in range(bits) if (vectors[place] & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def near_pairs(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def simhash_components(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = SHINGLE_WORDS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked by steps of `radius` bits or fewer.

    component_id is the smallest doc_id of the component.  Rows with a null doc_id keep
    a fingerprint and take part as links; a component of such rows alone has a null
    component_id.  Null and empty texts have fingerprint 0, which links like any other.
    Repeated rows give repeated rows.  Equal fingerprints are one vertex, so copies
    make no pairs.
    """
    prints = written(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = prints.select(F.col("fp").alias("id")).distinct()
    masks = F.array(*[F.struct(F.lit(at).alias("t"), F.lit(mask).alias("mask"))
                      for at, mask in enumerate(covering_masks(radius))])
    members = (distinct.select("id", F.explode(masks).alias("m"))
               .select(F.struct(F.col("m.t").alias("t"), F.col("id").bitwiseAND(F.col("m.mask")).alias("key"))
                       .alias("bucket"), "id"))
    roots = link_within_buckets(members, lambda pairs: pairs.where(near_pairs("a", "b", radius)))
    placed = with_components(prints.select("doc_id", "fp"), roots, "fp")
    placed = written(placed, "placed")
    lowest = by_rows(written(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest"))
    return placed.join(lowest, "root").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id stays.

    Of rows that repeat that doc_id one stays; rows without a doc_id stay, as nothing
    names them.
    """
    groups = simhash_components(docs, radius)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    one = named.dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
