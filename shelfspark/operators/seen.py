"""The set of requests made so far, in buckets with a Bloom filter each.

Every run appends a generation: its fingerprints, in folders by bucket, and for each bucket a bitmap with PROBES bits of every
fingerprint, taken from its own hexadecimal digits.  New requests meet the bitmaps first; one that a bitmap does not hold is
certainly new, and only the others are compared with the fingerprints, exactly.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.requests import canonical_url, request_fingerprint
from shelfspark.session import materialize, sized
from shelfspark.sources import manifest

ENTRY = "path string, buckets int, bits long"
BUCKETS = 64
PROBES = 3
# bits of a filter for each fingerprint of its bucket: of 1,000 new requests about five are compared for nothing
BITS_EACH = 16
LEAST_BITS = 1 << 15
# digits of a fingerprint that name its bucket and its bits
_BUCKET_DIGITS, _PROBE_DIGITS = (1, 7), [(9, 8), (17, 8), (25, 8)]


class Generation(NamedTuple):
    path: str
    buckets: int
    bits: int


def _number(start: int, length: int) -> Column:
    return F.conv(F.substring("fingerprint", start, length), 16, 10).cast("bigint")


def _bucket(buckets: int) -> Column:
    return F.pmod(_number(*_BUCKET_DIGITS), F.lit(buckets)).cast("int")


def _places(bits: int) -> list[Column]:
    """Places in the bucket's bitmap, from 1 on."""
    return [F.pmod(_number(*digits), F.lit(bits)) + 1 for digits in _PROBE_DIGITS[:PROBES]]


def generations(spark: SparkSession, root: str) -> list[Generation]:
    return [Generation(*row) for row in manifest.entries(spark, root)]


def append_seen(fingerprints: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Add fingerprints(fingerprint), 40 lower-case hexadecimal digits each, as a generation; returns the version.

    They are visible when the manifest is.  Fingerprints that older generations hold may come again.
    """
    spark = fingerprints.sparkSession
    version = manifest.latest(spark, root) + 1
    path = f"{root}/seen/g{version}"
    (fingerprints.select("fingerprint").distinct().withColumn("bucket", _bucket(buckets))
     .repartitionByRange("bucket", "fingerprint").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/fingerprints"))
    rows = spark.read.schema("fingerprint string, bucket int").parquet(f"{path}/fingerprints")
    n = rows.count()
    bits = max(LEAST_BITS, 1 << (BITS_EACH * -(-n // buckets)).bit_length())
    places = rows.select("bucket", F.explode(F.array(*_places(bits))).alias("place"))
    (places.groupBy("bucket", F.bitmap_bucket_number("place").alias("block"))
     .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).write.mode("overwrite").parquet(f"{path}/filters"))
    known = [tuple(g) for g in generations(spark, root)]
    manifest.publish(spark, root, version, [*known, (path, buckets, bits)], ENTRY)
    return version


def _bit(place: Column) -> Column:
    at = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.call_function("substring", F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", octet, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def maybe_seen(requests: DataFrame, generation: Generation) -> DataFrame:
    """requests(fingerprint, ...) with `maybe`: false only where the generation does not hold the fingerprint."""
    filters = sized(requests.sparkSession.read.parquet(f"{generation.path}/filters"))
    out = requests.withColumn("maybe", F.lit(True)).withColumn("bucket", _bucket(generation.buckets))
    for place in _places(generation.bits):
        # a bitmap of 4 KB meets a request, and one bit of it stays
        out = (out.withColumn("place", place).withColumn("block", F.bitmap_bucket_number("place"))
               .join(filters, ["bucket", "block"], "left")
               .withColumn("maybe", F.col("maybe") & _bit(F.col("place"))).drop("bits", "place", "block"))
    return out.drop("bucket")


def distinct_requests(requests: DataFrame, url: str = "url", method: str | None = None, body: str | None = None) -> DataFrame:
    """(fingerprint, url): each request once, under the first of its spellings; canonical URLs have one."""
    name = lambda c: None if c is None else F.col(c)
    return (requests.select(canonical_url(F.col(url)).alias("url"), request_fingerprint(F.col(url), name(method), name(body)).alias("fingerprint"))
            .groupBy("fingerprint").agg(F.min("url").alias("url")))


def new_requests(requests: DataFrame, root: str, url: str = "url", method: str | None = None, body: str | None = None) -> DataFrame:
    """(fingerprint, url) of the requests that no generation holds.

    Filters never drop a new request: what they let through as unknown is new, all else goes to the exact comparison.
    """
    spark = requests.sparkSession
    found = distinct_requests(requests, url, method, body)
    known = generations(spark, root)
    for generation in known:
        marked = materialize(maybe_seen(found, generation))
        held = spark.read.schema("fingerprint string, bucket int").parquet(f"{generation.path}/fingerprints").select("fingerprint")
        maybe = marked.filter("maybe").drop("maybe")
        found = marked.filter("not maybe").drop("maybe").unionByName(maybe.join(held, "fingerprint", "left_anti"))
    return found
