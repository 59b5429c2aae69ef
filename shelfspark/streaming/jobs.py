"""The running forms: keyword scores, frontier dedup, ingest.

Every job reads files as a stream, works with an `availableNow` trigger (or any
other) and can be stopped and started again from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.functions import urls
from shelfspark.operators import keyed
from shelfspark.operators.catalog import to_catalog
from shelfspark.operators.extract import site_fields
from shelfspark.operators.ranking import keyword_scores
from shelfspark.operators.records import BUILDERS
from shelfspark.operators.tables import fan_out, sink_rows
from shelfspark.schemas import SourceSpec

# batches between two merges of a sink
COMPACT_EVERY = 16
SCORES = keyed.Sink("scores", "keyword", keyed.summed("keyword", "score"))


def start_keyword_scores(log: DataFrame, root: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Add up keyword scores; each batch adds its own sums under its number.

    A batch that runs twice is visible once, so nothing counts double. After `compact_every` batches their sums
    are merged into the base, in the buckets of their keywords; no batch rewrites the scores of all keywords.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed.commit(spark, root, batch_id, {SCORES: keyword_scores(batch)})
        if keyed.deltas(spark, root, SCORES) >= compact_every:
            keyed.compact(spark, root, [SCORES])

    return (log.writeStream.foreachBatch(add)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())


def read_keyword_scores(spark: SparkSession, root: str) -> DataFrame:
    return keyed.read(spark, root, SCORES)


def start_new_links(links: DataFrame, root: str, seen: DataFrame | None = None,
                    watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Pass on each link once, across restarts.

    The state keeps every fingerprint for good, as the crawl needs it; with
    `watermark=(column, delay)` it keeps them for that long only. `seen` holds
    fingerprints of earlier runs.
    """
    found = links.withColumn("fingerprint", urls.fingerprint(F.col("url")))
    if seen is not None:
        found = found.join(seen, "fingerprint", "left_anti")
    if watermark:
        fresh = found.withWatermark(*watermark).dropDuplicatesWithinWatermark(["fingerprint"])
    else:
        fresh = found.dropDuplicates(["fingerprint"])
    return (fresh.writeStream.format("parquet").outputMode("append")
            .option("path", f"{root}/links")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())


def read_new_links(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/links")


def start_ingest(pages: DataFrame, spec: SourceSpec, root: str, now: int,
                 seq: str = "page_id") -> StreamingQuery:
    """Pages -> records -> index and table sinks, batch by batch.

    The records of a batch feed three writes, so they are kept for the length
    of the batch: pages are parsed once.
    """
    def ingest(batch: DataFrame, batch_id: int) -> None:
        hits = site_fields(batch, spec)
        records = BUILDERS[spec.site](hits, now, keep=(seq,)).withColumnRenamed(seq, "seq").persist()
        try:
            fan_out(records, to_catalog(records, spec.site, keep=("seq",)), spec, batch_id, root)
        finally:
            records.unpersist()

    return (pages.writeStream.foreachBatch(ingest)
            .option("checkpointLocation", f"{root}/{spec.site}/checkpoint")
            .trigger(availableNow=True).start())


def start_published_ingest(pages: DataFrame, spec: SourceSpec, root: str, now: int, seq: str = "page_id",
                           compact_every: int = COMPACT_EVERY, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Pages -> records -> index, table and reject sinks, each batch visible in all of them by one manifest.

    Read with `keyed.read` and the sinks of `keyed.site_sinks`; after `compact_every` batches the buckets they touch are merged.
    """
    sinks = keyed.site_sinks(spec, buckets)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hits = site_fields(batch, spec)
        records = BUILDERS[spec.site](hits, now, keep=(seq,)).withColumnRenamed(seq, "seq").persist()
        try:
            rows = sink_rows(records, to_catalog(records, spec.site, keep=("seq",)), spec)
            keyed.commit(spark, root, batch_id, {sink: rows[sink.name] for sink in sinks})
        finally:
            records.unpersist()
        if keyed.deltas(spark, root, sinks[0]) >= compact_every:
            keyed.compact(spark, root, sinks)

    return (pages.writeStream.foreachBatch(ingest)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())
