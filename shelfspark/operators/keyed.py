"""Keyed tables on files: a base in key buckets, deltas of batches, compaction of touched buckets, several sinks under one manifest.

A batch writes its rows of every sink as deltas and becomes visible by one manifest, so a reader sees it in all sinks or in
none; a batch that runs again changes nothing.  A read merges base and deltas.  Compaction merges only buckets that deltas
touch and writes them anew; all other files keep their names.  A delta is as wide as its batch, so no write rewrites the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfspark.operators.tables import merge_versions
from shelfspark.schemas import SourceSpec
from shelfspark.sources import manifest

ENTRY = "sink string, kind string, bucket int, batch long, path string"
BUCKETS = 64
# the order of versions: rows of the base come before those of any batch
BATCH, SEQ = "_batch", "_seq"


class Sink(NamedTuple):
    """A keyed table: `combine` turns all versions of some keys (with BATCH and SEQ) into their current rows."""

    name: str
    key: str
    combine: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS


class _State(NamedTuple):
    base: dict[int, str]
    deltas: list[str]
    schema: StructType | None


def version_order() -> Column:
    return F.struct(BATCH, SEQ)


def _columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (BATCH, SEQ)]


def upserted(spec: SourceSpec) -> Callable[[DataFrame], DataFrame]:
    """A site's merge: updated columns from the newest version, the others from the oldest."""
    return lambda rows: merge_versions(rows, _columns(rows), spec.key, spec.update_cols, version_order())


def replaced(key: str) -> Callable[[DataFrame], DataFrame]:
    """The whole newest version of each key."""
    def run(rows: DataFrame) -> DataFrame:
        return merge_versions(rows, _columns(rows), key, [c for c in _columns(rows) if c != key], version_order())
    return run


def summed(key: str, amount: str) -> Callable[[DataFrame], DataFrame]:
    """Amounts of a key added up."""
    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.sum(amount).cast("bigint").alias(amount))
    return run


def _state(spark: SparkSession, root: str, sink: Sink, version: int | None = None) -> _State:
    own = [e for e in manifest.entries(spark, root, version) if e["sink"] == sink.name]
    schema = next((StructType.fromJson(json.loads(e["path"])) for e in own if e["kind"] == "schema"), None)
    return _State({e["bucket"]: e["path"] for e in own if e["kind"] == "base"},
                  [e["path"] for e in own if e["kind"] == "delta"], schema)


def _bucket(sink: Sink) -> Column:
    return F.pmod(F.xxhash64(sink.key), F.lit(sink.buckets)).cast("int")


def _write(rows: DataFrame, sink: Sink, path: str) -> None:
    """In folders by bucket; a bucket is cut at keys into several tasks when it is large."""
    (rows.withColumn("bucket", _bucket(sink)).repartitionByRange("bucket", sink.key)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def _touched(spark: SparkSession, paths: Sequence[str]) -> set[int]:
    return {int(name[7:]) for path in paths for name in manifest.children(spark, path) if name.startswith("bucket=")}


def applied(spark: SparkSession, root: str) -> int:
    """The last batch that is visible; -1 before the first."""
    return max((e["batch"] for e in manifest.entries(spark, root) if e["kind"] == "batch"), default=-1)


def commit(spark: SparkSession, root: str, batch_id: int, parts: Mapping[Sink, DataFrame], seq: str = "seq") -> bool:
    """Write one batch to all its sinks; False if it is visible already.

    Batches come in ascending order.  All deltas are written first; what a batch leaves that stops before its
    manifest is overwritten when it runs again.
    """
    known = manifest.entries(spark, root)
    if any(e["kind"] == "batch" and e["batch"] >= batch_id for e in known):
        return False
    fresh: list[tuple] = [("", "batch", -1, batch_id, "")]
    for sink, rows in parts.items():
        order = F.col(seq).cast("bigint") if seq in rows.columns else F.lit(0).cast("bigint")
        # what a batch alone says about a key is one row a version still: the merge needs the oldest and the newest
        delta = rows.select(*[c for c in rows.columns if c != seq], F.lit(batch_id).cast("bigint").alias(BATCH), order.alias(SEQ))
        path = f"{root}/{sink.name}/batch={batch_id}"
        _write(delta, sink, path)
        fresh.append((sink.name, "delta", -1, batch_id, path))
        if not any(e["sink"] == sink.name and e["kind"] == "schema" for e in known):
            fresh.append((sink.name, "schema", -1, batch_id, delta.schema.json()))
    kept = [tuple(e) for e in known if e["kind"] != "batch"]
    manifest.publish(spark, root, manifest.latest(spark, root) + 1, kept + fresh, ENTRY)
    return True


def _rows(spark: SparkSession, state: _State, buckets: set[int] | None = None) -> DataFrame:
    """All versions in base and deltas, of some buckets or all."""
    empty = spark.createDataFrame([], state.schema)
    base = [p for b, p in sorted(state.base.items()) if p and (buckets is None or b in buckets)]
    columns = [f.name for f in state.schema]
    out = spark.read.schema(state.schema).parquet(*base) if base else empty
    if state.deltas:
        with_bucket = StructType([*state.schema.fields, StructField("bucket", IntegerType())])
        # one scan for all deltas: their folders differ by batch alone
        root = state.deltas[0].rsplit("/", 1)[0]
        deltas = spark.read.schema(with_bucket).option("basePath", root).parquet(*state.deltas)
        if buckets is not None:
            deltas = deltas.filter(F.col("bucket").isin(sorted(buckets)))
        out = out.unionByName(deltas.select(columns))
    return out


def read(spark: SparkSession, root: str, sink: Sink, version: int | None = None) -> DataFrame:
    """The current rows."""
    state = _state(spark, root, sink, version)
    if state.schema is None:
        raise ValueError(f"{sink.name} has no batch yet")
    return sink.combine(_rows(spark, state))


def compact(spark: SparkSession, root: str, sinks: Sequence[Sink]) -> int:
    """Merge the deltas of the sinks into their bases and return the version.

    Only buckets that a delta touches are read and written.  Without deltas nothing changes.
    """
    version = manifest.latest(spark, root) + 1
    known = [tuple(e) for e in manifest.entries(spark, root)]
    done = False
    for sink in sinks:
        state = _state(spark, root, sink)
        if not state.deltas:
            continue
        touched = _touched(spark, state.deltas)
        path = f"{root}/{sink.name}/base=v{version}"
        merged = sink.combine(_rows(spark, state, touched))
        _write(merged.withColumn(BATCH, F.lit(-1).cast("bigint")).withColumn(SEQ, F.lit(0).cast("bigint")), sink, path)
        there = _touched(spark, [path])
        known = [e for e in known if e[0] != sink.name or e[1] == "schema" or (e[1] == "base" and e[2] not in touched)]
        known += [(sink.name, "base", b, -1, f"{path}/bucket={b}") for b in sorted(touched & there)]
        done = True
    if not done:
        return version - 1
    manifest.publish(spark, root, version, known, ENTRY)
    return version


def deltas(spark: SparkSession, root: str, sink: Sink) -> int:
    """Batches that a read merges on top of the base."""
    return len(_state(spark, root, sink).deltas)


def site_sinks(spec: SourceSpec, buckets: int = BUCKETS) -> tuple[Sink, Sink, Sink]:
    """The index, table and reject sinks of a site."""
    return (Sink("index", "doc_id", replaced("doc_id"), buckets), Sink("table", spec.key, upserted(spec), buckets),
            Sink("rejects", spec.key, _all_versions, buckets))


def _all_versions(rows: DataFrame) -> DataFrame:
    return rows.select(_columns(rows))
