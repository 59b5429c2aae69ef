"""Keyed tables: conform to the rules, upsert, replace, delete, fan out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import to_count
from shelfspark.schemas import ColumnRule, SourceSpec

REJECT = "reject"


def _typed(raw: Column, rule: ColumnRule, is_text: bool) -> Column:
    if rule.dtype == "string":
        return raw.cast("string")
    if rule.dtype == "int" and is_text:
        return to_count(raw)
    return raw.try_cast(rule.dtype)


def conform(df: DataFrame, rules: Sequence[ColumnRule], keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns of a table plus `reject`: null, or what is wrong with the row.

    A column the input lacks gets its default. A value of the wrong type, a
    null where none may be and a text over its limit are named, not repaired.
    """
    columns, faults = [], []
    types = dict(df.dtypes)
    for rule in rules:
        if rule.name in types:
            raw = F.col(rule.name)
            value = _typed(raw, rule, types[rule.name] == "string")
            faults.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"type:{rule.name}")))
            if rule.max_chars:
                faults.append(F.when(F.length(value) > rule.max_chars, F.lit(f"long:{rule.name}")))
            if not rule.nullable:
                faults.append(F.when(raw.isNull(), F.lit(f"null:{rule.name}")))
        else:
            value = F.lit(rule.default).cast(rule.dtype)
            if not rule.nullable and rule.default is None:
                faults.append(F.lit(f"null:{rule.name}"))
        columns.append(value.alias(rule.name))
    reject = F.nullif(F.concat_ws(";", *faults), F.lit("")).alias(REJECT)
    return df.select(*keep, *columns, reject)


def accepted(conformed: DataFrame) -> DataFrame:
    return conformed.filter(F.col(REJECT).isNull()).drop(REJECT)


def rejected(conformed: DataFrame) -> DataFrame:
    return conformed.filter(F.col(REJECT).isNotNull())


def merge_versions(versions: DataFrame, columns: Sequence[str], key: str,
                   update_cols: Sequence[str], order: Column) -> DataFrame:
    """All versions of a keyed table -> its current rows.

    Updated columns come from the newest version, nulls included; the others
    from the oldest. One partial aggregate and one shuffle: a key that holds a
    third of all versions is reduced to one row per task before it moves.
    """
    kept = [c for c in columns if c != key and c not in update_cols]
    newest = [c for c in columns if c in update_cols]
    aggregates = []
    if newest:
        aggregates.append(F.max_by(F.struct(*newest), order).alias("newest"))
    if kept:
        aggregates.append(F.min_by(F.struct(*kept), order).alias("oldest"))
    merged = versions.groupBy(key).agg(*aggregates)
    return merged.select(*[
        F.col(key) if c == key else F.col(("newest." if c in newest else "oldest.") + c).alias(c)
        for c in columns])


def upsert(existing: DataFrame | None, incoming: DataFrame, spec: SourceSpec,
           seq: str = "seq") -> DataFrame:
    """Merge new records into a table by the site's key and update columns."""
    rows = incoming
    if existing is not None:
        rows = existing.withColumn(seq, F.lit(-1).cast(incoming.schema[seq].dataType)).unionByName(
            incoming)
    columns = [c for c in incoming.columns if c != seq]
    return merge_versions(rows, columns, spec.key, spec.update_cols, F.col(seq))


def replace_by_id(documents: DataFrame, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Whole-document replace: the last version of each document."""
    columns = [c for c in documents.columns if c not in (doc_id, seq)]
    last = documents.groupBy(doc_id).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("last"))
    return last.select(doc_id, *[F.col(f"last.{c}").alias(c) for c in columns])


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def sink_rows(records: DataFrame, documents: DataFrame, spec: SourceSpec, seq: str = "seq") -> dict[str, DataFrame]:
    """What the index, table and reject sinks get of one batch.

    `documents` carries the catalogue row of each record under `doc_id`. A
    record without an id is refused by the index and reaches neither sink; one
    that breaks a table rule stays in the index and is kept with its fault.
    """
    conformed = conform(records, spec.rules, keep=[seq])
    has_id = F.col(spec.key).isNotNull()
    return {
        "index": documents.filter(F.col("doc_id").isNotNull()),
        "table": accepted(conformed.filter(has_id)),
        "rejects": rejected(conformed).withColumn(
            "sink", F.when(has_id, F.lit("table")).otherwise(F.lit("index"))),
    }


def fan_out(records: DataFrame, documents: DataFrame, spec: SourceSpec, batch_id: int,
            root: str, seq: str = "seq") -> None:
    """Write one batch to the index sink, then to the table sink.

    Each sink writes the folder of its batch anew, so a batch that runs again
    after a failure leaves the same files.
    """
    for sink, rows in sink_rows(records, documents, spec, seq).items():
        rows.write.mode("overwrite").parquet(_batch_path(f"{root}/{spec.site}/{sink}", batch_id))


def read_sink(spark: SparkSession, root: str, spec: SourceSpec, sink: str) -> DataFrame:
    """All batches of a sink, with `batch_id`."""
    return spark.read.parquet(f"{root}/{spec.site}/{sink}")


def current_table(spark: SparkSession, root: str, spec: SourceSpec, seq: str = "seq") -> DataFrame:
    """Rows of the table sink after all batches, merged when read."""
    rows = read_sink(spark, root, spec, "table")
    order = F.struct(F.col("batch_id").cast("bigint"), F.col(seq))
    columns = [r.name for r in spec.rules]
    return merge_versions(rows, columns, spec.key, spec.update_cols, order)


def current_index(spark: SparkSession, root: str, spec: SourceSpec, seq: str = "seq") -> DataFrame:
    """Documents of the index sink after all batches."""
    rows = read_sink(spark, root, spec, "index")
    order = F.struct(F.col("batch_id").cast("bigint"), F.col(seq))
    return replace_by_id(rows.withColumn("_order", order).drop("batch_id", seq), seq="_order")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
