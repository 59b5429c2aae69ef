"""Page tables, seen files and inline rows as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfspark.operators.links import clean_fingerprints
from shelfspark.schemas import PAGES
from shelfspark.sources.manifest import files_at


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages, with a fixed schema so no file is opened to infer one."""
    return spark.read.schema(PAGES).parquet(path)


def stream_files(spark: SparkSession, folder: str, schema: T.StructType,
                 file_glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """The parquet files of a folder as a stream."""
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", str(files_per_batch))
            .parquet(folder))


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream, whether it is one Parquet file or a folder of part files."""
    files, at = files_at(spark, path)
    if files.getFileStatus(at).isDirectory():
        # as a scan does, all files count that are not hidden
        return stream_files(spark, path, schema, "*", files_per_batch)
    return stream_files(spark, path.rstrip("/").rpartition("/")[0] or ".", schema, at.getName(), files_per_batch)


def scan_seen(spark: SparkSession, path: str) -> DataFrame:
    """A seen file: one fingerprint per line, any mix of CR and LF at the end."""
    return clean_fingerprints(spark.read.text(path))


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """Rows written in the program, as a seed load."""
    return spark.createDataFrame(list(rows), schema)
