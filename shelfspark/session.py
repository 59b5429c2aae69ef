"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a table of a few short columns with this many rows stays near 20 MB
BROADCAST_ROWS = 200_000
# of compressed Parquet
BROADCAST_BYTES = 8 << 20
# what one task reads of a scan
SPLIT_BYTES = 128 << 20

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even when that costs one more shuffle later on
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a page can be hundreds of KB, so keep the Arrow batches short
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.parquet.filterPushdown": "true",
    # dedup state of the crawl frontier outgrows the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above.

    The shuffle width is left to the cluster's own setting (AQE coalesces it);
    only a local master gets a small one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.sql.shuffle.partitions", "8")
                       .config("spark.ui.enabled", "false")
                       .config("spark.ui.showConsoleProgress", "false"))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by `spark.checkpoint.dir`.

    Only a local session without the setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    path = sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="shelfspark-")
    sc.setCheckpointDir(path)
    return path


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder inside the shared one."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the application's folder that no other job uses."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Remove the application's intermediate tables, once all results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, compression: str = "snappy") -> str:
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder: its lineage ends, and readers prune its columns."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, "zstd"))


def _file_bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def sized(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, and marked for broadcast if it is small.

    Rows and bytes are those of the written table, not an estimate; beyond either limit the
    join shuffles.
    """
    spark = df.sparkSession
    path = _write(df)
    written = spark.read.schema(df.schema).parquet(path)
    small = _file_bytes(spark, path) <= BROADCAST_BYTES and written.count() <= BROADCAST_ROWS
    return F.broadcast(written) if small else written


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores when its scan would leave half of them idle.

    For steps that cost much time per row. The size is the optimizer's, which for a
    scan is that of its files; nothing is run. A large table and a stream are left
    as they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES // 2 else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, which else find it only beside a driver of the same machine.

    Once per application; Spark's own file service hands the archive to executors that join later.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="shelfspark-"), "shelfspark"), "zip",
                                  os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
