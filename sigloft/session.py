"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "sigloft", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All times are UTC instants; dates and buckets are cut in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def stateful_session(spark: SparkSession) -> SparkSession:
    """Keyed state lives in RocksDB, on disk, so that it may outgrow the memory of an executor."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    return spark


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Python operators on long texts get at most ``rows`` rows at once, so that neither side of the pipe holds many texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor must be able to reach.

    Only a local master may run without that setting; it gets one folder of its own per application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        if context.applicationId not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="sigloft-")
        base = _LOCAL_SCRATCH[context.applicationId]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Used where a costly result has several readers: it is computed once, its lineage ends here, and a lost executor costs
    a re-read instead of a recomputation.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_together(**frames: DataFrame) -> dict[str, DataFrame]:
    """Stores several independent intermediates at the same time, so that small ones do not wait for large ones."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(zip(frames, pool.map(lambda name: stored(frames[name], name), frames)))


def spread(df: DataFrame) -> DataFrame:
    """Gives every core work when a scan has fewer splits than cores but each row is expensive (long texts).

    A scan that already fills the cores is left alone, so this adds no shuffle to large inputs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
