"""Versioned Parquet tables: each write makes a new version folder and then names it in a small manifest.

Readers take the highest version in the manifest, so a reader never sees a half-written table and a job may rewrite the
table it reads. One writer per table at a time. Where a catalog with row-level MERGE exists, ``merge`` is the function to
replace; its signature does not depend on the format.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.operators.keyed import latest_per_key
from sigloft.operators.ordered import running
from sigloft.session import stored


def current_version(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("version bigint").parquet(f"{path}/_versions").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version yet")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/v={version:06d}")


def overwrite(df: DataFrame, path: str) -> int:
    """A new version that replaces the table; the schema may change."""
    spark = df.sparkSession
    version = (current_version(spark, path) or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={version:06d}")
    spark.range(version, version + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{path}/_versions")
    return version


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """History append; new columns are allowed, readers unite by name."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def merge(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> int:
    """Update all / insert all: the batch row wins over the stored row of its key, the newest row within the batch.

    Two aggregating cuts and one anti join: stored rows are only re-read, never sorted per key.
    """
    fresh = latest_per_key(batch, keys, *newest)
    if current_version(spark, path) is None:
        return overwrite(fresh, path)
    kept = read(spark, path).join(fresh.select(*keys), list(keys), "left_anti")
    return overwrite(kept.unionByName(fresh, allowMissingColumns=True), path)


def rebuild(spark: SparkSession, path: str, history: DataFrame, batch: DataFrame, keys: Sequence[str],
            newest: Sequence[str]) -> int:
    """Current table from history and batch, for when a merge cannot be done."""
    return overwrite(latest_per_key(history.unionByName(batch, allowMissingColumns=True), keys, *newest), path)


def log_upsert(batch: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str]) -> None:
    """Upsert by appending: cost grows with the batch, not with the table. Read with :func:`read_upserts`."""
    latest_per_key(batch, keys, *newest).write.mode("append").parquet(path)


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    return latest_per_key(read_history(spark, path), keys, *newest)


def append_once(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str]) -> None:
    """Each key once, also within the batch; re-running the same batch adds nothing, and late rows of another are still added."""
    batch = batch.dropDuplicates(list(keys))
    try:
        seen = spark.read.parquet(path).select(*keys)
    except AnalysisException:
        append(batch, path)
        return
    append(batch.join(seen, list(keys), "left_anti"), path)


def snapshot_and_history(df: DataFrame, snapshot: str, history: str) -> None:
    """The same batch as the current snapshot and as a history append, computed once."""
    spark = df.sparkSession
    version = overwrite(df, snapshot)
    append(spark.read.parquet(f"{snapshot}/v={version:06d}"), history)


def update_where(spark: SparkSession, path: str, condition: Column, changes: dict[str, Column]) -> int:
    """Rewrites some columns of the rows that meet the condition."""
    table = read(spark, path)
    hit = F.coalesce(condition, F.lit(False))
    updated = table.withColumns({
        c: F.when(hit, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in changes.items()
    })
    return overwrite(updated, path)


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 0.0) -> list[str]:
    """Deletes versions that still exist, except the newest ``keep`` and those written in the last ``older_than`` seconds.

    Returns the deleted folders. A reader of an old version is safe for as long as ``older_than``.
    """
    version = current_version(spark, path) or 0
    store, base = fs.FileSystem.from_uri(path)
    gone = []
    for info in sorted(store.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda x: x.base_name):
        if not (info.base_name.startswith("v=") and int(info.base_name[2:]) <= version - keep):
            continue
        if info.mtime_ns is None or time.time() - info.mtime_ns / 1e9 >= older_than:
            store.delete_dir(info.path)
            gone.append(info.base_name)
    return gone


# -- tables laid out by a hash of the key -----------------------------------------------------------------------------
BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")


def _bucket_folder(spark: SparkSession, path: str, buckets: int) -> tuple[str, bool]:
    """Where the table is, and whether it has rows yet. The number of buckets is part of the name, so it can't change unnoticed."""
    store, base = fs.FileSystem.from_uri(path)
    found = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith(("of-", "log-"))]
    if found and found != [f"of-{buckets}"]:
        raise ValueError(f"{path} is laid out as {found[0]}, not of-{buckets}")
    return f"{path}/of-{buckets}", bool(found)


def read_buckets(spark: SparkSession, path: str, buckets: int = BUCKETS, select: Sequence[Column | str] = ("*",)) -> DataFrame:
    """The table's rows. ``select`` is taken before replaced rows are left out, so that wide columns need not travel for that."""
    if (version := current_version(spark, path)) is not None:
        return _standing(spark, path, buckets, version, select)
    folder, exists = _bucket_folder(spark, path, buckets)
    if not exists:
        raise FileNotFoundError(f"{path} has no rows yet")
    return spark.read.option("mergeSchema", True).parquet(folder).drop("_bucket").select(*select)


def _standing(spark: SparkSession, path: str, buckets: int, version: int, select: Sequence[Column | str]) -> DataFrame:
    """The rows of all versions up to ``version``, without those whose key a later one has replaced."""
    folder = _log_folder(path, buckets)
    rows = spark.read.option("mergeSchema", True).parquet(f"{folder}/rows").where(F.col("_version") <= version).drop("_bucket")
    gone = spark.read.parquet(f"{folder}/replaced").where(F.col("_version") <= version)
    if gone.isEmpty():
        return rows.drop("_version").select(*select)
    [key] = [c for c in gone.columns if c != "_version"]
    latest = gone.groupBy(F.col(key).alias("_gone")).agg(F.max("_version").alias("_since"))
    taken = rows.select(F.col(key).alias("_key"), F.col("_version").alias("_of"), *select)
    return taken.join(latest, (F.col("_key") == F.col("_gone")) & (F.col("_of") < F.col("_since")), "left_anti").drop("_key", "_of", "_version")


def _log_folder(path: str, buckets: int) -> str:
    """The folder of a table written by :func:`replace_buckets`; as with ``_bucket_folder`` the number of buckets can't change unnoticed."""
    store, base = fs.FileSystem.from_uri(path)
    found = [i.base_name for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith(("of-", "log-"))]
    if found and found != [f"log-{buckets}"]:
        raise ValueError(f"{path} is laid out as {found[0]}, not log-{buckets}")
    return f"{path}/log-{buckets}"


def _touched(spark: SparkSession, folder: str, keyed: DataFrame) -> DataFrame:
    """The stored rows of the buckets that ``keyed`` has rows of; their numbers, at most as many as there are buckets, prune the scan."""
    numbers = [r[0] for r in keyed.select("_bucket").distinct().collect()]
    return spark.read.option("mergeSchema", True).parquet(folder).where(F.col("_bucket").isin(numbers) if numbers else F.lit(False))


def _write_buckets(rows: DataFrame, folder: str) -> None:
    """Replaces the buckets that ``rows`` has rows of, and no other. Large buckets are split into several files by their size."""
    rows.hint("rebalance", F.col("_bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)


def merge_buckets(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], newest: Sequence[str], buckets: int = BUCKETS) -> None:
    """Update all / insert all as :func:`merge`, on a table laid out by a hash of the key: only the buckets with keys of the batch are read
    and written again, so the cost follows the batch (a batch of few keys touches few buckets) and not the table.

    One writer at a time. Spark writes beside the table and moves the finished buckets in at the end; a run that fails before that
    changes nothing, and repeating a batch gives the same table.
    """
    folder, exists = _bucket_folder(spark, path, buckets)
    fresh = latest_per_key(batch, keys, *newest).withColumn("_bucket", _bucket(keys, buckets))
    if exists:
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
        kept = _touched(spark, folder, fresh).join(fresh.select(*(F.col(k).alias(f"_new_{k}") for k in keys)), same, "left_anti")
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
    _write_buckets(fresh, folder)


def replace_buckets(spark: SparkSession, path: str, batch: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """All stored rows of the batch's keys go and the batch's rows come, however many a key has. Rows with a null key only come.

    A batch writes its own rows, by buckets, and those of their keys that the table has already, for which only the keys in the batch's
    buckets are read. Older rows of such keys stay in their files and are left out by :func:`read_buckets`, so no stored row is moved or
    written again. A version counts once it is named in the manifest, so a run that fails before that changes nothing, and the next one
    takes the same number. One writer at a time. ``settle_buckets`` writes the table anew without replaced rows.
    """
    folder, known = _log_folder(path, buckets), current_version(spark, path)
    version = (known or 0) + 1
    to = f"{folder}/rows/_version={version}"
    batch.withColumn("_bucket", _bucket([key], buckets)).hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(to)
    rows = spark.read.schema(batch.schema).parquet(to)
    if rows.isEmpty():
        return
    keys = rows.select(key).distinct()
    if known is None:
        keys = keys.where(F.lit(False))
    else:
        numbers = [r[0] for r in keys.select(_bucket([key], buckets)).distinct().collect()]
        older = spark.read.parquet(f"{folder}/rows").where((F.col("_version") <= known) & F.col("_bucket").isin(numbers))
        keys = keys.join(older.select(key), key, "left_semi")
    keys.write.mode("overwrite").parquet(f"{folder}/replaced/_version={version}")
    spark.range(version, version + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{path}/_versions")


def settle_buckets(spark: SparkSession, path: str, target: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes the table anew to ``target``, without the rows that batches have replaced."""
    replace_buckets(spark, target, read_buckets(spark, path, buckets), key, buckets)


def update_buckets(spark: SparkSession, path: str, hits: DataFrame, keys: Sequence[str], condition: Column, changes: dict[str, Column],
                   buckets: int = BUCKETS) -> None:
    """Rewrites some columns of the rows whose key is in ``hits`` and that meet the condition; only their buckets are written again."""
    folder, exists = _bucket_folder(spark, path, buckets)
    if not exists:
        raise FileNotFoundError(f"{path} has no rows yet")
    named = hits.select(*keys).distinct().withColumn("_bucket", _bucket(keys, buckets))
    stored_rows = _touched(spark, folder, named)
    marked = stored_rows.join(named.drop("_bucket").withColumn("_hit", F.lit(True)), list(keys), "left")
    hit = F.coalesce(F.col("_hit") & condition, F.lit(False))
    changed = marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(stored_rows.schema[c].dataType) for c, v in changes.items()})
    _write_buckets(changed.select(*stored_rows.columns), folder)


# -- compaction -------------------------------------------------------------------------------------------------------
def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Small files to ``files`` files, spread evenly (not one file by one task)."""
    read_history(spark, source).repartition(files).write.mode("overwrite").parquet(target)


def small_file_bins(spark: SparkSession, path: str, target_bytes: int) -> DataFrame:
    """``path, length, bin``: the files under half the target, packed in order of their paths into bins of about the target.

    A bin takes files while their running size stays in it, so a bin is at most half a target over it. Listed, not opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    small = listed.select("path", "length").where(F.col("length") * 2 < target_bytes)
    summed = running(small, [], [F.col("path")], sums={"_upto": F.col("length")})
    return summed.select("path", "length", F.floor((F.col("_upto") - F.col("length")) / target_bytes).cast("int").alias("bin"))


def compact_by_size(spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> int:
    """Packs the small files of a history into files of about the target size; larger ones are not read. Returns the number of new files.

    The new files are written to a folder that readers skip; then a list of the old ones is put beside them, the new ones are moved in and
    the old ones deleted. With the list there, the next call first finishes what an interrupted one left. No reader or writer at a time.
    """
    store, base = fs.FileSystem.from_uri(path)
    _finish(spark, store, base, path)
    bins = stored(small_file_bins(spark, path, target_bytes), "bins")
    if bins.count() < 2:
        return 0
    n = bins.agg(F.max("bin")).first()[0] + 1
    named = bins.select(F.col("path").alias("_path"), "bin")
    files = [r[0] for r in named.select("_path").toLocalIterator()]
    rows = spark.read.option("mergeSchema", True).parquet(*files).withColumn("_path", F.col("_metadata.file_path"))
    packed = rows.join(F.broadcast(named) if len(files) < 100_000 else named, "_path")
    packed.repartitionById(n, "bin").drop("_path", "bin").write.parquet(f"{path}/_compacting/new")
    named.select("_path").write.parquet(f"{path}/_compacting/old")
    _finish(spark, store, base, path)
    return n


def _finish(spark: SparkSession, store: fs.FileSystem, base: str, path: str) -> None:
    """Moves the files of a finished packing in and deletes those it replaces; clears an unfinished one away."""
    work = f"{base}/_compacting"
    if store.get_file_info(f"{work}/old/_SUCCESS").type != fs.FileType.NotFound:
        for info in store.get_file_info(fs.FileSelector(f"{work}/new", allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                store.move(info.path, f"{base}/{info.base_name}")
        for row in spark.read.parquet(f"{path}/_compacting/old").toLocalIterator():
            old = fs.FileSystem.from_uri(row[0])[1]
            if store.get_file_info(old).type != fs.FileType.NotFound:
                store.delete_file(old)
    if store.get_file_info(work).type != fs.FileType.NotFound:
        store.delete_dir(work)
