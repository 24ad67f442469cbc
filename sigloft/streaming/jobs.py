"""Streams over landed files.

Every sink folder is partitioned by micro-batch id and a batch overwrites its own partition only, so replaying a batch
after a failure neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloft.operators.keyed import latest_per_key
from sigloft.session import stateful_session


def open_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append") -> list:
    """Processes everything that has landed, then stops; returns the progress of its batches."""
    query = (
        stream.writeStream.foreachBatch(each_batch).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


def _store(batch: DataFrame, folder: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def _earlier(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """What earlier batches have stored; empty before the first."""
    try:
        return spark.read.parquet(folder).where(F.col("batch") < batch_id)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("batch", T.IntegerType())]))


# -- windows --------------------------------------------------------------------------------------------------------
def window_totals(stream: DataFrame, moment: str, key: str, value: str, width: str, slide: str | None = None,
                  late: str = "1 hour") -> DataFrame:
    """Count and sum per key and (tumbling or sliding) window; windows older than the watermark leave the state."""
    window = F.window(moment, width, slide) if slide else F.window(moment, width)
    return (
        stream.withWatermark(moment, late).groupBy(window.alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.unix_timestamp("w.start").alias("window_sec"), key, "n", "total")
    )


def drain_windows(totals: DataFrame, key: str, folder: str, checkpoint: str) -> DataFrame:
    """Window rows are stored per batch in update mode; the row of the highest batch is the current one."""
    spark = totals.sparkSession
    drain(totals, checkpoint, lambda batch, i: _store(batch, folder, i), "update")
    return latest_per_key(spark.read.parquet(folder), ["window_sec", key], "batch").drop("batch")


# -- seen keys ------------------------------------------------------------------------------------------------------
def first_seen(stream: DataFrame, moment: str, key: str, memory: str) -> DataFrame:
    """One row per key as long as its repeats arrive within ``memory``; older keys leave the state."""
    return stream.withWatermark(moment, memory).dropDuplicatesWithinWatermark([key])


def unseen(stream: DataFrame, key: str, newest: Sequence[str]) -> DataFrame:
    """The first row of every key ever seen, without a time limit; of the rows of one batch the newest.

    Seen keys are state by key, so a batch meets only the state of its own keys, however many came before. The state holds one flag per
    key; it lives in RocksDB, on disk, and its checkpoints are increments (``stateful_session``).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    order = list(newest)

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "seen boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            if self.seen.exists():
                return
            best = None
            for chunk in rows:
                both = chunk if best is None else pd.concat([best, chunk])
                best = both.sort_values(order, ascending=False, na_position="last", kind="stable").head(1)
            if best is not None:
                self.seen.update((True,))
                yield best.reset_index(drop=True)

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Seen(), outputStructType=stream.schema, outputMode="Append", timeMode="None")


def drain_unseen(stream: DataFrame, key: str, newest: Sequence[str], folder: str, checkpoint: str) -> DataFrame:
    """Keys never stored before, without a time limit (see :func:`unseen`); the sink is only written."""
    spark = stateful_session(stream.sparkSession)
    drain(unseen(stream, key, newest), checkpoint, lambda batch, i: _store(batch, folder, i))
    return spark.read.parquet(folder).drop("batch")


# -- upserts --------------------------------------------------------------------------------------------------------
def drain_upserts(stream: DataFrame, keys: Sequence[str], newest: Sequence[str], current: str, history: str,
                  checkpoint: str) -> DataFrame:
    """Every batch goes to the history as it is and to the current log reduced to one row per key."""
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        _store(batch, history, batch_id)
        _store(latest_per_key(spark.read.parquet(f"{history}/batch={batch_id}"), keys, *newest), current, batch_id)

    drain(stream, checkpoint, take)
    return latest_per_key(spark.read.parquet(current).drop("batch"), keys, *newest)


# -- watermark per source ---------------------------------------------------------------------------------------------
def drain_by_source(stream: DataFrame, source: str, moment: str, fresh: str, late: str, marks: str,
                    checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Rows behind the watermark of their source are taken, the others go to a side table instead of being dropped.

    The watermark of a source is the newest time taken from it by earlier batches. It is kept in a table of one row per source, of
    which each batch reads the last state and writes the next, so the sink is not read again.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        state = T.StructType([batch.schema[source], T.StructField("_mark", batch.schema[moment].dataType)])
        known = _earlier(spark, marks, batch_id, state).where(F.col("batch") == batch_id - 1).select(source, "_mark")
        marked = batch.join(known, source, "left")
        is_fresh = F.col("_mark").isNull() | (F.col(moment) > F.col("_mark"))
        _store(marked.where(~is_fresh).drop("_mark"), late, batch_id)
        _store(marked.where(is_fresh).drop("_mark"), fresh, batch_id)
        taken = spark.read.schema(batch.schema).parquet(f"{fresh}/batch={batch_id}").select(source, F.col(moment).alias("_mark"))
        _store(known.union(taken).groupBy(source).agg(F.max("_mark").alias("_mark")), marks, batch_id)

    drain(stream, checkpoint, take)
    return spark.read.parquet(fresh).drop("batch"), spark.read.parquet(late).drop("batch")
