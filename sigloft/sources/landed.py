"""Scans of landed files: snapshots, feeds, delimited files, JSON payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from sigloft.functions import fixed_values as fv
from sigloft.session import stored
from sigloft.sources import schemas

LATEST = "latest.parquet"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet", modified_after: str | None = None,
               skip: Sequence[str] = (LATEST,)) -> DataFrame:
    """path, modified: a recursive listing without opening the files (file contents are never read)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(folder).select("path", F.col("modificationTime").alias("modified"))
    if not skip:
        return files
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip])))


def file_schemas(spark: SparkSession, folder: str, pattern: str = "*.parquet", modified_after: str | None = None) -> DataFrame:
    """``path, schema, error`` of each Parquet file: its Spark schema as JSON, or why its footer can't be read. Tasks read the footers."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"path": batch.column("path").to_pylist(), "schema": [], "error": []}
            for path in found["path"]:
                own = error = None
                try:
                    store, place = fs.FileSystem.from_uri(path)
                    with store.open_input_file(place) as file:
                        own = from_arrow_schema(pq.read_schema(file)).json()
                except (pa.ArrowException, OSError, PySparkException) as e:
                    error = f"{type(e).__name__}: {e}".splitlines()[0]
                found["schema"].append(own)
                found["error"].append(error)
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([(c, pa.string()) for c in found]))

    listed = list_files(spark, folder, pattern, modified_after).select("path")
    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(footers, "path string, schema string, error string")


def read_drifting(spark: SparkSession, folder: str, schema: T.StructType, modified_after: str | None = None) -> DataFrame:
    return drifting_and_rejects(spark, folder, schema, modified_after)[0]


def drifting_and_rejects(spark: SparkSession, folder: str, schema: T.StructType, modified_after: str | None = None,
                         pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """All new files of a folder under one schema although their column types drift, and ``path, error`` of the files left out.

    Files are grouped by their own schema and each group is one scan, so the plan grows with the number of different schemas, not of
    files. Footers are read once, in tasks; the driver gets the paths behind the file watermark, which a scan has to be given.
    """
    found = stored(file_schemas(spark, folder, pattern, modified_after), "footers")
    groups: dict[str, list[str]] = {}
    for row in found.where("error IS NULL").select("schema", "path").toLocalIterator():
        groups.setdefault(row["schema"], []).append(row["path"])
    scans = [
        spark.read.schema(T.StructType.fromJson(json.loads(own))).option("ignoreCorruptFiles", True).parquet(*paths)
        for own, paths in groups.items()
    ]
    return schemas.union_by_name(scans, schema, spark), found.where("error IS NOT NULL").select("path", "error")


def read_union_by_name(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Files whose columns differ but whose types agree."""
    return spark.read.option("mergeSchema", True).option("pathGlobFilter", pattern).parquet(folder)


def newest_files(spark: SparkSession, folder: str, n: int, pattern: str = "*.parquet") -> list[str]:
    """Paths of the n most recently written files; n is a small constant of the caller."""
    top = list_files(spark, folder, pattern).orderBy(F.col("modified").desc(), F.col("path").desc()).limit(n)
    return [r["path"] for r in top.collect()]


def newest_folders(spark: SparkSession, folder: str, n: int, pattern: str = "*.parquet") -> list[str]:
    """Folders of the n snapshots written last, each of any number of files; n is a small constant of the caller."""
    files = list_files(spark, folder, pattern).select("modified", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("snapshot"))
    top = files.groupBy("snapshot").agg(F.max("modified").alias("modified")).orderBy(F.col("modified").desc(), F.col("snapshot").desc())
    return [r["snapshot"] for r in top.limit(n).collect()]


def newer_than(df: DataFrame, moment: str, watermark) -> DataFrame:
    """Rows strictly behind the watermark instant; no watermark keeps all rows."""
    return df if watermark is None else df.where(F.col(moment) > watermark)


def source_watermarks(target: DataFrame, source: str, moment: str) -> DataFrame:
    """One row per source: the newest instant already taken over."""
    return target.groupBy(source).agg(F.max(moment).alias("_watermark"))


def newer_than_per_source(df: DataFrame, watermarks: DataFrame, source: str, moment: str) -> DataFrame:
    """Rows behind the watermark of their own source; sources without one are taken whole.

    The watermark table has one row per feed. Its join side is chosen by Spark from its measured size.
    """
    fresh = F.col("_watermark").isNull() | (F.col(moment) > F.col("_watermark"))
    return df.join(watermarks, source, "left").where(fresh).drop("_watermark")


def read_feeds(spark: SparkSession, folder: str, schema: T.StructType, watermarks: DataFrame | None = None,
               modified_after: str | None = None) -> DataFrame:
    """Articles of all feed folders in one scan; the feed is the folder name."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.parquet(folder).where(~F.col("_metadata.file_path").contains(f"/{LATEST}"))
    named = rows.withColumn("feed_key", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return named if watermarks is None else newer_than_per_source(named, watermarks, "feed_key", "ingested_at")


def read_code_list(spark: SparkSession, path: str, code: str, label: str) -> DataFrame:
    """A two-column reference CSV with one row per code (the first label in text order when a code stands twice)."""
    rows = spark.read.csv(path, header=True, schema=f"{code} string, {label} string")
    return rows.groupBy(code).agg(F.min(label).alias(label))


def code_list(spark: SparkSession, rows: Sequence[tuple[str, str]], code: str, label: str) -> DataFrame:
    """A fixed code list; the first row of a repeated code wins."""
    first: dict[str, str] = {}
    for key, text in rows:
        first.setdefault(key, text)
    return fixed_rows(spark, list(first.items()), (code, label))


def fixed_rows(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small constant table as a local relation, so that its size is known to the planner."""
    return spark.createDataFrame(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}))


def read_csvs(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """CSV files with headers of their own, united by column name; types are inferred per file. No file: no rows, no columns."""
    paths = [r["path"] for r in list_files(spark, folder, pattern, skip=()).orderBy("path").collect()]
    frames = [spark.read.csv(p, header=True, inferSchema=True, enforceSchema=False) for p in paths]
    if not frames:
        return spark.createDataFrame([], T.StructType([]))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated world events: 61 text columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fv.EVENT_COLUMNS])
    return spark.read.csv(path, sep="\t", schema=schema)


REJECTED = "_rejected"


def parted(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows and rejected lines of a permissive scan, parted in one pass: both are written under ``folder`` and read back."""
    rows.withColumn("_bad", F.col(REJECTED).isNotNull()).write.partitionBy("_bad").parquet(folder)
    landed = rows.sparkSession.read.schema(rows.schema.add("_bad", "boolean")).parquet(folder)
    return landed.where("NOT _bad").drop("_bad", REJECTED), landed.where("_bad").select(REJECTED)


def _record_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in fv.RECORD_COLUMNS])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated document records: 27 text columns, no quoting, malformed lines dropped."""
    rows = spark.read.csv(path, sep="\t", schema=_record_schema(), quote="", mode="DROPMALFORMED")
    return rows.withColumn("SOURCEURL", F.col("DocumentIdentifier"))


def records_and_rejects(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_records`, with the lines of too few or too many columns as a table of their own; every line is in one of both."""
    rows = spark.read.csv(path, sep="\t", schema=_record_schema().add(REJECTED, "string"), quote="", mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED)
    kept, rejected = parted(rows, folder)
    return kept.withColumn("SOURCEURL", F.col("DocumentIdentifier")), rejected


def malformed_lines(spark: SparkSession, path: str, columns: int = len(fv.RECORD_COLUMNS)) -> DataFrame:
    """The lines that :func:`read_records` leaves out, for counting and repair."""
    return spark.read.text(path).where(F.size(F.split("value", "\t")) != columns)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_and_rejects(spark: SparkSession, path: str, schema: T.StructType, folder: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines under a declared schema, and the lines that are no JSON or don't fit it."""
    rows = spark.read.schema(T.StructType(schema.fields).add(REJECTED, "string")).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED)
    return parted(rows, folder)


def read_behind(spark: SparkSession, folder: str, schema: T.StructType, moment: str, watermark: DataFrame, slack: int = 3600,
                pattern: str = "*.parquet") -> DataFrame:
    """Rows behind a persisted watermark, skipped on two levels: files written over ``slack`` seconds before it are not opened, and of the
    others the rows not behind it are dropped.

    ``watermark``: one row, one timestamp (null: none yet). A file may be finished after rows that came later, hence the slack.
    """
    mark = watermark.toDF("mark").agg(F.max("mark").alias("mark")).select("mark", F.date_format(F.col("mark") - F.make_dt_interval(secs=F.lit(slack)), "yyyy-MM-dd'T'HH:mm:ss").alias("files")).first()
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if mark["mark"] is None:
        return reader.parquet(folder)
    rows = reader.option("modifiedAfter", mark["files"]).option("timeZone", spark.conf.get("spark.sql.session.timeZone")).parquet(folder)
    return rows.where(F.col(moment) > watermark.toDF("mark").agg(F.max("mark")).scalar())


def payload_rows(payloads: DataFrame, series: str, ingested_at: str, status: str) -> DataFrame:
    """Landed API pages (an array column ``markets``) to one row per market, nested values kept as JSON text."""
    markets = payloads.select(
        F.explode("markets").alias("m"), F.col(series).alias("series_ticker"), F.col(ingested_at).alias("ingested_at")
    )
    fields = payloads.schema["markets"].dataType.elementType.fields

    def one(field: T.StructField):
        value = F.col("m")[field.name]
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        return (F.to_json(value) if nested else value).alias(field.name)

    return markets.select(*[one(f) for f in fields], "series_ticker", "ingested_at", F.lit(status).alias("status_pulled"))
