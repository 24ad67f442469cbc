"""Table maintenance: duplicates, merges, appends, updates on versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query
from sigloft.functions.numeric import fixed
from sigloft.operators import keyed
from sigloft.session import shared_folder
from sigloft.sources import tables
from sigloft.sources.landed import read_csvs
from sigloft.sources.schemas import TRADE


def _items(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.unix_seconds("l_shipdate").alias("ship_sec"),
    )


@query("dup_diagnostics", f"""
SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS distinct_keys,
       (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem)) AS distinct_key_times,
       {fx('100 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))) / count(*)', 4)} AS duplicate_pct FROM lineitem""")
def dup_diagnostics(spark, sf):
    report = keyed.duplicate_report(_items(spark, sf), ["l_orderkey", "l_linenumber"], "ship_sec")
    return report.withColumn("duplicate_pct", fixed("duplicate_pct", 4))


@query("dedup_latest", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_extendedprice, epoch_us(l_shipdate) // 1000000 AS ship_sec FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def dedup_latest(spark, sf):
    rows = keyed.latest_per_key(_items(spark, sf), ["l_orderkey", "l_linenumber"], "ship_sec", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "ship_sec")


@query("dedup_null_passthrough", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS link, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS seen_at FROM documents)
SELECT doc_id, link FROM d WHERE link IS NULL UNION ALL
SELECT doc_id, link FROM (SELECT * FROM d WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY link ORDER BY seen_at DESC NULLS LAST, doc_id DESC) = 1)""")
def dedup_null_passthrough(spark, sf):
    """Latest row per link, rows without a link kept, rows without a time last."""
    key = F.col("doc_id")
    rows = v.table(spark, sf, "documents").select("doc_id", F.when(key % 5 != 0, F.md5("text")).alias("link"), F.when(key % 3 != 0, key).alias("at"))
    return keyed.dedup_keeping_null_keys(rows, "link", "at", "doc_id").select("doc_id", "link")


def _orders(spark, sf):
    return v.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.unix_seconds("o_orderdate").alias("sec"))


_LATEST_ORDER = """
SELECT o_custkey, o_orderkey, o_orderstatus, epoch_us(o_orderdate) // 1000000 AS sec FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) = 1"""


@query("merge_upsert", _LATEST_ORDER)
def merge_upsert(spark, sf):
    """The latest settled and open order per customer, then a batch of pending ones merged over it."""
    path = shared_folder(spark, "merge")
    rows = _orders(spark, sf)
    tables.merge(spark, path, rows.where(F.col("o_orderstatus") != "P"), ["o_custkey"], ["sec", "o_orderkey"])
    tables.merge(spark, path, rows.where(F.col("o_orderstatus") == "P"), ["o_custkey"], ["sec", "o_orderkey"])
    return tables.read(spark, path)


@query("bucket_merge", _LATEST_ORDER)
def bucket_merge(spark, sf):
    """The same merge on a table laid out by a hash of the customer: only the buckets of the pending orders' customers are written again."""
    path = shared_folder(spark, "bucket-merge")
    rows = _orders(spark, sf)
    for pending in (False, True):
        part = rows.where((F.col("o_orderstatus") == "P") == pending)
        tables.merge_buckets(spark, path, part, ["o_custkey"], ["sec", "o_orderkey"])
    return tables.read_buckets(spark, path)


_NEWEST_ORDER = _LATEST_ORDER.replace("o_orderstatus = 'P' DESC, ", "")


@query("upsert_log", _NEWEST_ORDER)
def upsert_log(spark, sf):
    """Three batches appended to an upsert log, read as one row per customer."""
    path = shared_folder(spark, "upserts")
    rows = _orders(spark, sf)
    for status in ("P", "F", "O"):
        tables.log_upsert(rows.where(F.col("o_orderstatus") == status), path, ["o_custkey"], ["sec", "o_orderkey"])
    return tables.read_upserts(spark, path, ["o_custkey"], ["sec", "o_orderkey"])


@query("rebuild_current", _NEWEST_ORDER)
def rebuild_current(spark, sf):
    """Current table rebuilt from history and batch, whichever row is newer."""
    path = shared_folder(spark, "rebuild")
    rows = _orders(spark, sf)
    tables.rebuild(spark, path, rows.where(F.col("o_orderstatus") != "P"), rows.where(F.col("o_orderstatus") == "P"), ["o_custkey"], ["sec", "o_orderkey"])
    return tables.read(spark, path)


@query("idempotent_append", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1")
def idempotent_append(spark, sf):
    """Batches appended twice and with overlap: nothing is doubled, nothing late is lost."""
    path = shared_folder(spark, "appends")
    rows = _orders(spark, sf)
    first, second = rows.where(F.col("o_orderstatus") != "P"), rows.where(F.col("o_orderstatus") != "F")
    for batch in (first, second, first):
        tables.append_once(spark, path, batch, ["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("snapshot_and_history", """
SELECT 'history' AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders
UNION ALL SELECT 'snapshot', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus = 'P'""")
def snapshot_and_history(spark, sf):
    """Each batch overwrites the snapshot and is appended to the history."""
    base = shared_folder(spark, "ledger")
    rows = _orders(spark, sf)
    for status in ("F", "O", "P"):
        tables.snapshot_and_history(rows.where(F.col("o_orderstatus") == status), f"{base}/snapshot", f"{base}/history")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("o_orderkey").alias("checksum"))
    return count(tables.read(spark, f"{base}/snapshot"), "snapshot").union(count(tables.read_history(spark, f"{base}/history"), "history"))


@query("schema_evolution", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS note FROM orders""")
def schema_evolution(spark, sf):
    """A history whose later batch has one more column."""
    path = shared_folder(spark, "evolving")
    rows = v.table(spark, sf, "orders")
    tables.append(rows.where(F.col("o_orderstatus") == "F").select("o_orderkey"), path)
    tables.append(rows.where(F.col("o_orderstatus") != "F").select("o_orderkey", F.col("o_orderpriority").alias("note")), path)
    return tables.read_history(spark, path).select("o_orderkey", "note")


@query("keyed_update", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'closed' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 1700000000::BIGINT END AS closed_at FROM orders""")
def keyed_update(spark, sf):
    """Rows that meet a condition are closed in a new version; the old version stays readable until vacuumed."""
    path = shared_folder(spark, "update")
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority", F.lit(None).cast("bigint").alias("closed_at"))
    tables.overwrite(rows, path)
    tables.update_where(spark, path, (F.col("status") == "O") & (F.col("o_orderpriority") == "1-URGENT"),
                        {"status": F.lit("closed"), "closed_at": F.lit(1_700_000_000)})
    tables.vacuum(spark, path, keep=1)
    return tables.read(spark, path).select("o_orderkey", "status", "closed_at")


@query("bucket_update", """
SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' THEN 'closed' ELSE o_orderstatus END AS status,
       CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' THEN 1700000000::BIGINT END AS closed_at FROM orders JOIN customer ON c_custkey = o_custkey""")
def bucket_update(spark, sf):
    """The open orders of one market segment are closed by key, bucket by bucket."""
    path = shared_folder(spark, "bucket-update")
    rows = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("bigint").alias("closed_at"))
    tables.merge_buckets(spark, path, rows, ["o_orderkey"], ["o_custkey"])
    segment = v.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    tables.update_buckets(spark, path, rows.join(segment, "o_custkey", "left_semi"), ["o_orderkey"], F.col("status") == "O",
                          {"status": F.lit("closed"), "closed_at": F.lit(1_700_000_000)})
    return tables.read_buckets(spark, path).select("o_orderkey", "status", "closed_at")


@query("result_csv", f"SELECT o_orderstatus, count(*) AS n, {fx('sum(o_totalprice)', 0)} AS total FROM orders GROUP BY 1")
def result_csv(spark, sf):
    """Results written as CSV files with headers of their own and read back united by name."""
    base = shared_folder(spark, "results")
    rows = v.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), fixed(F.sum("o_totalprice"), 0).alias("total"))
    rows.select("o_orderstatus", "n").write.csv(f"{base}/counts", header=True)
    rows.select("total", "o_orderstatus").write.csv(f"{base}/totals", header=True)
    back = read_csvs(spark, base)
    return back.groupBy("o_orderstatus").agg(F.max("n").cast("bigint").alias("n"), F.max("total").cast("double").alias("total"))


@query("trade_ledger_csv", """
SELECT ticker, side, CAST(sum(n) AS BIGINT) AS total_count, sum(n * price) AS total_risk, count(*) AS trades FROM (
  SELECT 'C' || o_custkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS side, o_orderkey % 40 + 1 AS n, ((7919 * o_orderkey) % 1023 + 1) / 1024::DOUBLE AS price
  FROM orders UNION ALL SELECT 'C0', 'yes', 5, 0.5::DOUBLE) GROUP BY 1, 2""")
def trade_ledger_csv(spark, sf):
    """Trades kept as CSV: a ledger, one trade appended to it, read under the declared schema and summed per side."""
    path = shared_folder(spark, "trades")
    count, price = F.col("o_orderkey") % 40 + 1, v.hashed("o_orderkey", 7919, 1023, 1) / 1024
    trades = v.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("timestamp"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("side"), count.alias("count"), price.alias("price_dollars"),
        (count * price).alias("total_risk_usd"), F.lit(None).cast("timestamp").alias("closed_at"),
    )
    trades.write.csv(path, header=True)
    one = spark.range(1).select(F.timestamp_seconds(F.lit(1_700_000_000)).alias("timestamp"), F.lit("C0").alias("ticker"), F.lit("yes").alias("side"),
                                F.lit(5).cast("bigint").alias("count"), F.lit(0.5).alias("price_dollars"), F.lit(2.5).alias("total_risk_usd"),
                                F.lit(None).cast("timestamp").alias("closed_at"))
    one.write.mode("append").csv(path, header=True)
    back = spark.read.csv(path, header=True, schema=TRADE)
    return back.groupBy("ticker", "side").agg(F.sum("count").alias("total_count"), F.sum("total_risk_usd").alias("total_risk"), F.count("*").alias("trades"))


@query("compact_history", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders GROUP BY 1")
def compact_history(spark, sf):
    """A history of many small files rewritten as a few."""
    base = shared_folder(spark, "small-files")
    rows = _orders(spark, sf)
    for status in ("F", "O", "P"):
        tables.append(rows.where(F.col("o_orderstatus") == status).repartition(12), f"{base}/history")
    tables.compact(spark, f"{base}/history", f"{base}/compacted", 2)
    return spark.read.parquet(f"{base}/compacted").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("checksum"))


@query("compact_by_size", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum, true AS packed FROM orders GROUP BY 1")
def compact_by_size(spark, sf):
    """Small files packed into files of a target size, large ones left where they are; ``packed``: there are fewer files than before."""
    path = f"{shared_folder(spark, 'by-size')}/history"
    rows = _orders(spark, sf)
    for status in ("F", "O", "P"):
        tables.append(rows.where(F.col("o_orderstatus") == status).repartition(12), path)
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").count()
    before = files()
    tables.compact_by_size(spark, path, 4 << 20)
    packed = F.lit(files() < before)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("checksum"), F.first(packed).alias("packed"))


@query("partitioned_append", """
SELECT epoch_us(date_trunc('month', o_orderdate)) // 1000000 AS month_sec, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def partitioned_append(spark, sf):
    """A history partitioned by month; a date filter reads only its partitions."""
    path = shared_folder(spark, "by-month")
    month = F.unix_seconds(F.date_trunc("month", "o_orderdate"))
    tables.append(v.table(spark, sf, "orders").select("o_orderkey", month.alias("month_sec")).repartition("month_sec"), path, ["month_sec"])
    recent = tables.read_history(spark, path).where(F.col("month_sec") >= 883_612_800)
    return recent.groupBy(F.col("month_sec").cast("bigint").alias("month_sec")).agg(F.count("*").alias("n"))
