"""Streaming forms of the incremental steps, each run to the end of the given files; the check is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloft.catalog import book, views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions.numeric import fixed
from sigloft.session import pin_utc, shared_folder, stateful_session
from sigloft.sources.schemas import _struct
from sigloft.streaming import jobs
from sigloft.streaming.order_state import decide_or_expire, decide_orders

_EVENTS = _struct(v._TIMED["events"])
_DOCUMENTS = _struct("doc_id bigint, text string, lang string, source string, n_chars bigint")


def _stream(spark, sf, name: str, schema: T.StructType):
    """A given table, which is one file or a folder of part files. A streamed path must be a folder unless it is a pattern, so it is one of a single name."""
    return jobs.open_stream(pin_utc(spark), f"{sf}/{{{name}}}.parquet", schema, "*")


@query("stream_tumbling", """
SELECT epoch_us(ts) // 900000000 * 900 AS window_sec, event_type, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    """Quarter-hour windows per event type."""
    base = shared_folder(spark, "tumbling")
    stream = _stream(spark, sf, "events", _EVENTS).withColumn("event_id", F.col("event_id").cast("double"))
    totals = jobs.window_totals(stream, "ts", "event_type", "event_id", "15 minutes")
    return jobs.drain_windows(totals, "event_type", f"{base}/out", f"{base}/checkpoint")


@query("stream_sliding_peak", """
SELECT event_type, max(n) AS peak FROM (
  SELECT event_type, (epoch_us(ts) // 300000000 - g) AS w, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS g) GROUP BY 1, 2) GROUP BY 1""")
def stream_sliding_peak(spark, sf):
    """Highest trailing quarter-hour volume per event type, on a five-minute grid."""
    base = shared_folder(spark, "sliding")
    totals = jobs.window_totals(_stream(spark, sf, "events", _EVENTS), "ts", "event_type", "event_id", "15 minutes", "5 minutes")
    windows = jobs.drain_windows(totals, "event_type", f"{base}/out", f"{base}/checkpoint")
    return windows.groupBy("event_type").agg(F.max("n").alias("peak"))


@query("stream_dedup", "SELECT DISTINCT md5(text) AS content FROM documents")
def stream_dedup(spark, sf):
    """Each article content once, within the memory of the watermark."""
    base = shared_folder(spark, "dedup")
    stream = _stream(spark, sf, "documents", _DOCUMENTS).select(
        F.md5("text").alias("content"), F.timestamp_seconds(F.lit(v.EPOCH) + F.col("doc_id") * 97).alias("at")
    )
    once = jobs.first_seen(stream, "at", "content", "90 days")
    jobs.drain(once, f"{base}/checkpoint", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    return spark.read.parquet(f"{base}/out").select("content")


_PARTS = (("click", "view"), ("purchase", "error"), ("signup",))
_PART = "CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 2 END"


def _in_parts(spark, sf, base: str, take):
    """The events land part after part, in as many files as Spark makes of each; ``take`` drains what is new as one micro-batch."""
    rows = v.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    for types in _PARTS:
        rows.where(F.col("event_type").isin(*types)).write.mode("append").parquet(f"{base}/landed")
        result = take(jobs.open_stream(spark, f"{base}/landed", _EVENTS))
    return result


@query("stream_unseen", f"""
SELECT user_id, min(event_id) AS event_id FROM (SELECT *, {_PART} AS part FROM events QUALIFY part = min(part) OVER (PARTITION BY user_id)) GROUP BY 1""")
def stream_unseen(spark, sf):
    """Users never stored before, over three micro-batches, without a memory limit."""
    base = shared_folder(spark, "unseen")

    def take(stream):
        first = stream.select("user_id", "event_id", (-F.col("event_id")).alias("first"))
        return jobs.drain_unseen(first, "user_id", ["first"], f"{base}/out", f"{base}/checkpoint")

    return _in_parts(spark, sf, base, take).select("user_id", "event_id")


@query("stream_upsert", """
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_upsert(spark, sf):
    """Latest event per user kept over three micro-batches."""
    base = shared_folder(spark, "upsert")
    current = _in_parts(spark, sf, base, lambda stream: jobs.drain_upserts(
        stream, ["user_id"], ["ts", "event_id"], f"{base}/current", f"{base}/history", f"{base}/checkpoint"))
    return current.select("user_id", "event_id", "event_type", "value")


@query("stream_late_rows", f"""
WITH p AS (SELECT *, {_PART} AS part FROM events),
m0 AS (SELECT user_id, max(ts) AS mark FROM p WHERE part = 0 GROUP BY 1),
m1 AS (SELECT user_id, max(ts) AS mark FROM p WHERE part IN (0, 1) GROUP BY 1),
j AS (SELECT p.*, CASE part WHEN 1 THEN m0.mark WHEN 2 THEN m1.mark END AS mark FROM p LEFT JOIN m0 USING (user_id) LEFT JOIN m1 USING (user_id))
SELECT event_type, count(*) FILTER (WHERE mark IS NULL OR ts > mark) AS fresh, count(*) FILTER (WHERE ts <= mark) AS late FROM j GROUP BY 1""")
def stream_late_rows(spark, sf):
    """Rows behind the watermark of their user are taken, late ones kept aside."""
    base = shared_folder(spark, "late")
    fresh, late = _in_parts(spark, sf, base, lambda stream: jobs.drain_by_source(
        stream, "user_id", "ts", f"{base}/fresh", f"{base}/late", f"{base}/marks", f"{base}/checkpoint"))
    tagged = fresh.select("event_type", F.lit(1).alias("f")).union(late.select("event_type", F.lit(0)))
    return tagged.groupBy("event_type").agg(F.count_if(F.col("f") == 1).alias("fresh"), F.count_if(F.col("f") == 0).alias("late"))


_TWO_ORDERS = book.USER_ORDERS.replace("ORDER BY pos, brief_id) = 1)", "ORDER BY pos, brief_id) <= 2)")


def _two_orders(spark, sf):
    return book.resting_orders(stateful_session(spark), sf, 2).withColumn("order_id", F.col("order_id").cast("string"))


def _quotes(events):
    """All events but sign-ups as quotes of their user's market."""
    value = F.least(F.lit(1003.0), F.greatest(F.lit(10.0), F.floor(F.col("value") * 8).cast("double")))
    return events.where(F.col("event_type") != "signup").select(
        F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("ticker"),
        F.unix_micros("ts").alias("pos"), (value / 1024).alias("bid"), ((value + 20) / 1024).alias("ask"), F.col("ts").alias("moment"),
    )


def _decisions(decided, base: str):
    jobs.drain(decided, f"{base}/checkpoint", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    rows = decided.sparkSession.read.parquet(f"{base}/out")
    return rows.select("order_id", "ticker", "status", fixed("price", 4).alias("price"), "at")


@query("stream_order_state", with_ctes(
    "SELECT order_id::VARCHAR AS order_id, ticker, status, filled_price AS price, coalesce(filled_at, closed_at) AS at FROM resolved_orders WHERE status <> 'resting'",
    v.SNAP, v.USER_BRIEFS, _TWO_ORDERS))
def stream_order_state(spark, sf):
    """Two resting orders per market as state, decided by the stream of quotes."""
    base = shared_folder(spark, "order-state")
    decided = decide_orders(_two_orders(spark, sf), _quotes(_stream(spark, sf, "events", _EVENTS)), book._TIMEOUT)
    return _decisions(decided, base)


@query("stream_order_expiry", with_ctes(f"""
SELECT o.order_id::VARCHAR AS order_id, o.ticker, CASE WHEN f.order_id IS NULL THEN 'expired' ELSE 'filled' END AS status, f.price, coalesce(f.pos, o.created_at + {book._TIMEOUT}) AS at
FROM placed o LEFT JOIN fits f USING (order_id)
WHERE f.order_id IS NOT NULL OR (o.created_at + {book._TIMEOUT}) // 1000 < (SELECT max(pos) // 1000 FROM ticks)""",
    v.SNAP, v.USER_BRIEFS, _TWO_ORDERS.split("deciding AS")[0].rstrip().rstrip(","), f"""
fits AS (
  SELECT o.order_id, t.pos, {fx("CASE WHEN o.side = 'yes' THEN t.ask ELSE 1 - t.bid END")} AS price FROM placed o JOIN ticks t ON t.ticker = o.ticker
  WHERE t.pos > o.created_at AND t.pos <= o.created_at + {book._TIMEOUT} AND CASE WHEN o.side = 'yes' THEN t.ask ELSE 1 - t.bid END <= o.limit_price
  QUALIFY row_number() OVER (PARTITION BY o.order_id ORDER BY t.pos) = 1)"""))
def stream_order_expiry(spark, sf):
    """Two resting orders per market with a timer each; the quotes land in two parts, and the second run starts from the checkpoint."""
    base = shared_folder(spark, "order-expiry")
    orders = _two_orders(spark, sf)
    rows = v.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    middle = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(F.expr("timestamp_micros((unix_micros(low) + unix_micros(high)) div 2)")).scalar()
    for early in (True, False):
        part = F.col("ts") <= middle
        rows.where(part if early else ~part).write.mode("append").parquet(f"{base}/landed")
        found = _decisions(decide_or_expire(orders, _quotes(jobs.open_stream(spark, f"{base}/landed", _EVENTS)), book._TIMEOUT), base)
    return found


@query("stream_rerun", f"""
SELECT event_type, count(*) AS n, 0::BIGINT AS again FROM events GROUP BY 1""")
def stream_rerun(spark, sf):
    """Two landings, each run a second time with nothing new: every event is in the history once, and a run without new files takes no batch."""
    base = shared_folder(spark, "rerun")
    rows = v.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    idle = 0
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        rows.where(part).write.mode("append").parquet(f"{base}/landed")
        for again in (False, True):
            progress = jobs.drain(jobs.open_stream(spark, f"{base}/landed", _EVENTS), f"{base}/checkpoint",
                                  lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
            idle += sum(p.numInputRows for p in progress) if again else 0
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.first(F.lit(idle).cast("bigint")).alias("again"))


@query("stream_replay", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS checksum FROM events GROUP BY 1")
def stream_replay(spark, sf):
    """A run whose last batch was stored but not committed does that batch again on restart, over its own partition of the sink."""
    base = shared_folder(spark, "replay")
    rows = v.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")

    def run():
        jobs.drain(jobs.open_stream(spark, f"{base}/landed", _EVENTS), f"{base}/checkpoint", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))

    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/landed")
        run()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/checkpoint/commits/1")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.delete(place, False):
        raise RuntimeError("the second batch had no commit to take back")
    run()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("checksum"))
