"""Time-bucketed sentiment signals and price roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions.numeric import clamp
from sigloft.functions.prices import sentiment_blend
from sigloft.operators.asof import interval_join

QUARTER = 900


def bucket(second: Column, size: int = QUARTER) -> Column:
    """Start second of the bucket, equal to a tumbling window start in UTC."""
    return (F.floor(second / size) * size).cast("bigint")


def news_windows(articles: DataFrame, size: int = QUARTER) -> DataFrame:
    """Per window: mean, sample deviation, count and number of feeds."""
    return articles.groupBy(bucket(F.col("sec"), size).alias("window_sec")).agg(
        F.avg("sentiment_score").alias("sentiment_mean"), F.stddev_samp("sentiment_score").alias("sentiment_std"),
        F.count("*").alias("article_count"), F.count_distinct("feed_key").alias("source_count"),
        F.min("sentiment_score").alias("most_negative"), F.max("sentiment_score").alias("most_positive"),
    )


def tone_windows(events: DataFrame, size: int = QUARTER) -> DataFrame:
    return events.groupBy(bucket(F.col("sec"), size).alias("window_sec")).agg(
        F.avg("tone").alias("event_tone"), F.count("*").alias("event_count")
    )


def blended_signal(articles: DataFrame, events: DataFrame) -> DataFrame:
    """News windows with event tone blended in where there is one, and confidence by number of feeds."""
    joined = news_windows(articles).join(tone_windows(events), "window_sec", "left")
    blend = F.coalesce(sentiment_blend(F.col("sentiment_mean"), F.col("event_tone") / 10.0), F.col("sentiment_mean"))
    return joined.withColumn("blended_sentiment", blend).withColumn(
        "confidence", clamp(F.col("source_count") / 10.0, 0.0, 1.0)
    )


def blended_outer(articles: DataFrame, events: DataFrame) -> DataFrame:
    """All windows that either side has; a missing side counts as 0."""
    news = news_windows(articles).select("window_sec", "sentiment_mean", "article_count")
    joined = news.join(tone_windows(events), "window_sec", "full")
    zero = F.lit(0.0)
    return joined.select(
        "window_sec", F.coalesce("sentiment_mean", zero).alias("news_signal"),
        F.coalesce(F.col("event_tone") / 100.0, zero).alias("event_signal"),
        F.coalesce("article_count", F.lit(0)).alias("articles"), F.coalesce("event_count", F.lit(0)).alias("events"),
    ).withColumn("blended", sentiment_blend(F.col("news_signal"), F.col("event_signal")))


def signal_entries(signals: DataFrame, snapshots: DataFrame, reach: int = 300) -> DataFrame:
    """Snapshots within five minutes after the start of a signal window."""
    return interval_join(snapshots, signals, "sec", "window_sec", reach)


def price_rollup(snapshots: DataFrame, size: int = QUARTER) -> DataFrame:
    """Snapshots per window, ticker and quote."""
    return snapshots.groupBy(bucket(F.col("sec"), size).alias("window_sec"), "ticker", "bid", "ask", "volume").agg(
        F.count("*").alias("snapshots")
    )


def hourly_codes(events: DataFrame) -> DataFrame:
    """Per hour: count, mean impact and tone, sorted list of codes.

    Counted per (hour, code) first; the final list holds each code of the fixed code list at most once.
    """
    per_code = events.groupBy(bucket(F.col("sec"), 3600).alias("hour_sec"), "code").agg(
        F.count("*").alias("_n"), F.sum("impact").alias("_i"), F.sum("tone").alias("_t")
    )
    return per_code.groupBy("hour_sec").agg(
        F.sum("_n").cast("bigint").alias("event_count"), (F.sum("_i") / F.sum("_n")).alias("avg_impact"),
        (F.sum("_t") / F.sum("_n")).alias("avg_tone"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("event_codes"),
    )
