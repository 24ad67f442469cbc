"""Candidate selection, change-based re-eligibility and the daily budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.prices import price_before, series_of
from sigloft.operators.keyed import latest_per_key, top_per_key
from sigloft.operators.ordered import running


def open_scored(scores: DataFrame, live: DataFrame, anchor: Column, lookback_hours: int = 48,
                price: str = "yes_bid", days: tuple[int, int] = fv.CLOSE_WINDOW_DAYS) -> DataFrame:
    """Latest flagged score per ticker inside look-back, price band and days-to-close window.

    ``scores``: ticker, title, yes_bid, delta_15m, mispricing_score, max_spike_multiplier, sentiment_signal,
    flagged_candidate, scored_at. ``live``: ticker, close_time, and optionally yes_bid_live, yes_ask_live.
    """
    recent = scores.where(F.col("flagged_candidate") & (F.col("scored_at") >= anchor - F.expr(f"INTERVAL {lookback_hours} HOURS")))
    days_left = F.datediff(F.to_date("close_time"), F.to_date(anchor))
    joined = recent.join(live, "ticker").where(
        F.col(price).between(*fv.PRICE_BAND) & F.col("close_time").isNotNull() & days_left.between(*days)
    )
    return latest_per_key(joined, ["ticker"], "scored_at").withColumn("series", series_of(F.col("ticker")))


def without_blocked(rows: DataFrame, series: Sequence[str] = fv.BLOCKED_SERIES,
                    phrases: Sequence[str] = fv.BLOCKED_TITLE_PHRASES) -> DataFrame:
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    keep = ~F.col("series").isin(*series)
    for phrase in phrases:
        keep &= ~title.contains(phrase)
    return rows.where(keep)


def last_inference(history: DataFrame) -> DataFrame:
    """Per ticker the newest analysis time, and the newest price and spike that were recorded."""
    moment = F.col("analyzed_at")
    return history.groupBy("ticker").agg(
        F.max(moment).alias("analyzed_at"),
        F.expr("max_by(last_price, analyzed_at) FILTER (WHERE last_price IS NOT NULL)").alias("last_price"),
        F.expr("max_by(last_spike, analyzed_at) FILTER (WHERE last_spike IS NOT NULL)").alias("last_spike"),
    )


def eligible_again(rows: DataFrame, history: DataFrame, anchor: Column) -> DataFrame:
    """Rows never analysed, or analysed long enough ago and since then moved, re-spiked or too old."""
    last = last_inference(history).withColumnRenamed("ticker", "_seen")
    at, price = F.col("analyzed_at"), F.col("last_price")
    moved = price.isNull() | (F.abs(F.col("yes_bid") - price) >= fv.PRICE_MOVE)
    spiked = F.col("max_spike_multiplier") >= F.greatest(
        F.coalesce(F.col("last_spike"), F.lit(0.0)) * fv.SPIKE_FACTOR, F.lit(fv.SPIKE_FLOOR)
    )
    stale = at < anchor - F.expr(f"INTERVAL {fv.SUPPRESS_HOURS} HOURS")
    rested = at < anchor - F.expr(f"INTERVAL {fv.RECHECK_MINUTES} MINUTES")
    keep = F.col("_seen").isNull() | at.isNull() | (rested & (moved | F.coalesce(spiked, F.lit(False)) | stale))
    joined = rows.join(last, rows["ticker"] == last["_seen"], "left").where(keep)
    return joined.drop("_seen", "analyzed_at", "last_price", "last_spike")


def ranked_candidates(rows: DataFrame, per_series: int = fv.SERIES_LIMIT, limit: int = fv.CANDIDATE_LIMIT) -> DataFrame:
    """At most ``per_series`` per series, then the global top list."""
    order = [F.col("mispricing_score").desc(), F.abs(F.coalesce(F.col("delta_15m"), F.lit(0.0))).desc(), F.col("ticker")]
    capped = top_per_key(rows, ["series"], order, per_series)
    return capped.orderBy(*order).limit(limit).withColumn(
        "previous_odds", price_before(F.col("yes_bid"), F.col("delta_15m"))
    )


def within_budget(calls: DataFrame, day: str, position: str, row_id: str, cost: str,
                  budget: float = fv.DAILY_BUDGET, slots: int | None = None) -> DataFrame:
    """Calls made while the spend of the day so far was below the budget; adds ``spent_before``."""
    spent = running(calls, [day], [F.col(position), F.col(row_id)], sums={"_spent": F.col(cost)},
                    slots=slots)
    return spent.withColumn("spent_before", F.col("_spent") - F.col(cost)).where(F.col("spent_before") < budget).drop("_spent")


def held_tickers(ledger: DataFrame, trades: DataFrame) -> DataFrame:
    """Tickers held by the ledger or by a trade that is not closed."""
    return ledger.select("ticker").union(trades.where(F.col("closed_at").isNull()).select("ticker")).distinct()


def clears_edge(side: Column, confidence: Column, odds: Column) -> Column:
    """Confidence floor and a margin over the market probability of the chosen side."""
    market = F.when(side == "yes", odds).otherwise(1.0 - odds)
    return (confidence >= fv.MIN_CONFIDENCE) & (confidence >= market + fv.MIN_EDGE)
