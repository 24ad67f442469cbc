"""Read-side views over briefs, markets and history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.prices import entry_price
from sigloft.functions.text import side_from_verdict, verdict_is_usable
from sigloft.operators.keyed import last_known_values, latest_per_key, top_per_key
from sigloft.plans.sizing import cap_by_theme, with_kelly


def resolved_markets(settled: DataFrame, briefs: DataFrame) -> DataFrame:
    """One row: settled markets that were briefed."""
    return settled.join(briefs.select("ticker"), "ticker", "left_semi").agg(F.count_distinct("ticker").alias("resolved_count"))


def market_view(briefs: DataFrame, live: DataFrame, since: Column, anchor_sec: Column, bankroll: float,
                resolved: Column | int) -> DataFrame:
    """The best usable recent brief per live market with side, Kelly size and theme cap; thin edges drop out."""
    usable = briefs.where((F.col("sec") >= since) & verdict_is_usable(F.col("verdict")))
    best = top_per_key(usable, ["ticker"], [F.col("confidence").desc(), F.col("sec").desc(), F.col("brief_id").desc()])
    joined = best.join(live, "ticker").withColumn("side", side_from_verdict(F.col("verdict"), F.col("odds_delta")))
    price = entry_price(F.col("side"), F.coalesce("live_bid", "odds"))
    edged = joined.withColumn("side_price", price).where(F.col("confidence") >= F.col("side_price") + fv.MIN_EDGE)
    days = (F.col("close_sec") - anchor_sec) / 86_400.0
    sized = with_kelly(edged, F.col("confidence"), F.col("side_price"), bankroll, resolved, days)
    return cap_by_theme(sized.withColumn("suggested_bet_usd", F.col("kelly.suggested_bet_usd")), bankroll)


def brief_history(briefs: DataFrame, since: Column) -> DataFrame:
    """One brief per market and day: the most confident."""
    kept = briefs.where((F.col("sec") >= since) & F.col("verdict").isNotNull() & ~F.col("verdict").contains("Error"))
    dated = kept.withColumn("brief_day", F.floor(F.col("sec") / 86_400).cast("bigint"))
    return top_per_key(dated, ["ticker", "brief_day"], [F.col("confidence").desc(), F.col("sec").desc(), F.col("brief_id").desc()])


def titles_with_fallback(wanted: DataFrame, latest: DataFrame, history: DataFrame, moment: str, row_id: str) -> DataFrame:
    """Title from the latest snapshot, else the newest one in the history, else the ticker itself."""
    older = latest_per_key(history.where(F.col("title").isNotNull()), ["ticker"], moment, row_id)
    return (
        wanted.select("ticker").distinct()
        .join(latest.select("ticker", F.col("title").alias("_now")), "ticker", "left")
        .join(older.select("ticker", F.col("title").alias("_then")), "ticker", "left")
        .select("ticker", F.coalesce("_now", "_then", "ticker").alias("title"),
                F.when(F.col("_now").isNotNull(), "latest").when(F.col("_then").isNotNull(), "history").otherwise("none").alias("found_in"))
    )


def text_filters(rows: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Case-insensitive substring per column, all must hold; empty filters are ignored."""
    for column, text in wanted.items():
        if text:
            rows = rows.where(F.lower(F.col(column).cast("string")).contains(text.lower()))
    return rows


def age_bucket(minutes: Column) -> Column:
    return F.when(minutes <= 180, "fresh").when(minutes <= 360, "mid").otherwise("aged")


def shown_side(side: Column, verdict: Column) -> Column:
    """The display group of a brief: 'no trade' verdicts are a group of their own."""
    return F.when(F.lower(F.coalesce(verdict, F.lit(""))).contains("no trade"), "notrade").otherwise(side)


def portfolio_totals(positions: DataFrame) -> DataFrame:
    """Invested, P&L, won and lost money, shares of the invested sum, win rate."""
    pnl, zero = F.coalesce(F.col("pnl"), F.lit(0.0)), F.lit(0.0)
    invested = F.sum("cost_basis")
    won, lost = F.sum(F.greatest(zero, pnl)), F.sum(F.greatest(zero, -pnl))
    winning, losing = F.count_if(pnl > 0), F.count_if(pnl < 0)
    base = F.nullif(invested, zero)
    return positions.agg(
        invested.alias("invested"), F.sum(pnl).alias("total_pnl"), won.alias("won"), lost.alias("lost"),
        winning.alias("winning"), losing.alias("losing"), F.count_if(F.col("status") == "OPEN").alias("open"),
        (F.sum(pnl) / base * 100).alias("pnl_pct"), (won / base * 100).alias("won_pct"), (lost / base * 100).alias("lost_pct"),
        (winning / F.nullif(winning + losing, F.lit(0))).alias("win_rate"),
    )


def verdict_replay(briefs: DataFrame, replays: DataFrame) -> DataFrame:
    """The last known brief per ticker beside its replayed verdict.

    ``briefs``: ticker, verdict, recommended_side, odds, sec, brief_id. ``replays``: ticker, new_verdict, new_side,
    new_confidence.
    """
    last = last_known_values(briefs, ["ticker"], ["sec", "brief_id"], ["verdict", "recommended_side", "odds"])
    return last.join(replays, "ticker").select(
        "ticker", "odds", F.col("verdict").alias("old_verdict"), F.col("recommended_side").alias("old_side"),
        "new_verdict", F.lower("new_side").alias("new_side"), "new_confidence",
        (F.coalesce("recommended_side", F.lit("")) != F.lower(F.coalesce("new_side", F.lit("")))).alias("changed"),
        F.substring("verdict", 1, 8).alias("old_group"), F.substring("new_verdict", 1, 8).alias("new_group"),
    )


def replay_counts(compared: DataFrame) -> DataFrame:
    """Counts of old and new verdict groups, sides and flips in one pass."""
    facets = F.array(*[
        F.struct(F.lit(n).alias("facet"), F.coalesce(c, F.lit("")).alias("value")) for n, c in (
            ("old_verdict", F.col("old_group")), ("new_verdict", F.col("new_group")), ("old_side", F.col("old_side")),
            ("new_side", F.col("new_side")),
            ("flip", F.when(F.col("changed"), F.concat_ws(">", F.col("old_side"), F.col("new_side"))).otherwise("same")),
        )
    ])
    return compared.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def metadata_keys(rows: DataFrame, tags: str, examples: int = 2) -> DataFrame:
    """Per metadata key: how many rows have it and its first few distinct values."""
    pairs = rows.select(F.explode(tags).alias("key", "value"))
    counted = pairs.groupBy("key", "value").agg(F.count("*").alias("_n"))
    total = counted.groupBy("key").agg(F.sum("_n").cast("bigint").alias("rows"), F.count("*").alias("distinct_values"))
    shown = top_per_key(counted, ["key"], [F.col("value")], examples).groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ",").alias("examples")
    )
    return total.join(shown, "key")


def top_rows(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)
