"""Paper orders: placing, filling, expiring, settling, marking and closing by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed, ratio
from sigloft.functions.prices import contracts, limit_price, roi, side_ask, side_bid, side_mid


def sane_quote(bid: Column, ask: Column) -> Column:
    return (bid > 0) & (bid < ask) & (ask < 1)


def without_held(candidates: DataFrame, orders: DataFrame, arm: str) -> DataFrame:
    """Candidates whose ticker the arm does not already have resting or filled."""
    held = orders.where((F.col("arm") == arm) & F.col("status").isin("resting", "filled")).select("ticker")
    return candidates.join(held, "ticker", "left_anti")


def _place(chosen: DataFrame, arm: str, placed_at: Column, meta: Column) -> DataFrame:
    side, bid, ask = F.col("side"), F.col("yes_bid"), F.col("yes_ask")
    limit = limit_price(side, bid, ask)
    rows = chosen.where(sane_quote(bid, ask)).withColumn("_limit", limit).where((F.col("_limit") > 0) & (F.col("_limit") < 1))
    return rows.select(
        F.concat_ws("-", F.lit(arm), "ticker", placed_at.cast("string")).alias("order_id"),
        F.lit(arm).alias("arm"), "ticker", "side",
        contracts(fv.RISK_PER_ORDER, F.col("_limit")).alias("count"),
        F.col("_limit").alias("limit_price"), F.lit("resting").alias("status"), placed_at.alias("created_at"),
        fixed(side_bid(side, bid, ask), 4).alias("entry_bid"), fixed(side_ask(side, bid, ask), 4).alias("entry_ask"),
        fixed(side_mid(side, bid, ask), 4).alias("entry_mid"), meta.alias("meta"),
    )


def sentiment_orders(candidates: DataFrame, orders: DataFrame, placed_at: Column) -> DataFrame:
    """Side by the sign of the sentiment signal, weak signals skipped."""
    signal = F.coalesce(F.col("sentiment_signal"), F.lit(0.0))
    chosen = without_held(candidates, orders, "sentiment").where(F.abs(signal) >= fv.MIN_CONVICTION)
    meta = F.to_json(F.struct(fixed(signal, 4).alias("sent"), F.col("mispricing_score").alias("score")))
    return _place(chosen.withColumn("side", F.when(signal > 0, "yes").otherwise("no")), "sentiment", placed_at, meta)


def brief_orders(candidates: DataFrame, latest_briefs: DataFrame, orders: DataFrame, placed_at: Column) -> DataFrame:
    """Side as the latest brief recommends; no brief, no side or 'no trade' skips."""
    side = F.lower(F.trim("recommended_side"))
    verdict = F.lower(F.coalesce(F.col("verdict"), F.lit("")))
    chosen = (
        without_held(candidates, orders, "brief").join(latest_briefs.select("ticker", "recommended_side", "verdict"), "ticker")
        .where(side.isin("yes", "no") & ~verdict.contains("no trade")).withColumn("side", side)
    )
    return _place(chosen, "brief", placed_at, F.to_json(F.struct(F.col("verdict"))))


def resolve_fills(orders: DataFrame, ticks: DataFrame, timeout: int) -> DataFrame:
    """Resting orders against later quotes: filled at the first ask within the limit, expired at the first quote past
    the timeout, else still resting.

    ``ticks``: ticker, pos (unique together), bid, ask. Positions and ``timeout`` in the same unit. The first tick within
    the limit and the first past the timeout are plain map-side minima per order, so long tick histories are never sorted.
    """
    open_ = orders.where(F.col("status") == "resting").select("order_id", "ticker", "side", "limit_price", "created_at")
    pos, ask = F.col("pos"), side_ask(F.col("side"), F.col("bid"), F.col("ask"))
    met, late = ask <= F.col("limit_price"), pos - F.col("created_at") > timeout
    decided = (
        open_.join(ticks, "ticker").where((pos > F.col("created_at")) & (met | late)).groupBy("order_id")
        .agg(F.min(F.when(met, pos)).alias("_met"), F.min(F.when(late & ~met, pos)).alias("_late"),
             F.min_by(F.when(met, ask), F.when(met, pos)).alias("_ask"))
    )
    joined = orders.join(decided, "order_id", "left")
    filled = F.col("_met").isNotNull() & (F.col("_late").isNull() | (F.col("_met") <= F.col("_late")))
    expired = F.col("_late").isNotNull() & ~filled
    return joined.withColumns({
        "status": F.when(filled, "filled").when(expired, "expired").otherwise(F.col("status")),
        "filled_price": F.when(filled, fixed(F.col("_ask"), 4)).otherwise(F.col("filled_price")),
        "filled_at": F.when(filled, F.col("_met")).otherwise(F.col("filled_at")),
        "closed_at": F.when(expired, F.col("_late")).otherwise(F.col("closed_at")),
        "close_reason": F.when(expired, "fill_timeout").otherwise(F.col("close_reason")),
    }).drop("_met", "_late", "_ask")


def results_by_ticker(settled: DataFrame) -> DataFrame:
    """One yes/no result per ticker; other results are ignored."""
    result = F.lower("result")
    return settled.where(result.isin("yes", "no")).groupBy("ticker").agg(F.min(result).alias("result"))


def settle(orders: DataFrame, settled: DataFrame, at: Column) -> DataFrame:
    """Filled orders of settled markets close at 1 (our side won) or 0."""
    joined = orders.join(results_by_ticker(settled), "ticker", "left")
    done = (F.col("status") == "filled") & F.col("result").isNotNull()
    won = F.col("side") == F.col("result")
    return joined.withColumns({
        "close_price": F.when(done, F.when(won, 1.0).otherwise(0.0)).otherwise(F.col("close_price")),
        "closed_at": F.when(done, at).otherwise(F.col("closed_at")),
        "close_reason": F.when(done, F.when(won, "settled_win").otherwise("settled_loss")).otherwise(F.col("close_reason")),
        "status": F.when(done, "closed").otherwise(F.col("status")),
    }).drop("result")


def open_marks(orders: DataFrame, live: DataFrame) -> DataFrame:
    """Orders with display status, mark and P&L; open positions are marked at the side bid."""
    joined = orders.join(live.select("ticker", "live_bid", "live_ask"), "ticker", "left")
    mark = side_bid(F.col("side"), F.col("live_bid"), F.col("live_ask"))
    status, filled, reason = F.col("status"), F.col("filled_price"), F.coalesce(F.col("close_reason"), F.lit(""))
    entry = F.coalesce(filled, F.col("limit_price"))
    shown = (
        F.when(status == "filled", "OPEN")
        .when(status == "closed", F.when(reason.contains("win"), "SETTLED_WIN").when(reason.contains("loss"), "SETTLED_LOSS").otherwise("CLOSED"))
        .otherwise(F.upper(status))
    )
    now = F.when(status == "closed", F.coalesce(F.col("close_price"), F.lit(0.0))).when(status.isin("resting", "filled"), mark)
    pnl = F.when(status.isin("filled", "closed"), fixed((now - filled) * F.col("count"), 2))
    return joined.withColumns({
        "shown": shown, "current_price": fixed(now, 4), "pnl": pnl,
        "entry_price": fixed(entry, 4), "cost_basis": fixed(entry * F.col("count"), 2),
        "roi_pct": F.when(entry > 0, fixed((now - entry) / entry * 100, 1)),
    }).drop("live_bid", "live_ask")


def arm_summary(marked: DataFrame) -> DataFrame:
    """Counts by status and P&L sums per arm."""
    is_ = lambda s: F.col("shown") == s
    wins, losses = F.count_if(is_("SETTLED_WIN")), F.count_if(is_("SETTLED_LOSS"))
    stake = F.when(F.col("pnl").isNotNull(), F.col("filled_price") * F.col("count"))
    return marked.groupBy("arm").agg(
        F.count_if(F.col("shown").isin("OPEN", "SETTLED_WIN", "SETTLED_LOSS")).alias("trades"),
        F.count_if(is_("OPEN")).alias("open"), F.count_if(is_("RESTING")).alias("resting"),
        wins.alias("settled_win"), losses.alias("settled_loss"), F.count_if(is_("EXPIRED")).alias("expired"),
        fixed(F.coalesce(F.sum(F.when(is_("OPEN"), F.col("pnl"))), F.lit(0.0)), 2).alias("unrealized_pnl"),
        fixed(F.coalesce(F.sum(F.when(F.col("status") == "closed", F.col("pnl"))), F.lit(0.0)), 2).alias("realized_pnl"),
        fixed(F.coalesce(F.sum(stake), F.lit(0.0)), 2).alias("invested"),
        fixed(wins / F.nullif(wins + losses, F.lit(0)), 3).alias("win_rate"),
    )


def paper_positions(trades: DataFrame, settled: DataFrame, live: DataFrame) -> DataFrame:
    """Simple trades (ticker, side, count, price, closed_at) with result or live mark and a status ladder."""
    results = results_by_ticker(settled)
    joined = trades.join(results, "ticker", "left").join(live.select("ticker", "live_bid", "live_ask"), "ticker", "left")
    side, entry, qty = F.col("side"), F.col("price"), F.col("count")
    won, known = F.col("result") == side, F.col("result").isNotNull()
    now = F.when(known, F.when(won, 1.0).otherwise(0.0)).otherwise(side_bid(side, F.col("live_bid"), F.col("live_ask")))
    back = roi(now, entry)
    status = (
        F.when(F.col("closed_at").isNotNull(), "CLOSED")
        .when(known, F.when(won, "SETTLED_WIN").otherwise("SETTLED_LOSS"))
        .when(back >= fv.TAKE_PROFIT_ROI, "TP_READY").when(back <= -fv.STOP_LOSS_ROI, "SL_HIT").otherwise("OPEN")
    )
    rank = F.when(F.col("shown") == "SL_HIT", 0)
    for i, name in enumerate(("CLOSED", "TP_READY", "OPEN", "SETTLED_WIN", "SETTLED_LOSS"), start=1):
        rank = rank.when(F.col("shown") == name, i)
    return joined.withColumns({
        "shown": status, "current_price": fixed(now, 4), "unrealized_pnl": fixed((now - entry) * qty, 2),
        "cost_basis": fixed(qty * entry, 2), "roi_pct": F.when(now.isNotNull(), fixed(ratio(now - entry, entry) * 100, 1)),
    }).withColumn("status_rank", rank.otherwise(9).cast("bigint")).drop("result", "live_bid", "live_ask")


def paper_summary(positions: DataFrame) -> DataFrame:
    """Open P&L and counts by status; hand-closed trades do not count towards P&L."""
    return positions.agg(
        fixed(F.coalesce(F.sum(F.when(F.col("shown") != "CLOSED", F.col("unrealized_pnl"))), F.lit(0.0)), 2).alias("total_pnl"),
        *[F.count_if(F.col("shown") == s).alias(s.lower())
          for s in ("OPEN", "TP_READY", "SL_HIT", "SETTLED_WIN", "SETTLED_LOSS", "CLOSED")],
    )


def close_by_hand(orders: DataFrame, chosen: Column, live: DataFrame, at: Column) -> DataFrame:
    """Chosen resting orders are cancelled, chosen filled ones close at the live side bid (0 without a quote)."""
    joined = orders.join(live.select("ticker", "live_bid", "live_ask"), "ticker", "left")
    resting, filled = chosen & (F.col("status") == "resting"), chosen & (F.col("status") == "filled")
    mark = F.coalesce(side_bid(F.col("side"), F.col("live_bid"), F.col("live_ask")), F.lit(0.0))
    return joined.withColumns({
        "close_price": F.when(filled, fixed(mark, 4)).otherwise(F.col("close_price")),
        "close_reason": F.when(resting, "manual_cancel").when(filled, "manual_close").otherwise(F.col("close_reason")),
        "closed_at": F.when(resting | filled, at).otherwise(F.col("closed_at")),
        "status": F.when(resting, "expired").when(filled, "closed").otherwise(F.col("status")),
    }).drop("live_bid", "live_ask")
