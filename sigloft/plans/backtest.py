"""Back-tests of briefs and strategy statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.prices import contracts, entry_price
from sigloft.operators.asof import asof_join
from sigloft.operators.keyed import top_per_key
from sigloft.operators.ordered import drawdown_curve
from sigloft.plans.exits import first_touch
from sigloft.plans.sizing import cap_by_theme, with_kelly


def usable_briefs(briefs: DataFrame, since: Column | None = None) -> DataFrame:
    keep = (
        F.col("verdict").isNotNull() & ~F.col("verdict").contains("Error") & (F.col("verdict") != "")
        & F.col("recommended_side").isin("yes", "no")
    )
    return briefs.where(keep if since is None else keep & (F.col("sec") >= since))


def model_is(model: str) -> Column:
    """'production' means no replay model is named, 'all' keeps everything."""
    if model == "all":
        return F.lit(True)
    name = F.coalesce(F.col("replay_model"), F.lit(""))
    return name == ("" if model == "production" else model)


def best_brief(briefs: DataFrame, keys: list[str]) -> DataFrame:
    """Highest confidence, then newest."""
    return top_per_key(briefs, keys, [F.col("confidence").desc(), F.col("sec").desc(), F.col("brief_id").desc()])


def passes_current_gates(side: Column, odds: Column, confidence: Column) -> Column:
    market = F.when(side == "yes", odds).otherwise(1.0 - odds)
    return odds.between(*fv.PRICE_BAND) & (confidence >= market + fv.MIN_EDGE)


def signal_backtest(briefs: DataFrame, settled: DataFrame, live: DataFrame, bankroll: float, resolved: Column | int,
                    anchor_sec: Column, current_gates: bool = False) -> DataFrame:
    """One brief per ticker: outcome, Kelly size under theme caps and simulated P&L.

    ``briefs``: ticker, title, brief_id, recommended_side, odds, confidence, sec (already one per ticker).
    ``settled``: ticker, result. ``live``: ticker, live_bid, close_sec.
    """
    side, odds = F.col("recommended_side"), F.col("odds")
    rows = briefs.where(passes_current_gates(side, odds, F.col("confidence"))) if current_gates else briefs
    joined = rows.join(settled.select("ticker", "result"), "ticker", "left").join(
        live.select("ticker", "live_bid", "close_sec"), "ticker", "left"
    )
    known, won = F.col("result").isNotNull(), F.col("result") == side
    outcome = F.when(known, F.when(won, "WIN").otherwise("LOSS")).when(F.col("live_bid").isNotNull(), "OPEN").otherwise("UNKNOWN")
    entry = entry_price(side, odds)
    mark = entry_price(side, F.col("live_bid"))
    per = F.when(known, F.when(won, 1.0 - entry).otherwise(-entry)).otherwise(mark - entry)
    shown = F.when(known, F.when(F.col("result") == "yes", 1.0).otherwise(0.0)).otherwise(mark)
    days = F.when(~known, (F.col("close_sec") - anchor_sec) / 86_400.0)
    priced = joined.withColumns({
        "outcome": outcome, "entry_price": entry, "current_price": shown, "pnl_per_contract": per, "_days": days,
    })
    staged = with_kelly(priced, F.col("confidence"), F.col("entry_price"), bankroll, resolved, F.col("_days"), "_k").withColumns({
        "kelly_edge": F.col("_k.edge_detected"), "kelly_fraction": F.col("_k.kelly_fraction"),
        "suggested_bet_usd": F.col("_k.suggested_bet_usd"),
    }).drop("_k", "_days", "live_bid", "close_sec", "result")
    capped = cap_by_theme(staged, bankroll)
    stake = F.when(F.col("kelly_fraction") > 0, F.col("capped_bet")).otherwise(F.lit(fv.FLAT_BET))
    size = F.when(F.col("entry_price") > 0, F.floor(stake / F.col("entry_price"))).otherwise(0)
    return capped.withColumn("sim_pnl", fixed(size * F.col("pnl_per_contract"), 2))


def backtest_stats(rows: DataFrame) -> DataFrame:
    is_ = lambda o: F.col("outcome") == o
    done = is_("WIN") | is_("LOSS")
    wins, losses = F.count_if(is_("WIN")), F.count_if(is_("LOSS"))
    money = lambda c: fixed(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(done).alias("resolved"), wins.alias("wins"), losses.alias("losses"),
        F.count_if(is_("OPEN")).alias("open"), F.count_if(is_("UNKNOWN")).alias("unknown"),
        fixed(wins / F.nullif(wins + losses, F.lit(0)), 4).alias("hit_rate"),
        money(F.col("sim_pnl")).alias("sim_total_pnl"),
        money(F.when(is_("OPEN"), F.col("sim_pnl"))).alias("sim_open_pnl"),
        money(F.when(done, F.col("sim_pnl"))).alias("sim_resolved_pnl"),
    )


def sized_trades(briefs: DataFrame, bankroll: float) -> DataFrame:
    """Briefs with a Kelly edge as trades for :func:`first_touch` (proven calibration assumed)."""
    entry = entry_price(F.col("recommended_side"), F.col("odds"))
    sized = with_kelly(briefs.withColumn("entry_price", entry), F.col("confidence"), F.col("entry_price"), bankroll, 50, name="_k")
    return sized.where(F.col("_k.edge_detected")).select(
        F.col("brief_id").alias("trade_id"), "ticker", F.col("recommended_side").alias("side"), "entry_price", "odds",
        "confidence", F.floor(F.col("_k.suggested_bet_usd") / F.col("entry_price")).alias("qty"),
        F.col("pos").alias("entry_pos"),
    )


def without_stale_entries(trades: DataFrame, snapshots: DataFrame, tolerance: int, slots: int | None = None) -> DataFrame:
    """Drops trades whose stated YES price is off by more than 10 cents from the snapshot nearest to the entry.

    Only snapshots closer than ``tolerance`` count (strictly), otherwise the trade is kept.
    """
    near = asof_join(trades, snapshots, ["ticker"], "entry_pos", "pos", "snap_id", ["bid"], tolerance - 1, "nearest", slots)
    stale = F.col("matched_at").isNotNull() & (F.abs(F.col("bid") - F.col("odds")) > 0.10)
    return near.where(~stale).drop("matched_at", "bid")


def oracle_trades(snapshots: DataFrame, settled: DataFrame, bankroll: float) -> DataFrame:
    """Upper-bound trades: first snapshot inside the price band, side as the market settled."""
    banded = snapshots.where(F.col("bid").between(*fv.PRICE_BAND)).join(settled.select("ticker", "result"), "ticker")
    first = top_per_key(banded, ["ticker"], [F.col("pos"), F.col("snap_id")])
    side = F.col("result")
    entry = F.when(side == "yes", F.col("bid")).otherwise(1.0 - F.col("ask"))
    return first.withColumn("entry_price", entry).where((F.col("entry_price") > 0.05) & (F.col("entry_price") < 0.95)).select(
        F.col("snap_id").alias("trade_id"), "ticker", side.alias("side"), "entry_price", F.col("bid").alias("odds"),
        contracts(bankroll * fv.TRADE_CAP, F.col("entry_price")).alias("qty"), F.col("pos").alias("entry_pos"),
    )


def oracle_backtest(snapshots: DataFrame, settled: DataFrame, bankroll: float) -> DataFrame:
    return first_touch(oracle_trades(snapshots, settled, bankroll), snapshots, settled)


def strategy_stats(trades: DataFrame) -> DataFrame:
    """Exits by kind, win rate, P&L, average win and loss and reward:risk."""
    is_ = lambda o: F.col("outcome") == o
    win, loss = is_("PROFIT_EXIT") | is_("SETTLED_WIN"), is_("STOP_EXIT") | is_("SETTLED_LOSS")
    wins, losses, pnl = F.count_if(win), F.count_if(loss), F.col("pnl")
    avg_win = fixed(F.sum(F.when(win, pnl)) / F.nullif(wins, F.lit(0)), 2)
    avg_loss = fixed(F.sum(F.when(loss, pnl)) / F.nullif(losses, F.lit(0)), 2)
    stats = trades.agg(
        F.count("*").alias("total"),
        *[F.count_if(is_(o)).alias(n) for o, n in (
            ("PROFIT_EXIT", "profit_exits"), ("STOP_EXIT", "stop_exits"), ("SETTLED_WIN", "settled_wins"),
            ("SETTLED_LOSS", "settled_losses"), ("OPEN", "open"))],
        wins.alias("wins"), losses.alias("losses"),
        fixed(wins / F.nullif(wins + losses, F.lit(0)), 4).alias("win_rate"),
        fixed(F.coalesce(F.sum(pnl), F.lit(0.0)), 2).alias("total_pnl"),
        F.coalesce(avg_win, F.lit(0.0)).alias("avg_win"), F.coalesce(avg_loss, F.lit(0.0)).alias("avg_loss"),
    )
    both = (F.col("avg_win") != 0) & (F.col("avg_loss") != 0)
    return stats.withColumn("reward_risk", F.when(both, fixed(F.abs(F.col("avg_win") / F.nullif("avg_loss", F.lit(0.0))), 2)))


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Win rate, profit factor and average win and loss of trades with a ``pnl`` column."""
    pnl = F.col("pnl")
    gain, pain = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))
    wins, losses = F.count_if(pnl > 0), F.count_if(pnl < 0)
    zero = F.lit(0.0)
    return trades.agg(
        F.count("*").alias("total_trades"), wins.alias("winning_trades"), losses.alias("losing_trades"),
        F.coalesce(wins / F.nullif(F.count("*"), F.lit(0)), zero).alias("win_rate"),
        F.coalesce(gain / F.nullif(pain, zero), zero).alias("profit_factor"),
        F.coalesce(F.sum(pnl), zero).alias("total_pnl"),
        F.coalesce(gain / F.nullif(wins, F.lit(0)), zero).alias("avg_win"),
        F.coalesce(-pain / F.nullif(losses, F.lit(0)), zero).alias("avg_loss"),
    )


def sharpe(trades: DataFrame, day: str) -> DataFrame:
    """Mean over sample deviation of the daily P&L, scaled by the square root of 252; 0 without variation."""
    daily = trades.groupBy(day).agg(F.sum("pnl").alias("_pnl"))
    mean, dev = F.avg("_pnl"), F.stddev_samp("_pnl")
    return daily.agg(
        F.count("*").alias("days"),
        F.when(dev > 0, mean / F.nullif(dev, F.lit(0.0)) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe_ratio"),
    )


def max_drawdown(trades: DataFrame, position: str, row_id: str, slots: int | None = None) -> DataFrame:
    """Largest fall of the cumulative P&L below its running peak, absolute and relative to a positive peak."""
    peaked = drawdown_curve(trades.select(position, row_id, "pnl"), [F.col(position), F.col(row_id)], "pnl", slots)
    fall = F.col("equity") - F.col("peak")
    return peaked.agg(
        F.min(fall).alias("max_drawdown_usd"),
        F.min(F.when(F.col("peak") > 0, fall / F.col("peak"))).alias("max_drawdown"),
    )
