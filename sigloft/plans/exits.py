"""Exit decisions for open positions and first-touch exits over a price history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.prices import capture, fee_per_contract, roi, side_bid


def exit_decision(side: Column, entry: Column, qty: Column, bid: Column, ask: Column, hours_to_close: Column,
                  brief_side: Column, brief_verdict: Column) -> Column:
    """struct(action, trigger, urgency, exit price, P&L, capture, ROI): the first of six triggers that holds."""
    mark = side_bid(side, bid, ask)
    gain, share, back = mark - entry, capture(mark, entry), roi(mark, entry)
    flips = (
        brief_side.isNotNull() & (brief_side != "") & (brief_side != side)
        & ~F.lower(F.coalesce(brief_verdict, F.lit(""))).contains("no trade")
    )
    fading = (hours_to_close > 0) & (hours_to_close < fv.TIME_DECAY_HOURS) & (F.abs(gain) < fv.TIME_DECAY_BAND)
    triggers = [
        (back >= fv.TAKE_PROFIT_ROI, "SELL_PROFIT", "take_profit", 4),
        (back <= -fv.STOP_LOSS_ROI, "SELL_LOSS", "stop_loss", 5),
        (share >= fv.PROFIT_LOCK_CAPTURE, "SELL_PROFIT", "profit_lock", 4),
        (gain <= -fv.STOP_LOSS_CENTS, "SELL_LOSS", "absolute_stop", 5),
        (flips, "SELL_FLIP", "thesis_flip", 3),
        (fading, "SELL_TIMEOUT", "time_decay", 2),
    ]

    def outcome(action: str, trigger: str, urgency: int) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(trigger).alias("trigger"),
                        F.lit(urgency).cast("bigint").alias("urgency"))

    chain = reduce(lambda c, t: c.when(t[0], outcome(*t[1:])), triggers[1:], F.when(triggers[0][0], outcome(*triggers[0][1:])))
    chosen = chain.otherwise(outcome("HOLD", "none", 0))
    return F.struct(
        chosen["action"].alias("action"), chosen["trigger"].alias("trigger"), chosen["urgency"].alias("urgency"),
        fixed(mark, 4).alias("suggested_exit_price"), fixed(gain * qty, 4).alias("unrealized_pnl"),
        fixed(share, 4).alias("capture_pct"), fixed(back, 4).alias("roi_pct"),
    )


def exit_order() -> list[Column]:
    """Positions to act on first, then by urgency and P&L."""
    return [F.when(F.col("action") == "HOLD", 1).otherwise(0).asc(), F.col("urgency").desc(),
            F.col("unrealized_pnl").desc(), F.col("ticker"), F.col("side")]


#: Width of the time blocks that quotes are summed up by, in the unit of their positions (a day of microseconds).
BLOCK = 86_400 * 1_000_000


def quote_blocks(snapshots: DataFrame, width: int = BLOCK) -> DataFrame:
    """``ticker, block`` with the highest and lowest bid and ask of every market and stretch of time."""
    return snapshots.groupBy("ticker", F.floor(F.col("pos") / width).alias("block")).agg(
        F.max("bid").alias("high_bid"), F.min("bid").alias("low_bid"), F.max("ask").alias("high_ask"), F.min("ask").alias("low_ask")
    )


def first_hits(trades: DataFrame, snapshots: DataFrame, take_profit: float, stop_loss: float, from_entry: bool, width: int = BLOCK) -> DataFrame:
    """``trade_id, exit_pos, _kind, _peak``: the first snapshot of each trade's market that touches a threshold, and the best ROI up to it.

    A trade walks the summaries of its market's blocks: the extremes of a block tell exactly whether one of its snapshots crosses, and its
    best ROI. Snapshots are only joined for at most two blocks of a trade, by (ticker, block): the first that crosses and, ``from_entry``,
    the one of the entry, of which only the part behind the entry counts. So the rows that meet a trade don't grow with the history, and a
    market with most snapshots is spread over its blocks.
    """
    side, entry = F.col("side"), F.col("entry_price")
    held = trades.select("trade_id", "ticker", "side", "entry_price", "entry_pos").withColumn("entry_block", F.floor(F.col("entry_pos") / width))
    walked = held.join(quote_blocks(snapshots, width), "ticker")
    if from_entry:
        walked = walked.where(F.col("block") > F.col("entry_block"))
    walked = walked.select("trade_id", "block", roi(side_bid(side, F.col("high_bid"), F.col("low_ask")), entry).alias("best"),
                           roi(side_bid(side, F.col("low_bid"), F.col("high_ask")), entry).alias("worst"))
    crosses = (F.col("best") >= take_profit) | (F.col("worst") <= -stop_loss)
    crossed = walked.where(crosses).groupBy("trade_id").agg(F.min("block").alias("crossed"))

    wanted = F.array("entry_block", "crossed") if from_entry else F.array("crossed")
    opened = held.join(crossed, "trade_id", "left").withColumn("block", F.explode(wanted)).where("block IS NOT NULL")
    rows = opened.join(snapshots.select("ticker", "pos", "bid", "ask", F.floor(F.col("pos") / width).alias("block")), ["ticker", "block"])
    if from_entry:
        rows = rows.where(F.col("pos") >= F.col("entry_pos"))
    rows = rows.select("trade_id", "pos", roi(side_bid(side, F.col("bid"), F.col("ask")), entry).alias("best"))
    won, lost = F.col("best") >= take_profit, F.col("best") <= -stop_loss
    # plain minima keep the fold in a hash aggregate; at one instant the take-profit comes first
    touches = rows.where(won | lost).groupBy("trade_id").agg(
        F.min(F.when(won, F.col("pos"))).alias("_won"), F.min(F.when(lost, F.col("pos"))).alias("_lost")
    )
    profit = F.col("_won").isNotNull() & (F.col("_lost").isNull() | (F.col("_won") <= F.col("_lost")))
    hits = touches.select(
        "trade_id", F.least("_won", "_lost").alias("exit_pos"), F.when(profit, "PROFIT_EXIT").otherwise("STOP_EXIT").alias("_kind")
    )
    # whole blocks before the exit count by their extremes, the opened ones by their rows
    whole = walked.select("trade_id", "best", (F.col("block") + 1).alias("until"), F.lit(None).cast("long").alias("pos"))
    parts = rows.select("trade_id", "best", F.lit(None).cast("long").alias("until"), "pos")
    before = F.col("exit_pos").isNull() | (F.col("until") <= F.floor(F.col("exit_pos") / width)) | (F.col("pos") <= F.col("exit_pos"))
    peaks = whole.unionByName(parts).join(hits, "trade_id", "left").where(before).groupBy("trade_id").agg(F.max("best").alias("_peak"))
    return hits.join(peaks, "trade_id", "full")


def first_touch(trades: DataFrame, snapshots: DataFrame, settled: DataFrame | None = None,
                live: DataFrame | None = None, take_profit: float = fv.TAKE_PROFIT_ROI,
                stop_loss: float = fv.STOP_LOSS_ROI, from_entry: bool = True, fees: bool = False, width: int = BLOCK) -> DataFrame:
    """Closes each trade at the first snapshot that touches a threshold, else by settlement, else marks it open.

    ``trades``: trade_id, ticker, side, entry_price, qty, entry_pos; any number of trades per ticker. ``snapshots``: ticker, pos, bid, ask.
    ``settled``: ticker, result. ``live``: ticker, live_bid, live_ask. Take-profit is tested before stop-loss within one
    snapshot and the exit is at the threshold price. See :func:`first_hits` for how the snapshots are met.
    """
    hits = first_hits(trades, snapshots, take_profit, stop_loss, from_entry, width)
    joined = trades.join(hits, "trade_id", "left")
    none = F.lit(None)
    if settled is not None:
        joined = joined.join(settled.select("ticker", "result"), "ticker", "left")
    else:
        joined = joined.withColumn("result", none.cast("string"))
    if live is not None:
        joined = joined.join(live.select("ticker", "live_bid", "live_ask"), "ticker", "left")
    else:
        joined = joined.withColumns({"live_bid": none.cast("double"), "live_ask": none.cast("double")})

    entry, qty, kind = F.col("entry_price"), F.col("qty"), F.col("_kind")
    right = F.col("result") == F.col("side")
    mark = side_bid(F.col("side"), F.col("live_bid"), F.col("live_ask"))
    outcome = F.when(kind.isNotNull(), kind).when(
        F.col("result").isNotNull(), F.when(right, "SETTLED_WIN").otherwise("SETTLED_LOSS")
    ).otherwise("OPEN")
    price = (
        F.when(kind == "PROFIT_EXIT", fixed(entry * (1 + take_profit), 4))
        .when(kind == "STOP_EXIT", fixed(entry * (1 - stop_loss), 4))
        .when(F.col("result").isNotNull(), F.when(right, 1.0).otherwise(0.0))
        .otherwise(fixed(mark, 4))
    )
    worth = F.when(outcome == "OPEN", mark).otherwise(price)
    pnl = fixed((worth - entry) * qty, 2)
    if fees:
        charged = (fee_per_contract(entry) + fee_per_contract(price)) * qty
        pnl = F.when(qty > 0, fixed(pnl - charged, 2)).otherwise(pnl)
    return joined.withColumns({
        "outcome": outcome,
        "exit_price": price,
        "pnl": pnl,
        "peak_roi_pct": fixed(F.greatest(F.lit(0.0), F.coalesce(F.col("_peak"), F.lit(0.0))) * 100, 1),
    }).drop("_kind", "_peak", "result", "live_bid", "live_ask")
