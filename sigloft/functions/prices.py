"""Quote algebra, P&L family, scores and fees. Prices are dollars between 0 and 1 for the YES side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import clamp, fixed


def series_of(ticker: Column) -> Column:
    return F.split_part(ticker, F.lit("-"), F.lit(1))


def side_bid(side: Column, bid: Column, ask: Column) -> Column:
    """What a holder of this side receives now; NO is one minus the opposite YES quote."""
    return F.when(side == "yes", bid).otherwise(1.0 - ask)


def side_ask(side: Column, bid: Column, ask: Column) -> Column:
    return F.when(side == "yes", ask).otherwise(1.0 - bid)


def side_mid(side: Column, bid: Column, ask: Column) -> Column:
    return (side_bid(side, bid, ask) + side_ask(side, bid, ask)) / 2.0


def limit_price(side: Column, bid: Column, ask: Column, aggression: float = fv.LIMIT_AGGRESSION) -> Column:
    """0 posts at the bid, 1 pays the ask."""
    low = side_bid(side, bid, ask)
    return fixed(low + aggression * (side_ask(side, bid, ask) - low), 4)


def entry_price(side: Column, yes_price: Column) -> Column:
    return F.when(side == "yes", yes_price).otherwise(1.0 - yes_price)


def contracts(risk: Column | float, price: Column, at_least: int = 1) -> Column:
    risk = F.lit(risk) if not isinstance(risk, Column) else risk
    return F.greatest(F.lit(at_least), F.floor(risk / price)).cast("bigint")


def fee_per_contract(price: Column) -> Column:
    return fixed(fv.FEE_RATE * price * (1.0 - price), 4)


def position_pnl(side: Column, entry: Column, exit_: Column, size: Column) -> Column:
    """P&L of a position quoted in YES prices."""
    return F.when(side == "YES", size * (exit_ - entry)).otherwise(size * (entry - exit_))


def roi(mark: Column, entry: Column) -> Column:
    return F.when(entry > 0, (mark - entry) / entry).otherwise(F.lit(0.0))


def capture(mark: Column, entry: Column) -> Column:
    """Share of the largest possible gain that is already on the table."""
    return F.when(entry < 1, (mark - entry) / (1.0 - entry)).otherwise(F.lit(0.0))


def change_since(now: Column, before: Column) -> Column:
    """Relative move; 0 when there is no earlier positive price."""
    return F.when(before > 0, (now - before) / before).otherwise(F.lit(0.0))


def price_before(now: Column, change: Column) -> Column:
    return now / (1.0 + F.coalesce(change, F.lit(0.0)))


def tone_to_unit(tone: Column) -> Column:
    return clamp(tone / 10.0, -1.0, 1.0)


def spike_multiplier(recent: Column, baseline: Column, floor: int) -> Column:
    """Recent quarter-hour count over the 90-day quarter-hour rate, capped; 0 below the baseline floor."""
    rate = baseline / F.lit(fv.QUARTER_HOURS_90D)
    return F.when(baseline >= floor, F.least(F.lit(fv.SPIKE_CAP), recent / rate)).otherwise(F.lit(0.0))


def raw_score(spike: Column, sentiment: Column, change_24h: Column) -> Column:
    """Null sentiment stays null and is scored 0 by :func:`anchored_score`."""
    return F.when(spike.isNull(), F.lit(0.0)).otherwise(spike * F.abs(sentiment) * (1.0 + F.abs(change_24h)))


def anchored_score(raw: Column, anchor: float = fv.SCORE_ANCHOR) -> Column:
    """The anchor maps to 80; ``greatest`` skips a null raw score, which therefore counts as 0."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 80.0 * F.log1p(raw) / F.lit(math.log1p(anchor))))


def legacy_score(spike: Column, change_15m: Column) -> Column:
    return F.when(spike.isNull(), F.lit(0.0)).otherwise(clamp(spike * 10.0 - change_15m * 100.0, 0.0, 100.0))


def call_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return (
        input_tokens / 1_000_000 * fv.INPUT_PRICE_PER_MTOK + output_tokens / 1_000_000 * fv.OUTPUT_PRICE_PER_MTOK
    )


def implied_move(side: Column, confidence: Column, odds: Column) -> Column:
    return F.when(side == "yes", confidence).otherwise(1.0 - confidence) - odds


def sentiment_blend(news: Column, tone: Column) -> Column:
    return 0.7 * news + 0.3 * tone


def confidence_blend(model: Column, retrieval: Column) -> Column:
    return 0.6 * model + 0.4 * retrieval


def decayed(similarity: Column, age_hours: Column) -> Column:
    """60 % similarity and 40 % recency with a half-life of one day."""
    recency = F.exp(-fv.DECAY_RATE * F.greatest(F.lit(0.0), age_hours) / 24.0)
    return similarity * (0.6 + 0.4 * recency)
