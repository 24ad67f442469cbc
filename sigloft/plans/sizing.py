"""Bet sizing under the Kelly rule with guardrails, and exposure caps per theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.functions.text import series_theme
from sigloft.operators.allocate import capped_allocation
from sigloft.session import stored


def with_kelly(df: DataFrame, confidence: Column, price: Column, bankroll: float, resolved: Column | int | None = None,
               days_left: Column | None = None, name: str = "kelly") -> DataFrame:
    """Adds a struct column with bet size and diagnostics for buying at ``price`` with the stated confidence.

    The confidence is shrunk half-way to a coin flip (W), the payout is R = (1-p)/p, the full fraction W - (1-W)/R. A
    quarter of it is bet, at most 5 % of the bankroll and half that when the market resolves within a week. Too few
    resolved markets or a raw confidence below 70 % limit the bet to a flat amount. ``resolved`` or ``days_left`` left
    out (or null) switch their guardrail off. The steps are columns of their own, so that no step is written out again
    inside the next one.
    """
    if bankroll <= 0:
        raise ValueError("the bankroll must be positive")
    no, zero = F.lit(False), F.lit(0.0)
    count = F.lit(resolved) if isinstance(resolved, int) else resolved
    col = lambda c: F.col(f"_{name}_{c}")
    add = lambda rows, **steps: rows.withColumns({f"_{name}_{k}": e for k, e in steps.items()})
    rows = add(
        df, c=confidence, p=price,
        valid=F.coalesce((price > 0) & (price < 1) & (confidence > 0), no),
        short=no if days_left is None else F.coalesce(days_left < fv.SHORT_DATED_DAYS, no),
        unproven=no if count is None else F.coalesce(count < fv.CALIBRATION_MARKETS, no),
        win=0.5 + fv.CONFIDENCE_SHRINK * (confidence - 0.5),
    )
    rows = add(rows, full=F.when(col("valid"), col("win") - (1.0 - col("win")) / ((1.0 - col("p")) / col("p"))),
               unsure=col("c") < fv.CONFIDENCE_FLOOR)
    cap = F.when(col("short"), fv.TRADE_CAP * fv.SHORT_DATED_HAIRCUT).otherwise(fv.TRADE_CAP)
    rows = add(rows, edge=F.coalesce(col("full") > 0, no), share=F.least(col("full") * fv.KELLY_SHARE, cap),
               flat=col("unproven") | col("unsure"))
    sized = fixed(col("share") * bankroll, 2)
    rows = add(rows, bet=F.when(col("flat"), F.least(sized, F.lit(fv.FLAT_BET))).otherwise(sized))
    bet_share = F.when(col("flat"), fixed(col("bet") / bankroll, 6)).otherwise(col("share"))
    rails = F.array_compact(F.array(
        F.when(col("short"), "short_dated"), F.when(col("unproven"), "uncalibrated"), F.when(col("unsure"), "low_confidence")
    ))
    on_edge = lambda value: F.when(col("edge"), value).otherwise(zero)
    on_valid = lambda value: F.when(col("valid"), value).otherwise(zero)
    result = F.struct(
        col("edge").alias("edge_detected"),
        on_edge(fixed(col("full"), 4)).alias("kelly_fraction"),
        on_edge(fixed(col("full") * fv.KELLY_SHARE, 4)).alias("quarter_kelly_fraction"),
        on_edge(fixed(bet_share, 4)).alias("capped_fraction"),
        on_edge(col("bet")).alias("suggested_bet_usd"),
        on_valid(fixed(col("c"), 4)).alias("raw_confidence"),
        on_valid(fixed(col("win"), 4)).alias("adjusted_win_prob"),
        (col("edge") & col("short")).alias("short_dated"),
        F.when(col("edge"), rails).otherwise(F.array().cast("array<string>")).alias("guardrails"),
    )
    helpers = [f"_{name}_{c}" for c in ("c", "p", "valid", "short", "unproven", "win", "full", "unsure", "edge", "share", "flat", "bet")]
    return rows.withColumn(name, result).drop(*helpers)


def kelly_reason(sizing: Column, price: Column, bankroll: float) -> Column:
    """One line that explains a sizing struct."""
    figures = F.format_string(
        "W=%.2f from raw %.2f, R=%.2f, full=%.4f, quarter=%.4f, bet %.2f of %.2f", sizing["adjusted_win_prob"],
        sizing["raw_confidence"], (1.0 - price) / price, sizing["kelly_fraction"], sizing["quarter_kelly_fraction"],
        sizing["suggested_bet_usd"], F.lit(float(bankroll)),
    )
    rails = F.when(F.size(sizing["guardrails"]) > 0, F.concat(F.lit("; guardrails: "), F.array_join(sizing["guardrails"], ", ")))
    return (
        F.when((price <= 0) | (price >= 1), F.lit("price must be between 0 and 1"))
        .when(sizing["raw_confidence"] <= 0, F.lit("no confidence signal"))
        .when(~sizing["edge_detected"], F.format_string("no edge after shrink (W=%.2f)", sizing["adjusted_win_prob"]))
        .otherwise(F.concat(figures, F.coalesce(rails, F.lit(""))))
    )


def cap_by_theme(bets: DataFrame, bankroll: float, bet: str = "suggested_bet_usd", row_id: str = "ticker",
                 cap: float = fv.THEME_CAP) -> DataFrame:
    """Adds ``theme``, ``capped_bet``, ``capped_share`` and ``cap_note``; larger bets of a theme are served first.

    The sized bets are read three times (levels, contested rows, result), so they are stored first.
    """
    themed = stored(bets.withColumn("theme", series_theme(F.col("ticker"), F.col("title"))), "bets")
    capped = capped_allocation(themed, "theme", bet, row_id, bankroll * cap, "capped_bet")
    note = F.when((F.col(bet) > 0) & (F.col("capped_bet") == 0), "zeroed").when(
        F.col("capped_bet") < fixed(F.col(bet), 2), "trimmed"
    )
    return capped.withColumns({"capped_share": fixed(F.col("capped_bet") / bankroll, 6), "cap_note": note})
