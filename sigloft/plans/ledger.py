"""Position ledger: fills to positions with average cost, first fill and the brief that led to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions.numeric import fixed, ratio
from sigloft.operators.asof import asof_join


def fill_price(side: Column, yes_dollars: Column, no_dollars: Column, yes_cents: Column, no_cents: Column) -> Column:
    """Dollar prices win over cent prices."""
    return F.when(side == "no", F.coalesce(no_dollars, no_cents / 100.0, F.lit(0.0))).otherwise(
        F.coalesce(yes_dollars, yes_cents / 100.0, F.lit(0.0))
    )


def cost_basis(fills: DataFrame) -> DataFrame:
    """Cost per ticker from buy fills: ticker, side, action, count, price."""
    return fills.where(F.col("action") == "buy").groupBy("ticker").agg(
        F.sum(F.col("price") * F.col("count")).alias("cost_basis"), F.sum("count").alias("bought")
    )


def positions(fills: DataFrame) -> DataFrame:
    """Signed net position per (ticker, side): YES positive, NO negative, empty ones dropped."""
    net = F.sum("count")
    held = fills.where(F.col("action") == "buy").groupBy("ticker", "side").agg(
        net.alias("_count"), F.sum(F.col("count") * F.col("price")).alias("exposure")
    )
    signed = F.when(F.col("side") == "yes", F.col("_count")).otherwise(-F.col("_count"))
    return held.select("ticker", "side", signed.alias("position"), "exposure").where(F.col("position") != 0)


def position_ledger(fills: DataFrame, briefs: DataFrame, tolerance: int, brief_columns: list[str],
                    slots: int | None = None) -> DataFrame:
    """One row per (ticker, side): quantity, weighted entry price, first fill, cost, and the last brief before it.

    ``fills``: ticker, side, action, count, price, pos. ``briefs``: ticker, pos, brief_id and ``brief_columns``. Times and
    ``tolerance`` in the same unit.
    """
    held = (
        fills.where(F.col("action") == "buy").groupBy("ticker", "side")
        .agg(F.sum("count").alias("qty"), F.sum(F.col("price") * F.col("count")).alias("_cost"),
             F.min("pos").alias("entry_pos"))
        .where(F.col("qty") != 0)
    )
    average = F.coalesce(ratio(F.col("_cost"), F.col("qty")), F.lit(0.0))
    priced = held.select("ticker", "side", "qty", "entry_pos", fixed(average, 4).alias("entry_price"),
                         fixed(average * F.col("qty"), 4).alias("cost_basis"))
    named = briefs.withColumn("_brief", F.col("brief_id"))
    matched = asof_join(priced, named, ["ticker"], "entry_pos", "pos", "_brief", ["brief_id", *brief_columns], tolerance,
                        "backward", slots)
    return matched.drop("matched_at")
