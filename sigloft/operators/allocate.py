"""Capped greedy allocation: largest request first until the budget of the group is spent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def capped_allocation(df: DataFrame, group: str, amount: str, row_id: str, budget: float,
                      result: str = "allocated") -> DataFrame:
    """Adds the granted part of ``amount`` (null or not positive requests get 0), ties served by ``row_id``.

    Equal to walking each group in falling order and handing out what is left. Instead of a running sum over a whole
    group, requests are counted per (group, amount). Money is whole cents, so a group has no more distinct amounts than
    its largest request has cents. Amounts above the one where the budget runs out are granted in full, those below get
    nothing; only inside that one amount does the order of rows matter, and just its first few rows can still be served.
    A salted cut finds those rows without sorting the whole group in one task.
    """
    budget_cents = round(budget * 100)
    cents = F.round(F.coalesce(F.col(amount), F.lit(0.0)) * 100).cast("bigint")
    asked = df.withColumn("_cents", F.greatest(cents, F.lit(0).cast("bigint")))
    above = Window.partitionBy(group).orderBy(F.col("_cents").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        asked.where(F.col("_cents") > 0).groupBy(group, "_cents").agg(F.count("*").alias("_n"))
        .withColumn("_left", F.lit(budget_cents) - F.coalesce(F.sum(F.col("_n") * F.col("_cents")).over(above), F.lit(0)))
        .withColumn("_whole", F.col("_n") * F.col("_cents") <= F.col("_left"))
    )
    placed = asked.join(levels, [group, "_cents"], "left")

    served = F.floor(F.col("_left") / F.col("_cents")) + 1
    contested = placed.where((F.col("_left") > 0) & ~F.col("_whole")).select(
        group, "_cents", row_id, served.alias("_served"), F.pmod(F.xxhash64(row_id), F.lit(SALTS)).alias("_salt")
    )
    by_salt = Window.partitionBy(group, "_cents", "_salt").orderBy(row_id)
    by_level = Window.partitionBy(group, "_cents").orderBy(row_id)
    turns = (
        contested.withColumn("_turn", F.row_number().over(by_salt)).where(F.col("_turn") <= F.col("_served"))
        .withColumn("_turn", F.row_number().over(by_level)).where(F.col("_turn") <= F.col("_served"))
        .select(row_id, "_turn")
    )
    final = placed.join(turns, row_id, "left")
    rest = F.col("_left") - (F.col("_turn") - 1) * F.col("_cents")
    granted = (
        F.when(F.col("_whole"), F.col("_cents"))
        .when(F.col("_turn").isNotNull(), F.greatest(F.lit(0), F.least(F.col("_cents"), rest)))
        .otherwise(F.lit(0))
    )
    return final.withColumn(result, granted / F.lit(100.0)).drop("_cents", "_n", "_left", "_whole", "_turn")
