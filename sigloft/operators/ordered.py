"""Ordered work per key (running totals, row lags) whatever the number of rows of a key.

Rows are dealt out by ranges of (key, order), so the cuts follow the data: a key that holds most rows, or a burst of rows at one
instant, is spread over as many ranges as its rows need, and small keys share one. Each range is a slot, written once with the rows;
work inside a key and slot is a window, and a summary per key and slot carries the state of earlier slots forward. A slot holds the end
of at most one key that began in an earlier one, so at most one summary per slot has a state to carry: the broadcast side has no more
rows than there are ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloft.session import stored

#: Rows of a key that one lag window takes, whatever the size of the key.
CHUNK = 100_000


def in_slots(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slots: int | None = None) -> DataFrame:
    """Adds ``_slot``, which never falls along (keys, order); ``slots``: how many ranges, by default as many as the session shuffles to.

    The rows are stored with their slot, since a second sampling of the ranges could cut elsewhere.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(slots, *by) if slots else df.repartitionByRange(*by)
    return stored(ranged.withColumn("_slot", F.spark_partition_id()), "slots")


def earlier_slots(keys: Sequence[str], backwards: bool = False):
    """The window over a key's summaries of all slots before the present one (after it if ``backwards``)."""
    slot = F.col("_slot").desc() if backwards else F.col("_slot").asc()
    return Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(slotted: DataFrame, keys: Sequence[str], carry: DataFrame, states: Sequence[str]) -> DataFrame:
    """Joins the states to the rows of their key and slot, null where a key begins."""
    some = F.lit(False)
    for s in states:
        some = some | F.col(s).isNotNull()
    kept = carry.where(some).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slot").alias("_k_slot"), *states)
    same = F.col("_slot") == F.col("_k_slot")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return slotted.join(F.broadcast(kept), same, "left").drop(*[f"_k_{k}" for k in keys], "_k_slot")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column] | None = None,
            maxes: Mapping[str, Column] | None = None, slots: int | None = None) -> DataFrame:
    """Inclusive running sums and maxima per key, added as columns; ``order`` must be total.

    Without keys the whole table is one ordered sequence.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    names = [*sums, *maxes]
    slotted = in_slots(df.withColumns({f"_in_{n}": e for n, e in {**sums, **maxes}.items()}), keys, order, slots)
    local = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = earlier_slots(keys)
    totals = [F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums] + [F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxes]
    carry = slotted.groupBy(*keys, "_slot").agg(*totals).select(
        *keys, "_slot",
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in maxes],
    )
    placed = slotted.withColumns({
        **{f"_l_{n}": F.sum(f"_in_{n}").over(local) for n in sums},
        **{f"_l_{n}": F.max(f"_in_{n}").over(local) for n in maxes},
    })
    done = with_carry(placed, keys, carry, [f"_c_{n}" for n in names]).withColumns({
        **{n: F.when(F.col(f"_c_{n}").isNull(), F.col(f"_l_{n}")).otherwise(F.col(f"_c_{n}") + F.coalesce(f"_l_{n}", F.lit(0)))
           for n in sums},
        **{n: F.greatest(f"_c_{n}", f"_l_{n}") for n in maxes},
    })
    return done.drop("_slot", *[f"{p}{n}" for n in names for p in ("_in_", "_l_", "_c_")])


def drawdown_curve(df: DataFrame, order: Sequence[Column], gain: str, slots: int | None = None) -> DataFrame:
    """Adds ``equity`` (the running sum of ``gain``) and ``peak`` (its running maximum) over the whole table, in one pass.

    A slot's summary is its sum and the highest of its own running sums; both combine along the slots.
    """
    slotted = in_slots(df, [], order, slots)
    local = Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = slotted.withColumn("_sum", F.sum(gain).over(local)).withColumn("_top", F.max("_sum").over(local))
    earlier = earlier_slots([])
    summary = inside.groupBy("_slot").agg(F.sum(gain).alias("_total"), F.max("_top").alias("_high"))
    based = summary.withColumn("_base", F.sum("_total").over(earlier))
    carry = based.withColumn("_before", F.max(F.coalesce("_base", F.lit(0)) + F.col("_high")).over(earlier)).select("_slot", "_base", "_before")
    base = F.coalesce("_base", F.lit(0))
    done = with_carry(inside, [], carry, ["_base", "_before"])
    return done.withColumn("equity", base + F.col("_sum")).withColumn("peak", F.greatest("_before", base + F.col("_top"))).select(*df.columns, "equity", "peak")


def lag_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, lags: Mapping[str, int],
             slots: int | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """``lag(value, n)`` per key for each named n, without one window partition per key.

    Rows get their rank in the key, ranks are cut into chunks, and the last ``max(n)`` rows of a chunk are handed to the next chunk as
    context only.
    """
    reach = max(lags.values())
    if reach >= chunk_rows:
        raise ValueError("a lag must be shorter than a chunk")
    ranked = running(df, keys, order, sums={"_rank": F.lit(1).cast("bigint")}, slots=slots)
    at = F.col("_rank") - 1
    chunk = F.floor(at / chunk_rows).cast("bigint")
    copies = F.when(at % chunk_rows >= chunk_rows - reach, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = ranked.withColumn("_own", chunk).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rank")
    lagged = spread.withColumns({n: F.lag(value, k).over(w) for n, k in lags.items()})
    return lagged.where(F.col("_own") == F.col("_chunk")).drop("_rank", "_own", "_chunk")
