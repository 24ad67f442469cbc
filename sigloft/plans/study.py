"""Event study: prices around mention spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.functions.numeric import blank_to_null
from sigloft.operators.asof import asof_offsets
from sigloft.operators.contains import contains_join
from sigloft.operators.keyed import top_per_key

#: seconds from the event
OFFSETS = {"price_t0": 0, "price_before": -900, "price_4h": 4 * 3600, "price_12h": 12 * 3600}


def mapped_spikes(spikes: DataFrame, bridge: DataFrame, threshold: float) -> DataFrame:
    """Spikes at or above the threshold whose entity name contains a bridge name and passes its pattern.

    ``spikes``: spike_id, entity_name, vol_spike, sec. ``bridge``: series, bridge_name, required_regex.
    """
    strong = spikes.where(F.col("vol_spike") >= threshold).withColumn("_e", F.lower("entity_name"))
    rows = bridge.withColumn("_b", F.lower("bridge_name"))
    names = contains_join(strong.select("_e").distinct(), ["_e"], "_e", rows, "_b")
    gate = blank_to_null(F.col("required_regex"))
    passes = gate.isNull() | F.expr("entity_name rlike concat('(?i)', required_regex)")
    return names.join(strong, "_e").join(rows, "_b").where(passes).drop("_e", "_b")


def one_event_per_series_time(mapped: DataFrame) -> DataFrame:
    """A series reacts once per instant: the strongest spike, then the lowest id."""
    return top_per_key(mapped, ["series", "sec"], [F.col("vol_spike").desc(), F.col("spike_id")])


def event_study(events: DataFrame, prices: DataFrame, slots: int | None = None) -> DataFrame:
    """Price at the event, 15 minutes before, 4 and 12 hours after (each the last known one), moves and flags.

    ``events``: event_id, series, sec. ``prices``: series, sec, row_id, bid. Events without a price at their time drop out.
    """
    around = asof_offsets(events, prices, ["series"], "event_id", "sec", "sec", "row_id", "bid", OFFSETS, slots=slots)
    moved = F.when(F.col("price_before").isNotNull(), F.abs(F.col("price_t0") - F.col("price_before"))).otherwise(0.0)
    return around.where(F.col("price_t0").isNotNull()).withColumns({
        "delta_15m": moved,
        "is_delayed": moved < 0.02,
        "alpha_4h": F.col("price_4h") - F.col("price_t0"),
        "alpha_12h": F.col("price_12h") - F.col("price_t0"),
    }).withColumn("is_ghost", F.abs("alpha_4h") < 0.005)


def study_stats(study: DataFrame, verdict: str | None = None) -> DataFrame:
    """Per subset (all events, delayed reactions, each verdict): counts, mean, median, extremes, shares.

    The median is taken over counted distinct moves; prices stand on a fixed tick, so their number is bounded however
    many events there are.
    """
    labels = [F.lit("all"), F.when(F.col("is_delayed"), "delayed")]
    if verdict:
        labels.append(F.concat(F.lit("verdict:"), F.col(verdict)))
    tagged = study.withColumn("subset", F.explode(F.array_compact(F.array(*labels))))
    counted = tagged.groupBy("subset", "alpha_4h").agg(
        F.count("*").alias("_n"), F.count("alpha_12h").alias("_n12"), F.sum("alpha_12h").alias("_s12"),
        F.count_if(F.col("alpha_12h") > 0).alias("_up12"),
    )
    a, n = F.col("alpha_4h"), F.col("_n")
    have = F.sum(F.when(a.isNotNull(), n))
    return counted.groupBy("subset").agg(
        F.sum(n).cast("bigint").alias("events"),
        F.coalesce(have, F.lit(0)).cast("bigint").alias("events_4h"),
        (F.sum(a * n) / have).alias("mean_4h"),
        F.percentile(a, F.lit(0.5), n).alias("median_4h"),
        F.max(a).alias("max_4h"), F.min(a).alias("min_4h"),
        (F.coalesce(F.sum(F.when(a > 0, n)), F.lit(0)) / have).alias("share_up_4h"),
        (F.coalesce(F.sum(F.when(a < 0, n)), F.lit(0)) / have).alias("share_down_4h"),
        (F.coalesce(F.sum(F.when(F.abs(a) < 0.005, n)), F.lit(0)) / have).alias("ghost_rate"),
        (F.sum("_s12") / F.nullif(F.sum("_n12"), F.lit(0))).alias("mean_12h"),
        (F.sum("_up12") / F.nullif(F.sum("_n12"), F.lit(0))).alias("share_up_12h"),
    )
