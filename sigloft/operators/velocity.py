"""Mention velocity: peak trailing counts, the tone at the last mention and the 90-day baseline, per key, in one pass.

Mentions of one key in one second share every trailing frame, so they are first summed per second (map-side combine
applies) and the frames run over seconds. Only the recent look-back keeps its seconds; all older mentions of a key fall
into one row that takes part in the baseline count but in no frame. A key then has at most 86,400 rows per look-back day,
however often it is mentioned, and the baseline needs neither a second scan nor a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloft.functions.prices import spike_multiplier

FRAMES = {"15m": 900, "24h": 86_400}


def mention_velocity(mentions: DataFrame, keys: Sequence[str], second: str, present: str, tone: str, recent_from: Column,
                     floor: int, frames: Mapping[str, int] = FRAMES) -> DataFrame:
    """Per key with a recent mention and per frame: ``vol_*`` the highest count in any trailing frame, ``tone_*`` the frame
    mean at the last mention; ``vol_90d`` the count of all given mentions and the spike multiplier.

    ``mentions`` hold the whole baseline span; those from ``recent_from`` on enter the frames.
    """
    recent = F.when(F.col(second) >= recent_from, F.col(second))
    per_second = mentions.groupBy(*keys, recent.alias("_sec")).agg(
        F.count(present).alias("_n"), F.sum(tone).alias("_tone"), F.count(tone).alias("_toned")
    )
    # rows without a second are peers of each other only, so they never enter the frame of a recent row
    frame = {n: Window.partitionBy(*keys).orderBy("_sec").rangeBetween(-s, 0) for n, s in frames.items()}
    framed = per_second.withColumns({
        **{f"_vol_{n}": F.sum("_n").over(w) for n, w in frame.items()},
        **{f"_tone_{n}": F.sum("_tone").over(w) / F.nullif(F.sum("_toned").over(w), F.lit(0)) for n, w in frame.items()},
    })
    is_recent = F.col("_sec").isNotNull()
    profile = framed.groupBy(*keys).agg(
        *[F.max(F.when(is_recent, F.col(f"_vol_{n}"))).alias(f"vol_{n}") for n in frames],
        *[F.max_by(f"_tone_{n}", "_sec").alias(f"tone_{n}") for n in frames],
        F.sum("_n").alias("vol_90d"), F.max("_sec").alias("_last"),
    ).where(F.col("_last").isNotNull()).drop("_last")
    return profile.withColumn("vol_spike_multiplier", spike_multiplier(F.col("vol_15m"), F.col("vol_90d"), floor))


def cross_source(means: DataFrame, topic: str, source: str, tone: str = "tone_15m") -> DataFrame:
    """Adds per topic the tone spread between its sources and the share of sources on the larger side.

    ``means`` has one row per (topic, source), so a topic's window holds no more rows than there are sources.
    """
    w = Window.partitionBy(topic)
    t = F.col(tone)
    below, above = F.sum((t < 0).cast("int")).over(w), F.sum((t > 0).cast("int")).over(w)
    return means.withColumns({
        "tone_divergence": F.max(t).over(w) - F.min(t).over(w),
        "tone_consensus": F.greatest(F.coalesce(below, F.lit(0)), F.coalesce(above, F.lit(0))) / F.count(source).over(w),
    })
