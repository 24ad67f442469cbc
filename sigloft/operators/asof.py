"""As-of joins: for every left row the right row of the same key that is nearest in time.

Both sides are laid on one time line per key and a running ``last(right, ignorenulls)`` is taken, so no left/right pair
is ever built and then thrown away. The line is cut into slots that follow the data (see :mod:`ordered`); the last right
row of a key in a slot is carried to the slots after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloft.operators.ordered import earlier_slots, in_slots, with_carry


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              right_id: str, take: Sequence[str], tolerance: int | None = None, direction: str = "backward",
              slots: int | None = None) -> DataFrame:
    """Left rows plus ``take`` and ``matched_at`` of the matched right row, null without a match.

    Times are whole numbers (microseconds or seconds) and ``tolerance`` is in the same unit, bounds included.
    ``backward`` takes the last right row at or before the left time, ``forward`` the first at or after it, ``nearest``
    the closer of the two, the earlier one on equal distance. On equal right times the higher ``right_id`` is the later.
    The ``take`` columns must be orderable.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(direction)
    match = F.struct(F.col(right_time).alias("matched_at"), F.col(right_id).alias("_id"), *[F.col(c) for c in take])
    marks = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_pos"), match.alias("_r"))
    asks = left.select(*keys, F.col(left_time).alias("_pos"), F.struct(*left.columns).alias("_l"))
    # At one instant right rows come first, or last where only the rows ahead count; equal asks are told apart by their content.
    is_ask = F.col("_l").isNotNull()
    order = [F.col("_pos"), is_ask.desc() if direction == "forward" else is_ask.asc(), F.col("_r._id"), F.xxhash64("_l")]
    slotted = in_slots(marks.unionByName(asks, allowMissingColumns=True), keys, order, slots)
    line = slotted

    found: dict[str, Column] = {}
    wanted = {"backward": ["back"], "forward": ["ahead"], "nearest": ["back", "ahead"]}[direction]
    for side in wanted:
        back = side == "back"
        local = (
            Window.partitionBy(*keys, "_slot")
            .orderBy(F.col("_pos").asc() if back else F.col("_pos").desc(), F.col("_l").isNotNull(),
                     F.col("_r._id").asc() if back else F.col("_r._id").desc())
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        edge = F.max("_r") if back else F.min("_r")
        carry = slotted.groupBy(*keys, "_slot").agg(edge.alias("_edge")).select(
            *keys, "_slot", F.last("_edge", ignorenulls=True).over(earlier_slots(keys, not back)).alias(f"_carry_{side}")
        )
        line = line.withColumn(f"_local_{side}", F.last("_r", ignorenulls=True).over(local))
        line = with_carry(line, keys, carry, [f"_carry_{side}"])
        found[side] = F.coalesce(f"_local_{side}", f"_carry_{side}")

    asked = line.where(F.col("_l").isNotNull())
    if direction == "nearest":
        asked = asked.withColumns({"_b": found["back"], "_a": found["ahead"]})
        closer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(
            F.col("_pos") - F.col("_b.matched_at") <= F.col("_a.matched_at") - F.col("_pos"), F.col("_b")
        ).otherwise(F.col("_a"))
        asked = asked.withColumn("_m", closer)
    else:
        asked = asked.withColumn("_m", found[wanted[0]])
    if tolerance is not None:
        asked = asked.withColumn("_m", F.when(F.abs(F.col("_pos") - F.col("_m.matched_at")) <= tolerance, F.col("_m")))
    return asked.select("_l.*", "_m.matched_at", *[F.col("_m")[c].alias(c) for c in take])


def asof_offsets(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_time: str, right_time: str,
                 right_id: str, value: str, offsets: dict[str, int], tolerance: int | None = None,
                 slots: int | None = None) -> DataFrame:
    """The right value at several time offsets from each left row, one output column per named offset.

    One backward as-of join over the exploded offsets, folded back to one row per ``left_id``.
    """
    shifts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).cast("bigint").alias("by")) for n, o in offsets.items()])
    asks = left.select(*keys, left_id, left_time, F.explode(shifts).alias("_s")).select(
        *keys, left_id, F.col("_s.name").alias("_name"), (F.col(left_time) + F.col("_s.by")).alias("_at")
    )
    hits = asof_join(asks, right, keys, "_at", right_time, right_id, [value], tolerance, "backward", slots)
    folded = hits.groupBy(left_id).agg(*[F.max(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in offsets])
    return left.join(folded, left_id, "left")


def interval_join(points: DataFrame, intervals: DataFrame, point_time: str, start: str, length: int) -> DataFrame:
    """Points with ``start <= point_time <= start + length``, by an equi-join on buckets of the interval length."""
    size = length + 1
    buckets = intervals.withColumn(
        "_bucket",
        F.explode(F.array_distinct(F.array(F.floor(F.col(start) / size), F.floor((F.col(start) + length) / size)))),
    )
    keyed = points.withColumn("_bucket", F.floor(F.col(point_time) / size))
    inside = (F.col(point_time) >= F.col(start)) & (F.col(point_time) <= F.col(start) + length)
    return keyed.join(buckets, "_bucket").where(inside).drop("_bucket")
