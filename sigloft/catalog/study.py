"""As-of joins and the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions.numeric import fixed
from sigloft.operators.asof import asof_join, asof_offsets
from sigloft.plans import study as plan
from sigloft.session import stored
from sigloft.sources.landed import fixed_rows

_NINETY_DAYS = 90 * 86_400


@query("asof_backward_24h", with_ctes(f"""
SELECT f.l_orderkey, f.ticker, f.pos, b.brief_id, b.confidence, b.sec AS matched_at
FROM first_fill f LEFT JOIN briefs b ON f.ticker = b.ticker AND b.sec <= f.pos AND b.sec >= f.pos - {_NINETY_DAYS}
QUALIFY row_number() OVER (PARTITION BY f.l_orderkey ORDER BY b.sec DESC, b.brief_id DESC) = 1""", v.BRIEFS, v.FILLS,
    "first_fill AS (SELECT l_orderkey, ticker, min(pos) AS pos FROM fills GROUP BY l_orderkey, ticker)"))
def asof_backward(spark, sf):
    """First fill of each order with the last brief of its market at most 90 days before (24 hours in live use)."""
    first = v.fills(spark, sf).groupBy("l_orderkey", "ticker").agg(F.min("pos").alias("pos"))
    marks = v.briefs(spark, sf).select("ticker", "sec", F.col("brief_id").alias("_id"), "brief_id", "confidence")
    return asof_join(first, marks, ["ticker"], "pos", "sec", "_id", ["brief_id", "confidence"], _NINETY_DAYS).select(
        "l_orderkey", "ticker", "pos", "brief_id", "confidence", "matched_at"
    )


@query("asof_nearest_1h", with_ctes("""
SELECT b.brief_id, b.ticker, s.snap_id, s.bid, coalesce(abs(s.bid - b.odds) > 0.10::DOUBLE, false) AS is_stale
FROM user_briefs b LEFT JOIN ticks s ON b.ticker = s.ticker AND abs(s.pos - b.pos) <= 3600000000
QUALIFY row_number() OVER (PARTITION BY b.brief_id ORDER BY abs(s.pos - b.pos), s.pos) = 1""", v.SNAP, v.USER_BRIEFS))
def asof_nearest(spark, sf):
    """Each brief with the quote nearest to it within an hour, and whether the stated price was off."""
    marks = v.ticks(spark, sf).select("ticker", "pos", F.col("snap_id").alias("_id"), "snap_id", "bid")
    near = asof_join(v.user_briefs(spark, sf).select("brief_id", "ticker", "pos", "odds"), marks, ["ticker"], "pos", "pos", "_id",
                     ["snap_id", "bid"], 3_600_000_000, "nearest")
    stale = F.coalesce(F.abs(F.col("bid") - F.col("odds")) > 0.10, F.lit(False))
    return near.select("brief_id", "ticker", "snap_id", "bid", stale.alias("is_stale"))


def _asof_sql(left: str, right: str) -> str:
    return " ".join(
        f"ASOF LEFT JOIN {right} {n} ON e.series = {n}.series AND e.sec + {o} >= {n}.sec" for n, o in plan.OFFSETS.items()
    )


_PRICES = "prices AS (SELECT series, sec, arg_max(bid, snap_id) AS bid FROM ticks GROUP BY series, sec)"


@query("asof_offsets", with_ctes(
    "SELECT e.brief_id, e.series, e.sec, " + ", ".join(f"{n}.bid AS {n}" for n in plan.OFFSETS) + " FROM user_briefs e " + _asof_sql("e", "prices"),
    v.SNAP, v.USER_BRIEFS, _PRICES))
def offsets(spark, sf):
    """Series price at, before and after each brief."""
    events = v.user_briefs(spark, sf).select("brief_id", "series", "sec")
    prices = v.ticks(spark, sf).select("series", "sec", F.col("snap_id").alias("row_id"), "bid")
    return asof_offsets(events, prices, ["series"], "brief_id", "sec", "sec", "row_id", "bid", plan.OFFSETS).select(
        "brief_id", "series", "sec", *plan.OFFSETS
    )


_NAMES = ("Federal Reserve Board", "CENTRAL_BANK policy", "Taiwan Strait", "Brazilian Central Bank", "Council of the strait")
_STUDY_BRIDGE = (
    ("S3", "federal reserve", "(Federal Reserve|FOMC)"), ("S5", "Central_Bank", "^central"), ("S7", "Taiwan", None),
    ("S9", "Central Bank", "(US|American) Central"), ("S11", "Strait", ""), ("S3", "Reserve Board", "board$"),
)
SPIKES = f"""
spikes AS (
  SELECT event_id AS spike_id, ({v.sql_list(_NAMES)})[(user_id % {len(_NAMES)}) + 1] AS entity_name, value / 10 AS vol_spike,
         epoch_us(ts) // 1000000 AS sec
  FROM events),
study_bridge(series, bridge_name, required_regex) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _STUDY_BRIDGE)}),
mapped AS (
  SELECT s.*, b.series, b.bridge_name FROM spikes s JOIN study_bridge b ON contains(lower(s.entity_name), lower(b.bridge_name))
  WHERE vol_spike >= 10 AND (required_regex IS NULL OR required_regex = '' OR regexp_matches(entity_name, '(?i)' || required_regex))),
study_events AS (
  SELECT spike_id || '-' || series AS event_id, series, sec, vol_spike, spike_id FROM mapped
  QUALIFY row_number() OVER (PARTITION BY series, sec ORDER BY vol_spike DESC, spike_id) = 1)"""
STUDY = """
study AS (
  SELECT e.event_id, e.spike_id, e.series, e.sec, price_t0.bid AS p0, price_before.bid AS pb, price_4h.bid AS p4, price_12h.bid AS p12
  FROM study_events e """ + _asof_sql("e", "prices") + """ WHERE price_t0.bid IS NOT NULL),
moves AS (
  SELECT event_id, spike_id, series, sec, p0 AS price_t0, coalesce(abs(p0 - pb), 0) AS delta_15m, coalesce(abs(p0 - pb), 0) < 0.02::DOUBLE AS is_delayed,
         p4 - p0 AS alpha_4h, p12 - p0 AS alpha_12h, abs(p4 - p0) < 0.005::DOUBLE AS is_ghost,
         (['BUY', 'SELL', 'WAIT'])[(spike_id % 3) + 1] AS verdict FROM study)"""


def mapped_spikes(spark, sf):
    spikes = v.table(spark, sf, "events").select(
        F.col("event_id").alias("spike_id"), v.pick(F.col("user_id") % len(_NAMES), _NAMES).alias("entity_name"),
        (F.col("value") / 10).alias("vol_spike"), F.unix_seconds("ts").alias("sec"),
    )
    bridge = fixed_rows(spark, _STUDY_BRIDGE, ("series", "bridge_name", "required_regex"))
    return plan.mapped_spikes(spikes, bridge, 10.0)


def study(spark, sf):
    events = stored(plan.one_event_per_series_time(mapped_spikes(spark, sf)).select(
        F.concat_ws("-", F.col("spike_id").cast("string"), "series").alias("event_id"), "spike_id", "series", "sec"
    ), "study-events")
    prices = v.ticks(spark, sf).select("series", "sec", F.col("snap_id").alias("row_id"), "bid")
    return plan.event_study(events, prices)


@query("mapped_spikes", with_ctes("SELECT spike_id, entity_name, series, bridge_name, sec FROM mapped", SPIKES))
def spikes_on_series(spark, sf):
    return mapped_spikes(spark, sf).select("spike_id", "entity_name", "series", "bridge_name", "sec")


@query("event_study", with_ctes(
    "SELECT event_id, series, sec, price_t0, delta_15m, is_delayed, alpha_4h, alpha_12h, is_ghost FROM moves",
    v.SNAP, v.USER_BRIEFS, _PRICES, SPIKES, STUDY))
def event_study(spark, sf):
    return study(spark, sf).select("event_id", "series", "sec", "price_t0", "delta_15m", "is_delayed", "alpha_4h", "alpha_12h", "is_ghost")


@query("event_study_stats", with_ctes(f"""
SELECT subset, count(*) AS events, count(alpha_4h) AS events_4h, {fx('avg(alpha_4h)', 6)} AS mean_4h, {fx('median(alpha_4h)', 6)} AS median_4h,
       max(alpha_4h) AS max_4h, min(alpha_4h) AS min_4h, {fx('avg((alpha_4h > 0)::INT)', 6)} AS share_up_4h, {fx('avg((alpha_4h < 0)::INT)', 6)} AS share_down_4h,
       {fx('avg(is_ghost::INT)', 6)} AS ghost_rate, {fx('avg(alpha_12h)', 6)} AS mean_12h, {fx('avg((alpha_12h > 0)::INT)', 6)} AS share_up_12h
FROM (SELECT 'all' AS subset, * FROM moves UNION ALL SELECT 'delayed', * FROM moves WHERE is_delayed UNION ALL SELECT 'verdict:' || verdict, * FROM moves)
GROUP BY subset""", v.SNAP, v.USER_BRIEFS, _PRICES, SPIKES, STUDY))
def event_study_stats(spark, sf):
    """Counts, mean, median, extremes and shares over all events, the delayed ones and each verdict."""
    rows = study(spark, sf).withColumn("verdict", v.pick(F.col("spike_id") % 3, ("BUY", "SELL", "WAIT")))
    stats = plan.study_stats(rows, "verdict")
    rounded = ("mean_4h", "median_4h", "share_up_4h", "share_down_4h", "ghost_rate", "mean_12h", "share_up_12h")
    return stats.withColumns({c: fixed(c, 6) for c in rounded})
