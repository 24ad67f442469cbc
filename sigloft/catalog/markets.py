"""Quote history: latest rows, moves, roll-ups, time-bucketed signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions.numeric import fixed
from sigloft.functions.prices import change_since
from sigloft.operators.asof import asof_offsets
from sigloft.operators.keyed import latest_per_key, top_per_key
from sigloft.operators.ordered import running
from sigloft.plans import sentiment
from sigloft.plans.score import LAGS, all_moves, latest_moves

_LATEST = "SELECT ticker, snap_id, sec, bid, ask, status FROM snap QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC, snap_id DESC) = 1"


def _latest(spark, sf):
    rows = v.snap(spark, sf).select("ticker", "snap_id", "pos", "sec", "bid", "ask", "status")
    return latest_per_key(rows, ["ticker"], "pos", "snap_id").drop("pos")


@query("latest_per_key", with_ctes(_LATEST, v.SNAP))
def latest(spark, sf):
    return _latest(spark, sf)


@query("latest_active", with_ctes(f"SELECT * FROM ({_LATEST}) WHERE status IN ('active', 'open')", v.SNAP))
def latest_active(spark, sf):
    return _latest(spark, sf).where(F.col("status").isin("active", "open"))


_MOVE = "CASE WHEN {p} > 0 THEN (bid - {p}) / {p} ELSE 0 END"


@query("odds_deltas", with_ctes(
    "SELECT snap_id, event_type, bid, " + ", ".join(f"{fx(_MOVE.format(p='p_' + n), 6)} AS delta_{n}" for n in LAGS)
    + " FROM (SELECT snap_id, event_type, bid, "
    + ", ".join(f"lag(bid, {k}) OVER (PARTITION BY event_type ORDER BY pos, snap_id) AS p_{n}" for n, k in LAGS.items())
    + " FROM snap)", v.SNAP))
def odds_deltas(spark, sf):
    """Every snapshot against 1, 4 and 96 rows earlier of its key (here the event type, five long histories)."""
    moves = all_moves(v.snap(spark, sf).select("event_type", "pos", "snap_id", "bid"), "event_type", "pos", "snap_id", "bid")
    return moves.select("snap_id", "event_type", "bid", *[fixed(f"delta_{n}", 6).alias(f"delta_{n}") for n in LAGS])


@query("odds_deltas_timed", with_ctes(
    "SELECT s.snap_id, s.ticker, s.bid, " + ", ".join(
        f"{fx(f'CASE WHEN {n}.bid > 0 THEN (s.bid - {n}.bid) / {n}.bid ELSE 0 END', 6)} AS delta_{n}" for n in ("t15m", "t1h", "t24h")
    ) + " FROM snap s " + " ".join(
        f"ASOF LEFT JOIN snap {n} ON s.ticker = {n}.ticker AND s.pos - {o} >= {n}.pos"
        for n, o in (("t15m", 900000000), ("t1h", 3600000000), ("t24h", 86400000000))
    ), v.SNAP))
def odds_deltas_timed(spark, sf):
    """The same moves against fixed times ago instead of row counts: no cadence is assumed."""
    rows = v.snap(spark, sf).select("ticker", "pos", "snap_id", "bid")
    back = {"t15m": -900_000_000, "t1h": -3_600_000_000, "t24h": -86_400_000_000}
    past = rows.select("ticker", "pos", F.col("snap_id").alias("_id"), F.col("bid").alias("past_bid"))
    found = asof_offsets(rows, past, ["ticker"], "snap_id", "pos", "pos", "_id", "past_bid", back)
    return found.select("snap_id", "ticker", "bid", *[fixed(change_since(F.col("bid"), F.col(n)), 6).alias(f"delta_{n}") for n in back])


@query("latest_moves", with_ctes(
    "SELECT ticker, yes_bid, status, " + ", ".join(f"{fx(_MOVE.format(p='p_' + n).replace('bid', 'yes_bid'), 6)} AS delta_{n}" for n in LAGS)
    + " FROM (SELECT ticker, yes_bid, status, row_number() OVER (PARTITION BY ticker ORDER BY sec DESC, snap_id DESC) AS r, "
    + ", ".join(f"lag(yes_bid, {k}) OVER (PARTITION BY ticker ORDER BY sec, snap_id) AS p_{n}" for n, k in LAGS.items())
    + " FROM msnap) WHERE r = 1", v.SNAP, v.MSNAP))
def moves_of_latest(spark, sf):
    rows = latest_moves(v.market_snap(spark, sf), "ticker", ["sec", "snap_id"], "yes_bid", ["status"])
    return rows.select("ticker", "yes_bid", "status", *[fixed(f"delta_{n}", 6).alias(f"delta_{n}") for n in LAGS])


_FORCED = ("S7-7", "S11-11")


@query("newest_vs_previous", with_ctes(f"""
SELECT a.ticker, a.sec, a.bid AS current_odds,
       CASE WHEN a.ticker IN {_FORCED} THEN a.bid ELSE b.bid END AS previous_odds,
       CASE WHEN a.ticker IN {_FORCED} THEN 0 ELSE abs(a.bid - b.bid) END AS odds_delta
FROM r a LEFT JOIN r b ON a.ticker = b.ticker AND b.n = 2
WHERE a.n = 1 AND (a.ticker IN {_FORCED} OR abs(a.bid - b.bid) >= 0.10)""", v.SNAP,
    "r AS (SELECT ticker, sec, bid, row_number() OVER (PARTITION BY ticker ORDER BY pos DESC, snap_id DESC) AS n FROM snap)"))
def newest_vs_previous(spark, sf):
    """Markets whose newest quote moved at least ten cents against the one before, and forced ones without a move."""
    rows = v.snap(spark, sf).select("ticker", "pos", "snap_id", "sec", "bid")
    two = top_per_key(rows, ["ticker"], [F.col("pos").desc(), F.col("snap_id").desc()], 2, rank="_n")
    at = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    pairs = two.groupBy("ticker").agg(at("sec", 1).alias("sec"), at("bid", 1).alias("current_odds"), at("bid", 2).alias("_before"))
    forced = F.col("ticker").isin(*_FORCED)
    return pairs.select(
        "ticker", "sec", "current_odds", F.when(forced, F.col("current_odds")).otherwise(F.col("_before")).alias("previous_odds"),
        F.when(forced, 0.0).otherwise(F.abs(F.col("current_odds") - F.col("_before"))).alias("odds_delta"),
        forced.alias("_forced"),
    ).where(F.col("_forced") | (F.col("odds_delta") >= 0.10)).drop("_forced")


@query("price_rollup", with_ctes(f"""
SELECT sec // 900 * 900 AS window_sec, ticker, {fx('bid * 100', 1)} AS bid_cents, {fx('ask * 100', 1)} AS ask_cents,
       {fx('(bid + ask) / 2 * 100', 1)} AS mid_cents, volume, count(*) AS snapshots
FROM snap GROUP BY sec // 900 * 900, ticker, bid, ask, volume""", v.SNAP))
def price_rollup(spark, sf):
    return sentiment.price_rollup(v.snap(spark, sf)).select(
        "window_sec", "ticker", fixed(F.col("bid") * 100, 1).alias("bid_cents"), fixed(F.col("ask") * 100, 1).alias("ask_cents"),
        fixed((F.col("bid") + F.col("ask")) / 2 * 100, 1).alias("mid_cents"), "volume", "snapshots",
    )


@query("top_liquid", with_ctes("""
SELECT ticker, series, bid, ask, volume, max(sec) AS last_update FROM snap WHERE status IN ('open', 'active')
GROUP BY ticker, series, bid, ask, volume ORDER BY volume DESC, ticker, bid, ask LIMIT 15""", v.SNAP))
def top_liquid(spark, sf):
    """The fifteen largest volumes among open quotes."""
    rows = v.snap(spark, sf).where(F.col("status").isin("open", "active"))
    grouped = rows.groupBy("ticker", "series", "bid", "ask", "volume").agg(F.max("sec").alias("last_update"))
    return grouped.orderBy(F.col("volume").desc(), "ticker", "bid", "ask").limit(15)


@query("running_counts", with_ctes("""
SELECT feed_key, link, count(*) OVER (PARTITION BY feed_key ORDER BY sec DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS article_rank
FROM articles""", v.ARTICLES))
def running_counts(spark, sf):
    """Articles of a feed counted from the newest back."""
    rows = v.articles(spark, sf).select("feed_key", "link", "doc_id", (-F.col("sec")).alias("_back"))
    counted = running(rows, ["feed_key"], [F.col("_back"), F.col("doc_id").desc()], sums={"article_rank": F.lit(1).cast("bigint")})
    return counted.select("feed_key", "link", "article_rank")


@query("hourly_codes", with_ctes(f"""
SELECT sec // 3600 * 3600 AS hour_sec, count(*) AS event_count, {fx('avg(impact)', 2)} AS avg_impact, {fx('avg(tone)', 2)} AS avg_tone,
       string_agg(DISTINCT code, ',' ORDER BY code) AS event_codes
FROM tones WHERE code LIKE '%i%' GROUP BY 1""", v.TONES))
def hourly_codes(spark, sf):
    rows = sentiment.hourly_codes(v.tones(spark, sf).where(F.col("code").contains("i")))
    return rows.withColumns({"avg_impact": fixed("avg_impact", 2), "avg_tone": fixed("avg_tone", 2)})


NEWS_WINDOWS = """
news_w AS (
  SELECT sec // 900 * 900 AS window_sec, avg(sentiment_score) AS m, stddev_samp(sentiment_score) AS sd, count(*) AS n,
         count(DISTINCT feed_key) AS feeds, min(sentiment_score) AS lo, max(sentiment_score) AS hi
  FROM articles GROUP BY 1),
tone_w AS (SELECT sec // 900 * 900 AS window_sec, avg(tone) AS tone, count(*) AS n FROM tones GROUP BY 1)"""


@query("news_windows", with_ctes(f"""
SELECT sec // 900 * 900 AS window_sec, count(*) AS article_count, count(DISTINCT feed_key) AS sources, {fx('avg(sentiment_score)', 6)} AS avg_sentiment,
       min(sentiment_score) AS most_negative, max(sentiment_score) AS most_positive
FROM articles WHERE lower(title) LIKE '%the%' AND sec > (SELECT max(sec) FROM articles) - 172800 GROUP BY 1""", v.ARTICLES))
def news_windows(spark, sf):
    """Quarter-hour roll-up of the last two days of articles that mention a topic."""
    rows = v.articles(spark, sf)
    recent = rows.where(F.lower("title").contains("the") & (F.col("sec") > rows.agg(F.max("sec")).scalar() - 172_800))
    return sentiment.news_windows(recent).select(
        "window_sec", "article_count", F.col("source_count").alias("sources"), fixed("sentiment_mean", 6).alias("avg_sentiment"),
        "most_negative", "most_positive",
    )


@query("sentiment_15m", with_ctes(f"""
SELECT w.window_sec, {fx('m', 6)} AS sentiment_mean, {fx('sd', 6)} AS sentiment_std, w.n AS article_count,
       {fx('coalesce(0.7::DOUBLE * m + 0.3::DOUBLE * (tone / 10), m)', 6)} AS blended_sentiment, least(1.0::DOUBLE, feeds / 10) AS confidence
FROM news_w w LEFT JOIN tone_w t ON w.window_sec = t.window_sec""", v.ARTICLES, v.TONES, NEWS_WINDOWS))
def sentiment_15m(spark, sf):
    rows = sentiment.blended_signal(v.articles(spark, sf), v.tones(spark, sf))
    return rows.select(
        "window_sec", fixed("sentiment_mean", 6).alias("sentiment_mean"), fixed("sentiment_std", 6).alias("sentiment_std"),
        "article_count", fixed("blended_sentiment", 6).alias("blended_sentiment"), "confidence",
    )


@query("blended_full_outer", with_ctes(f"""
SELECT coalesce(w.window_sec, t.window_sec) AS window_sec, {fx('coalesce(m, 0)', 6)} AS news_signal, {fx('coalesce(tone / 100, 0)', 6)} AS event_signal,
       coalesce(w.n, 0) AS articles, coalesce(t.n, 0) AS events,
       {fx('0.7::DOUBLE * coalesce(m, 0) + 0.3::DOUBLE * coalesce(tone / 100, 0)', 6)} AS blended
FROM news_w w FULL JOIN tone_w t ON w.window_sec = t.window_sec""", v.ARTICLES, v.TONES, NEWS_WINDOWS))
def blended_full_outer(spark, sf):
    rows = sentiment.blended_outer(v.articles(spark, sf), v.tones(spark, sf))
    return rows.select("window_sec", *[fixed(c, 6).alias(c) for c in ("news_signal", "event_signal", "blended")], "articles", "events")


@query("signal_price_interval", with_ctes(f"""
SELECT w.window_sec, {fx('m', 6)} AS sentiment_mean, s.snap_id, s.ticker, s.bid, s.sec
FROM news_w w JOIN snap s ON s.sec >= w.window_sec AND s.sec <= w.window_sec + 300""", v.ARTICLES, v.TONES, v.SNAP, NEWS_WINDOWS))
def signal_price_interval(spark, sf):
    """Quotes within five minutes after the start of a sentiment window."""
    signals = sentiment.news_windows(v.articles(spark, sf)).select("window_sec", fixed("sentiment_mean", 6).alias("sentiment_mean"))
    return sentiment.signal_entries(signals, v.snap(spark, sf).select("snap_id", "ticker", "bid", "sec")).select(
        "window_sec", "sentiment_mean", "snap_id", "ticker", "bid", "sec"
    )


@query("window_price_join", with_ctes(f"""
SELECT window_sec, {fx('m', 6)} AS signal, {fx('mid', 4)} AS mid_price
FROM news_w JOIN (SELECT sec // 900 * 900 AS window_sec, avg(ask) * 100 AS mid FROM snap WHERE series = 'S5' GROUP BY 1) USING (window_sec)""",
    v.ARTICLES, v.TONES, v.SNAP, NEWS_WINDOWS))
def window_price_join(spark, sf):
    """Sentiment windows beside the mean ask of one series in the same window."""
    prices = v.snap(spark, sf).where(F.col("series") == "S5").groupBy(sentiment.bucket(F.col("sec")).alias("window_sec")).agg(
        (F.avg("ask") * 100).alias("mid_price")
    )
    signals = sentiment.news_windows(v.articles(spark, sf)).select("window_sec", fixed("sentiment_mean", 6).alias("signal"))
    return signals.join(prices, "window_sec").select("window_sec", "signal", fixed("mid_price", 4).alias("mid_price"))
