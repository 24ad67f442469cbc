"""Signals routed to markets and the mispricing score (the flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import news
from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import fixed
from sigloft.plans import score
from sigloft.session import stored, stored_together

_TITLED = "titled AS MATERIALIZED (SELECT m.ticker, m.series, b.text AS title FROM (SELECT DISTINCT ticker, series, item FROM msnap) m JOIN benchmark b ON b.item_id = m.item)"
_THEMES = """
theme_match AS MATERIALIZED (
  SELECT DISTINCT b.series_ticker, b.entity_type, b.entity_name AS bridge_name, e.entity_name
  FROM bridge b JOIN (SELECT DISTINCT entity_type, entity_name FROM env) e ON b.entity_type = e.entity_type
   AND (contains(lower(e.entity_name), lower(b.entity_name)) OR contains(lower(b.entity_name), lower(e.entity_name)))
  WHERE b.required_regex IS NULL OR b.required_regex = '' OR regexp_matches(e.entity_name, '(?i)' || b.required_regex))"""
_PERSONS = """
person_match AS MATERIALIZED (
  SELECT DISTINCT t.ticker, e.entity_name FROM titled t, (SELECT DISTINCT entity_name FROM env WHERE entity_type = 'person') e
  WHERE contains(t.title, e.entity_name))"""
_ROUTES = f"""
route_words AS MATERIALIZED (
  SELECT DISTINCT feed_key, keyword FROM article_words
  WHERE sec >= (SELECT a FROM kw_anchor) - 86400 AND length(keyword) > 3 AND keyword NOT IN {news.in_list(fv.ROUTING_STOPWORDS)}),
route_hits AS MATERIALIZED (SELECT t.ticker, w.keyword FROM titled t, (SELECT DISTINCT keyword FROM route_words) w WHERE contains(lower(t.title), w.keyword)),
routes AS MATERIALIZED (SELECT ticker, feed_key, keyword FROM route_hits JOIN route_words USING (keyword))"""
_SIGNALS = """
signals AS MATERIALIZED (
  SELECT t.ticker, e.vol_spike_multiplier AS spike, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, e.tone_15m / 10)) AS tone
  FROM theme_match m JOIN env e USING (entity_type, entity_name) JOIN titled t ON t.series = m.series_ticker
  UNION ALL
  SELECT p.ticker, e.vol_spike_multiplier, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, e.tone_15m / 10))
  FROM person_match p JOIN env e ON e.entity_type = 'person' AND e.entity_name = p.entity_name
  UNION ALL
  SELECT r.ticker, k.vol_spike_multiplier, k.tone_15m FROM routes r JOIN kwv k USING (feed_key, keyword)),
strongest AS MATERIALIZED (
  SELECT ticker, spike AS max_spike_multiplier, tone AS sentiment_signal FROM signals
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY spike DESC, abs(tone) DESC, tone DESC) = 1)"""
_MARKETS = """
market_rows AS (
  SELECT ticker, series, item, status, yes_bid, sec, snap_id, row_number() OVER (PARTITION BY ticker ORDER BY sec DESC, snap_id DESC) AS r,
         lag(yes_bid, 1) OVER w AS p15, lag(yes_bid, 4) OVER w AS p1, lag(yes_bid, 96) OVER w AS p24
  FROM msnap WHERE sec >= (SELECT max(sec) FROM msnap) - 2592000 WINDOW w AS (PARTITION BY ticker ORDER BY sec, snap_id)),
markets AS MATERIALIZED (
  SELECT ticker, series, yes_bid, CASE WHEN p15 > 0 THEN (yes_bid - p15) / p15 ELSE 0 END AS delta_15m,
         CASE WHEN p1 > 0 THEN (yes_bid - p1) / p1 ELSE 0 END AS delta_1h, CASE WHEN p24 > 0 THEN (yes_bid - p24) / p24 ELSE 0 END AS delta_24h
  FROM market_rows WHERE r = 1 AND status IN ('active', 'open'))"""
_ENTITIES = (v.RECORDS, news.ENTITY_VELOCITY)
_WORDS = (v.ARTICLES, news.KEYWORDS, news.KEYWORD_VELOCITY)


def titled_markets(spark, sf):
    """ticker, series, title of every market that has a quote."""
    seen = v.market_snap(spark, sf).select("ticker", "series", "item").distinct()
    items = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("title"))
    return seen.join(items, "item").select("ticker", "series", "title")


def moved_markets(spark, sf, days: int = 30):
    """Latest open markets of the look-back with their moves and titles; the title joins after the cut to one row."""
    rows = v.market_snap(spark, sf)
    recent = rows.where(F.col("sec") >= rows.agg(F.max("sec")).scalar() - days * 86_400)
    latest = score.latest_moves(recent, "ticker", ["sec", "snap_id"], "yes_bid", ["series", "item", "status"])
    items = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("title"))
    return latest.where(F.col("status").isin("active", "open")).join(items, "item")


def velocity_and(spark, sf, markets):
    """Both velocity tables and the markets, each read several times below and therefore stored."""
    return stored_together(entities=news.record_velocity(spark, sf), words=news.article_velocity(spark, sf), markets=markets)


def signals(spark, sf, tables):
    """All three signal sources for the stored markets (ticker, series, title)."""
    markets, entities = tables["markets"].select("ticker", "series", "title"), tables["entities"]
    articles = v.articles(spark, sf)
    words = score.route_words(articles, articles.agg(F.max("sec")).scalar())
    return (
        score.theme_signals(markets, v.bridge(spark), entities)
        .union(score.person_signals(markets, entities)).union(score.keyword_signals(words, markets, tables["words"]))
    )


@query("theme_bridge_join", with_ctes("SELECT * FROM theme_match", v.RECORDS, news.ENTITY_VELOCITY, v.BRIDGE, _THEMES))
def theme_bridge_join(spark, sf):
    return score.bridge_matches(v.bridge(spark), stored(news.record_velocity(spark, sf), "entity-velocity"))


@query("person_title_match", with_ctes("SELECT * FROM person_match", v.SNAP, v.MSNAP, _TITLED, *_ENTITIES, _PERSONS))
def person_title_match(spark, sf):
    return score.person_matches(titled_markets(spark, sf), stored(news.record_velocity(spark, sf), "entity-velocity"))


@query("keyword_title_route", with_ctes("SELECT * FROM routes", v.SNAP, v.MSNAP, _TITLED, *_WORDS, _ROUTES))
def keyword_title_route(spark, sf):
    rows = v.articles(spark, sf)
    return score.keyword_routes(rows, titled_markets(spark, sf), rows.agg(F.max("sec")).scalar())


_ALL = (v.SNAP, v.MSNAP, _TITLED, *_ENTITIES, *_WORDS, v.BRIDGE, _THEMES, _PERSONS, _ROUTES, _SIGNALS)


@query("strongest_signal", with_ctes(
    f"SELECT ticker, {fx('max_spike_multiplier', 6)} AS max_spike_multiplier, {fx('sentiment_signal', 6)} AS sentiment_signal FROM strongest", *_ALL))
def strongest_signal(spark, sf):
    best = score.strongest_signal(signals(spark, sf, velocity_and(spark, sf, titled_markets(spark, sf))))
    return best.select("ticker", *[fixed(c, 6).alias(c) for c in ("max_spike_multiplier", "sentiment_signal")])


_RAW = "CASE WHEN max_spike_multiplier IS NULL THEN 0 ELSE max_spike_multiplier * abs(sentiment_signal) * (1 + abs(delta_24h)) END"
_SCORE = f"least(100.0::DOUBLE, greatest(0.0::DOUBLE, 80 * ln(1 + {_RAW}) / ln(10.0::DOUBLE)))"


@query("mispricing_score", with_ctes(f"""
SELECT ticker, yes_bid, {fx('delta_15m', 6)} AS delta_15m, {fx('delta_1h', 6)} AS delta_1h, {fx('delta_24h', 6)} AS delta_24h,
       {fx('max_spike_multiplier', 6)} AS max_spike_multiplier, {fx('sentiment_signal', 6)} AS sentiment_signal,
       {fx(_SCORE, 4)} AS mispricing_score, {_SCORE} > 80 AS flagged_candidate
FROM markets LEFT JOIN strongest USING (ticker)""", *_ALL, _MARKETS))
def mispricing_score(spark, sf):
    """Every open market with its moves, strongest signal, score and flag."""
    tables = velocity_and(spark, sf, moved_markets(spark, sf))
    scored = score.mispricing(tables["markets"], signals(spark, sf, tables))
    return scored.select(
        "ticker", "yes_bid", *[fixed(c, 6).alias(c) for c in ("delta_15m", "delta_1h", "delta_24h", "max_spike_multiplier", "sentiment_signal")],
        fixed("mispricing_score", 4).alias("mispricing_score"), "flagged_candidate",
    )


@query("legacy_score", with_ctes(f"""
SELECT ticker, {fx('CASE WHEN m IS NULL THEN 0 ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, m * 10 - delta_15m * 100)) END', 4)} AS mispricing_score
FROM markets LEFT JOIN (
  SELECT t.ticker, max(e.vol_spike_multiplier) AS m FROM theme_match x JOIN env e USING (entity_type, entity_name) JOIN titled t ON t.series = x.series_ticker
  GROUP BY t.ticker) USING (ticker)""", v.SNAP, v.MSNAP, _TITLED, *_ENTITIES, v.BRIDGE, _THEMES, _MARKETS))
def legacy_score(spark, sf):
    """The older score over theme signals only."""
    tables = stored_together(entities=news.record_velocity(spark, sf), markets=moved_markets(spark, sf))
    themes = score.theme_signals(tables["markets"].select("ticker", "series", "title"), v.bridge(spark), tables["entities"])
    return score.legacy_mispricing(tables["markets"], themes).select("ticker", fixed("mispricing_score", 4).alias("mispricing_score"))
