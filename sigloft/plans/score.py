"""Mispricing score: market moves, signals routed to markets, strongest signal, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import blank_to_null
from sigloft.functions.prices import anchored_score, change_since, legacy_score, raw_score, tone_to_unit
from sigloft.functions.text import headline_words, is_topic
from sigloft.operators.contains import contains_join
from sigloft.operators.keyed import top_per_key
from sigloft.operators.ordered import lag_rows
from sigloft.session import stored

#: row lags at a 15-minute cadence
LAGS = {"15m": 1, "1h": 4, "24h": 96}


def all_moves(snapshots: DataFrame, key: str, position: str, row_id: str, price: str,
              slots: int | None = None) -> DataFrame:
    """Relative move of every snapshot against 1, 4 and 96 rows earlier."""
    lagged = lag_rows(snapshots, [key], [F.col(position), F.col(row_id)], price,
                      {f"_p_{n}": k for n, k in LAGS.items()}, slots)
    return lagged.withColumns({
        f"delta_{n}": change_since(F.col(price), F.col(f"_p_{n}")) for n in LAGS
    }).drop(*[f"_p_{n}" for n in LAGS])


def latest_moves(snapshots: DataFrame, key: str, newest: list[str], price: str, carry: list[str]) -> DataFrame:
    """The latest snapshot per key with its moves.

    Only the newest 97 rows per key matter, and those are cut out before the shuffle; the lags are then picked by rank.
    """
    depth = max(LAGS.values()) + 1
    top = top_per_key(snapshots, [key], [F.col(c).desc() for c in newest], depth, rank="_back")

    def at(column: str, back: int) -> Column:
        return F.max(F.when(F.col("_back") == back + 1, F.col(column)))

    folded = top.groupBy(key).agg(
        *[at(c, 0).alias(c) for c in [price, *carry]], *[at(price, k).alias(f"_p_{n}") for n, k in LAGS.items()]
    )
    return folded.withColumns({
        f"delta_{n}": change_since(F.col(price), F.col(f"_p_{n}")) for n in LAGS
    }).drop(*[f"_p_{n}" for n in LAGS])


def bridge_matches(bridge: DataFrame, velocity: DataFrame) -> DataFrame:
    """series_ticker, entity_type, bridge_name, entity_name: same type, one name inside the other, any case.

    The bridge pattern, where there is one, must also be found in the entity name.
    """
    rows = bridge.select("series_ticker", "entity_type", F.col("entity_name").alias("bridge_name"),
                         F.lower("entity_name").alias("_b"), "required_regex")
    entities = velocity.select("entity_type", "entity_name", F.lower("entity_name").alias("_e")).distinct()
    in_entity = contains_join(entities.select("entity_type", "_e").distinct(), ["_e"], "_e", rows, "_b",
                              on=["entity_type"])
    in_bridge = contains_join(rows.select("entity_type", "_b").distinct(), ["_b"], "_b", entities, "_e",
                              on=["entity_type"])
    pairs = in_entity.select("entity_type", "_b", "_e").union(in_bridge.select("entity_type", "_b", "_e")).distinct()
    gate = blank_to_null(F.col("required_regex"))
    passes = gate.isNull() | F.expr("entity_name rlike concat('(?i)', required_regex)")
    return (
        pairs.join(rows, ["entity_type", "_b"]).join(entities, ["entity_type", "_e"]).where(passes)
        .select("series_ticker", "entity_type", "bridge_name", "entity_name").distinct()
    )


def _strongest(signals: DataFrame, key: str) -> DataFrame:
    """Per key the signal with the highest spike; on equal spikes the stronger, then the more positive tone."""
    order = [F.col("vol_spike_multiplier").desc(), F.abs("norm_sentiment").desc_nulls_last(),
             F.col("norm_sentiment").desc_nulls_last()]
    return top_per_key(signals, [key], order).select(key, "vol_spike_multiplier", "norm_sentiment")


def theme_signals(markets: DataFrame, bridge: DataFrame, velocity: DataFrame) -> DataFrame:
    """The strongest signal of each market's series; the order of signals does not depend on the market, so one row per series joins."""
    spikes = velocity.select("entity_type", "entity_name", "vol_spike_multiplier",
                             tone_to_unit(F.col("tone_15m")).alias("norm_sentiment"))
    best = _strongest(bridge_matches(bridge, velocity).join(spikes, ["entity_type", "entity_name"]), "series_ticker")
    return (
        best.join(markets.select("ticker", F.col("series").alias("series_ticker")), "series_ticker")
        .select("ticker", "vol_spike_multiplier", "norm_sentiment")
    )


def person_matches(markets: DataFrame, velocity: DataFrame) -> DataFrame:
    """ticker, entity_name: person names that stand in a market title (case matters)."""
    persons = velocity.where(F.col("entity_type") == "person").select("entity_name")
    return contains_join(markets, ["ticker"], "title", persons, "entity_name")


def person_signals(markets: DataFrame, velocity: DataFrame) -> DataFrame:
    spikes = velocity.where(F.col("entity_type") == "person").select(
        "entity_name", "vol_spike_multiplier", tone_to_unit(F.col("tone_15m")).alias("norm_sentiment")
    )
    return person_matches(markets, velocity).join(_strongest(spikes, "entity_name"), "entity_name").select(
        "ticker", "vol_spike_multiplier", "norm_sentiment"
    )


def route_words(articles: DataFrame, anchor_sec: Column) -> DataFrame:
    """feed_key, keyword: last-day headline words; read several times by the substring join, so they are stored once."""
    return stored(
        articles.where((F.col("sec") >= anchor_sec - 86_400) & F.col("title").isNotNull())
        .select("feed_key", F.explode(headline_words(F.col("title"))).alias("keyword"))
        .where(is_topic(F.col("keyword"), fv.ROUTING_STOPWORDS, digits_lead=True))
        .distinct(),
        "route-words",
    )


def keyword_hits(words: DataFrame, markets: DataFrame) -> DataFrame:
    """ticker, keyword: the words that occur inside a market title."""
    titles = markets.select("ticker", F.lower("title").alias("_title"))
    return contains_join(titles, ["ticker"], "_title", words, "keyword", shortest=4)


def keyword_routes(articles: DataFrame, markets: DataFrame, anchor_sec: Column) -> DataFrame:
    """ticker, feed_key, keyword: last-day headline words that occur inside a market title."""
    words = route_words(articles, anchor_sec)
    return keyword_hits(words, markets).join(words, "keyword").select("ticker", "feed_key", "keyword")


def keyword_signals(words: DataFrame, markets: DataFrame, velocity: DataFrame) -> DataFrame:
    """The strongest signal of each word over its feeds, for the markets whose title has the word."""
    spikes = velocity.select("feed_key", "keyword", "vol_spike_multiplier", F.col("tone_15m").alias("norm_sentiment"))
    best = _strongest(words.join(spikes, ["feed_key", "keyword"]), "keyword")
    return keyword_hits(words, markets).join(best, "keyword").select("ticker", "vol_spike_multiplier", "norm_sentiment")


def strongest_signal(signals: DataFrame) -> DataFrame:
    """Per ticker its strongest signal."""
    return _strongest(signals, "ticker").select(
        "ticker", F.col("vol_spike_multiplier").alias("max_spike_multiplier"),
        F.col("norm_sentiment").alias("sentiment_signal"),
    )


def mispricing(markets: DataFrame, signals: DataFrame, anchor: float = fv.SCORE_ANCHOR) -> DataFrame:
    """Markets with score and flag; markets without a signal score 0."""
    scored = markets.join(strongest_signal(signals), "ticker", "left").withColumn(
        "mispricing_score",
        anchored_score(raw_score(F.col("max_spike_multiplier"), F.col("sentiment_signal"), F.col("delta_24h")), anchor),
    )
    return scored.select(
        "ticker", "title", "yes_bid", "delta_15m", "delta_1h", "delta_24h", "max_spike_multiplier", "sentiment_signal",
        "mispricing_score", (F.col("mispricing_score") > fv.SCORE_FLAG).alias("flagged_candidate"),
        F.lit(None).cast("string").alias("brief"),
    )


def legacy_mispricing(markets: DataFrame, signals: DataFrame) -> DataFrame:
    """The older score: highest spike per ticker against the last move."""
    spikes = signals.groupBy("ticker").agg(F.max("vol_spike_multiplier").alias("max_spike_multiplier"))
    return markets.join(spikes, "ticker", "left").withColumn(
        "mispricing_score", legacy_score(F.col("max_spike_multiplier"), F.col("delta_15m"))
    )
