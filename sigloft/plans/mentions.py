"""Mentions of entities and headline keywords, and their velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.text import first_number, headline_words, is_topic
from sigloft.operators.velocity import cross_source, mention_velocity

ENTITY_TYPES = {"persons": "person", "themes": "theme", "orgs": "organization", "locs": "location"}


def entity_mentions(records: DataFrame) -> DataFrame:
    """entity_type, entity_name, sec, tone: all four lists in one scan, malformed names dropped."""
    def tag(column: str, kind: str) -> Column:
        names = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("entity_name")))

    tagged = F.concat(*[tag(c, kind) for c, kind in ENTITY_TYPES.items()])
    return (
        records.select("sec", first_number(F.col("raw_tone")).alias("tone"), F.explode(tagged).alias("e"))
        .select("e.entity_type", "e.entity_name", "sec", "tone")
        .where(F.col("entity_name").rlike("^[A-Za-z0-9 _]+$"))
    )


def keyword_mentions(articles: DataFrame) -> DataFrame:
    """feed_key, keyword, link, sec, tone: one row per counted headline word."""
    return (
        articles.where(F.col("sec").isNotNull() & F.col("title").isNotNull())
        .select("feed_key", "link", "sec", F.col("sentiment_score").alias("tone"),
                F.explode(headline_words(F.col("title"))).alias("keyword"))
        .where(is_topic(F.col("keyword"), fv.VELOCITY_STOPWORDS, digits_lead=False))
    )


def _last_days(df: DataFrame, anchor_sec: Column) -> DataFrame:
    return df.where(F.col("sec") >= anchor_sec - 90 * 86_400)


def entity_velocity(records: DataFrame, anchor_sec: Column) -> DataFrame:
    """Frames over the last day, baseline over 90 days, both from one scan of the records."""
    return mention_velocity(entity_mentions(_last_days(records, anchor_sec)), ["entity_type", "entity_name"], "sec", "sec",
                            "tone", anchor_sec - 86_400, fv.ENTITY_BASELINE_FLOOR)


def keyword_velocity(articles: DataFrame, anchor_sec: Column) -> DataFrame:
    """Velocity per (feed, keyword) with the cross-feed tone spread and consensus of the keyword."""
    velocity = mention_velocity(keyword_mentions(_last_days(articles, anchor_sec)), ["feed_key", "keyword"], "sec", "link",
                                "tone", anchor_sec - 86_400, fv.KEYWORD_BASELINE_FLOOR)
    return cross_source(velocity, "keyword", "feed_key")


def source_velocity(articles: DataFrame, anchor_sec: Column) -> DataFrame:
    """The older per-feed form: mentions are whole articles."""
    seen = articles.where(F.col("sec").isNotNull()).withColumn("tone", F.col("sentiment_score"))
    return mention_velocity(_last_days(seen, anchor_sec), ["feed_key"], "sec", "link", "tone", anchor_sec - 86_400,
                            fv.SOURCE_BASELINE_FLOOR)
