"""Cleaning of landed events, records, articles, pages and markets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.numeric import blank_to_null
from sigloft.functions.text import (
    contains_any, event_class, has_theme, pad_code, page_text, page_title, pick_text, runs_of, sentiment_label, unpack_names,
    unpack_places,
)
from sigloft.sources.schemas import first_present


def political_events(events: DataFrame, code: str = "EventCode") -> DataFrame:
    """Events whose padded code starts with a kept root code."""
    padded = events.withColumn(code, pad_code(F.col(code)))
    return padded.where(F.substring(code, 1, 2).isin(*fv.POLITICAL_ROOT_CODES))


def political_records(records: DataFrame, themes: str = "V2Themes") -> DataFrame:
    return records.where(has_theme(F.col(themes), fv.POLITICAL_THEME_PREFIXES))


def enrich_events(events: DataFrame, event_codes: DataFrame, countries: DataFrame, classes: DataFrame,
                  actor_types: DataFrame | None = None, nationalities: DataFrame | None = None) -> DataFrame:
    """Events with readable labels for code, class, places, actor type and nationality.

    All lookups are code lists with one row per code, so they cannot multiply rows; Spark broadcasts those that it knows to be small. The country
    list is used in several roles; nationality codes are three letters long and need a list of their own, without which
    those labels stay null.
    """
    base = events.withColumn("EventCode", pad_code(F.col("EventCode").cast("string"))).withColumn(
        "class_code", event_class(F.col("EventRootCode"))
    )

    def look_up(df: DataFrame, table: DataFrame | None, key: str, label: str) -> DataFrame:
        if table is None or key not in df.columns:
            return df.withColumn(label, F.lit(None).cast("string"))
        code, text = table.columns
        named = table.select(F.col(code).alias(key), F.col(text).alias(label))
        return df.join(named, key, "left")

    for table, key, label in (
        (event_codes, "EventCode", "event_description"), (classes, "class_code", "quad_description"),
        (countries, "Actor1Geo_CountryCode", "actor1_country_name"),
        (countries, "Actor2Geo_CountryCode", "actor2_country_name"),
        (actor_types, "Actor1Type1Code", "actor1_type"), (nationalities, "Actor1CountryCode", "actor1_nationality"),
        (nationalities, "Actor2CountryCode", "actor2_nationality"),
    ):
        base = look_up(base, table, key, label)
    return base.select(
        F.col("GLOBALEVENTID").cast("string").alias("event_id"),
        first_present(base, ["SQLDATE"]).cast("string").alias("event_date"),
        first_present(base, ["Actor1Name"]).alias("actor1_name"), first_present(base, ["Actor2Name"]).alias("actor2_name"),
        "event_description", "quad_description", "actor1_country_name", "actor2_country_name",
        first_present(base, ["GoldsteinScale"]).try_cast("double").alias("intensity_score"),
        first_present(base, ["NumMentions"]).try_cast("int").alias("mention_count"),
        first_present(base, ["AvgTone"]).try_cast("double").alias("tone_score"),
        first_present(base, ["IsRootEvent"]).try_cast("int").alias("is_root_event"),
        "actor1_type", "actor1_nationality", "actor2_nationality",
        first_present(base, ["DATEADDED"]).cast("string").alias("date_added"),
        first_present(base, ["SOURCEURL"]).alias("source_url"),
    )


def clean_records(records: DataFrame) -> DataFrame:
    """Records with their packed lists as arrays; new-style columns win over old ones, missing ones are null."""
    return records.select(
        F.col("GKGRECORDID").alias("record_id"), F.col("DATE").cast("string").alias("event_date"),
        first_present(records, ["SOURCEURL", "DocumentIdentifier"]).alias("doc_url"),
        unpack_names(first_present(records, ["V2Persons", "Persons"])).alias("persons"),
        unpack_names(first_present(records, ["V2Themes", "Themes"])).alias("themes"),
        unpack_names(first_present(records, ["V2Organizations", "Organizations"])).alias("orgs"),
        unpack_places(first_present(records, ["V2Locations", "Locations"])).alias("locs"),
        F.coalesce(unpack_names(first_present(records, ["AllNames"])), F.array().cast("array<string>")).alias("names"),
        first_present(records, ["V2Tone"]).alias("raw_tone"), first_present(records, ["V2Counts"]).alias("raw_counts"),
        first_present(records, ["Amounts"]).alias("raw_amounts"), first_present(records, ["GCAM"]).alias("raw_gcam"),
    )


def lexicon_sentiment(texts: DataFrame, row_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """row_id, score, label: summed word valence s as s / sqrt(s^2 + 15).

    ``lexicon``: word, valence, one row per word. ``row_id`` is unique. Words meet the lexicon where they are as long as Spark knows it to be
    small, and their valences are summed on the map side; texts without any known word keep one row, with the sum 0. The texts are read once.
    """
    words = texts.select(row_id, F.explode_outer(runs_of(F.col(text), "[a-zA-Z0-9]+")).alias("word")).withColumn("word", F.lower("word"))
    total = words.join(lexicon, "word", "left").groupBy(row_id).agg(F.coalesce(F.sum("valence"), F.lit(0.0)).alias("_s"))
    score = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15.0)
    return total.select(row_id, score.alias("sentiment_score"), sentiment_label(score).alias("sentiment_label"))


def article_text(articles: DataFrame) -> DataFrame:
    """Adds the text that is scored and which column it came from."""
    return articles.withColumn("_p", pick_text(F.col("full_text"), F.col("summary"), F.col("title"))).select(
        *articles.columns, F.col("_p.text").alias("picked_text"), F.col("_p.source").alias("sentiment_source")
    )


def page_articles(pages: DataFrame, summary: str) -> DataFrame:
    """Page text with the feed summary as fallback; ``scraped`` tells which one it is."""
    text = blank_to_null(page_text(F.col("html")))
    return pages.withColumn("_text", text).select(
        "page_id", "url", page_title(F.col("html")).alias("title"),
        F.coalesce(F.col("_text"), F.col(summary)).alias("full_text"), F.col("_text").isNotNull().alias("scraped"),
    )


def political_markets(markets: DataFrame, series_categories: DataFrame,
                      categories: Sequence[str] = fv.TARGET_CATEGORIES) -> DataFrame:
    """Markets of the wanted category (looked up by series when blank) without excluded title words."""
    known = series_categories.select("series_ticker", F.col("category").alias("_series_category"))
    category = F.coalesce(blank_to_null(F.col("category")), F.col("_series_category"), F.lit(""))
    return (
        markets.join(known, "series_ticker", "left").withColumn("category", F.trim(category)).drop("_series_category")
        .where(F.col("category").isin(*categories) & ~contains_any(F.col("title"), fv.TITLE_EXCLUSIONS))
    )


def recently_settled(markets: DataFrame, cutoff: Column) -> DataFrame:
    """Settlement (else close) time at or after the cut-off; markets without either are kept."""
    at = F.coalesce("settlement_ts", "close_time")
    return markets.where((at.isNull() | (at >= cutoff)) & ~contains_any(F.col("title"), fv.TITLE_EXCLUSIONS))
