"""Declared layer schemas and conforming of drifting inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """'name type, name type' of plain types; needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SNAPSHOT = _struct(
    "ticker string, title string, rules_primary string, yes_bid double, yes_ask double, volume double, "
    "open_interest_fp double, status string, close_time timestamp, floor_strike double, cap_strike double, "
    "series_ticker string, status_pulled string, ingested_at timestamp"
)
SETTLED = _struct(
    "ticker string, title string, result string, category string, settlement_ts timestamp, close_time timestamp, "
    "series_ticker string, status_pulled string, ingested_at timestamp"
)
ARTICLE = _struct(
    "source string, feed_key string, title string, link string, published_at string, summary string, full_text string, "
    "scraped boolean, ingested_at timestamp"
)
BRIDGE = _struct(
    "series_ticker string, entity_type string, entity_name string, required_regex string"
)
TRADE = _struct(
    "timestamp timestamp, ticker string, side string, count bigint, price_dollars double, total_risk_usd double, "
    "closed_at timestamp"
)
ORDER = _struct(
    "order_id string, arm string, ticker string, side string, count bigint, limit_price double, status string, "
    "created_at bigint, entry_bid double, entry_ask double, entry_mid double, filled_price double, filled_at bigint, "
    "close_price double, closed_at bigint, close_reason string, meta string"
)

#: price columns under their new name win over the legacy name
RENAMED = {"yes_bid_dollars": "yes_bid", "yes_ask_dollars": "yes_ask"}


def resolve_names(df: DataFrame, renamed: dict[str, str] = RENAMED) -> DataFrame:
    """New-style columns replace legacy ones of the same meaning."""
    for new, legacy in renamed.items():
        if new in df.columns:
            df = df.drop(legacy).withColumnRenamed(new, legacy)
    return df


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: present ones through ``try_cast``, missing ones as typed nulls or a default."""
    defaults = defaults or {}

    def one(field: T.StructField):
        if field.name not in df.columns:
            return F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name)
        have = df.schema[field.name].dataType
        if have == field.dataType:
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def first_present(df: DataFrame, candidates: Sequence[str], as_type: str = "string"):
    """The first of several column names that the frame has, else a typed null."""
    name = next((c for c in candidates if c in df.columns), None)
    return F.col(name) if name else F.lit(None).cast(as_type)


def union_by_name(frames: Sequence[DataFrame], schema: T.StructType, spark) -> DataFrame:
    """All frames under one schema; no frames give the empty frame of that schema."""
    result = spark.createDataFrame([], schema)
    for frame in frames:
        result = result.unionByName(conform(resolve_names(frame), schema))
    return result
