"""Rounding and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(value: Column | str, digits: int) -> Column:
    """Half-up decimal rounding of the binary value, one rule for every money and ratio column."""
    scale = 10**digits
    return F.floor(col(value) * scale + F.lit(0.5)) / F.lit(scale)


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of a division by zero."""
    return top / F.nullif(bottom, F.lit(0.0))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, text)
