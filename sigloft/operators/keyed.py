"""Latest, best and top-k rows per key.

All of them are ``row_number() <= k`` with k below Spark's group-limit threshold, so every map task keeps at most k rows
per key before the shuffle. A key that holds a third of the table costs its reducer k rows per map task, no more. A larger k
is cut twice: first per key and a salt of the row's content, then per key over what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = 1000
SALTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1,
                rank: str | None = None) -> DataFrame:
    """The first k rows per key. ``order`` must end in a unique column so that the result is determined."""
    name = rank or "_rank"
    if k >= GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]), F.lit(SALTS))
        part = Window.partitionBy(*keys, salt).orderBy(*order)
        df = df.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= k).drop("_part")
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return top if rank else top.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], *newest: str) -> DataFrame:
    """One row per key: the highest ``newest`` columns, nulls last."""
    return top_per_key(df, keys, [F.col(c).desc_nulls_last() for c in newest])


def last_known_values(df: DataFrame, keys: Sequence[str], at: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key and column the newest value that is not null, each column on its own."""
    moment = f"struct({', '.join(at)})"
    return df.groupBy(*keys).agg(
        *[F.expr(f"max_by({c}, {moment}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in columns]
    )


def dedup_keeping_null_keys(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """Latest row per key; rows without a key are passed through."""
    keyed = latest_per_key(df.where(F.col(key).isNotNull()), [key], *newest)
    return keyed.unionByName(df.where(F.col(key).isNull()))


def duplicate_report(df: DataFrame, key: Sequence[str], moment: str) -> DataFrame:
    """One row: total rows, distinct keys, distinct (key, moment), share of rows beyond the first per key.

    Counted from grouped rows, not with two ``count(distinct)``, so no row is copied per distinct expression.
    """
    per_pair = df.groupBy(*key, moment).agg(F.count("*").alias("_n"))
    per_key = per_pair.groupBy(*key).agg(F.sum("_n").alias("_n"), F.count("*").alias("_pairs"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum("_pairs"), F.lit(0)).cast("bigint").alias("distinct_key_times"),
        (F.lit(100.0) * (F.sum("_n") - F.count("*")) / F.sum("_n")).alias("duplicate_pct"),
    )
