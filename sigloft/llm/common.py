"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Code points of texts whose pieces are gathered at once.
PORTION = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns of the table can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


def portions(texts: Iterable[str], most: int = PORTION) -> Iterator[list[str]]:
    """The texts of a batch in lists of bounded length in code points, or of one text."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def below(hashed: Column, wanted: int, rows: int) -> Column:
    """True for hashes under a bound that about ``wanted`` of so many rows pass; for all if there are no more."""
    share = min(1.0, wanted / max(rows, 1))
    return F.lit(True) if share == 1.0 else hashed < F.lit(int(-(2**63) + share * 2**64))
