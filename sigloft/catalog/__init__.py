"""Registered queries: each is a Spark job over the given tables with, where SQL can say it, the same result in SQL."""

from sigloft.catalog.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    from sigloft.catalog import (  # noqa: F401
        backtests, book, candidates, ingest, markets, matching, news, retrieval, serving, study, tables, streams,
    )
