"""Exact nearest documents per query inside a time window.

Queries and documents meet in time buckets of the window length (an equi-join key), and only buckets that hold a query
are shuffled. Inside a bucket both sides are cut into blocks; each (document block, query block) is scored as one matrix
product and emits at most k rows per query and collection, so neither a broadcast nor a pair list is needed and a crowded
bucket is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.operators.keyed import top_per_key

DOCUMENT_BLOCK = 20_000
QUERY_BLOCK = 512
_SCHEMA = "query_id bigint, collection string, doc_id bigint, doc_time bigint, distance double"


def nearest_documents(queries: DataFrame, documents: DataFrame, k: int, window: int | None = None,
                      document_block: int = DOCUMENT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Top-k documents per (query, collection) by cosine distance, ties by document id.

    ``queries``: query_id, as_of, vector. ``documents``: collection, doc_id, doc_time, vector. Times are whole seconds.
    With a window only documents in [as_of - window, as_of] count; without one all documents do. A document never
    answers a query of the same id.
    """
    if window is None:
        parts = {"_bucket": F.lit(0).cast("bigint"), "_q_parts": queries.agg(F.ceil(F.count("*") / query_block)).scalar(),
                 "_d_parts": documents.agg(F.ceil(F.count("*") / document_block)).scalar()}
        return _nearest_in_blocks(queries.withColumns(parts), documents.withColumns(parts), k, None)
    low, high = F.floor((F.col("as_of") - window) / window), F.floor(F.col("as_of") / window)
    asks = queries.withColumn("_bucket", F.explode(F.array_distinct(F.array(low, high))))
    docs = documents.withColumn("_bucket", F.floor(F.col("doc_time") / window))
    return nearest_in_buckets(asks, docs, k, window, document_block, query_block)


def nearest_in_buckets(asks: DataFrame, docs: DataFrame, k: int, window: int | None = None, document_block: int = DOCUMENT_BLOCK,
                       query_block: int = QUERY_BLOCK) -> DataFrame:
    """As :func:`nearest_documents` for queries and documents that meet by a ``_bucket`` (bigint) of theirs only.

    How many blocks a bucket is cut into is one row per bucket; Spark chooses how to join it by its size.
    """
    q_parts, d_parts = F.ceil(F.count("*") / query_block), F.ceil(F.count("*") / document_block)
    asked, stocked = asks.groupBy("_bucket").agg(q_parts.alias("_q_parts")), docs.groupBy("_bucket").agg(d_parts.alias("_d_parts"))
    blocks = asked.join(stocked, "_bucket")
    return _nearest_in_blocks(asks.join(blocks, "_bucket"), docs.join(blocks, "_bucket"), k, window)


def _nearest_in_blocks(asks: DataFrame, docs: DataFrame, k: int, window: int | None) -> DataFrame:
    """The scoring, for sides that know into how many blocks their bucket is cut (``_q_parts``, ``_d_parts``)."""
    ask_blocks = (
        asks.withColumn("_q", F.pmod(F.xxhash64("query_id"), "_q_parts"))
        .withColumn("_d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_d_parts") - 1)))
        .select("_bucket", "_d", "_q", "query_id", "as_of", "vector")
    )
    doc_blocks = (
        docs.withColumn("_d", F.pmod(F.xxhash64("collection", "doc_id"), "_d_parts"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_q_parts") - 1)))
        .select("_bucket", "_d", "_q", "collection", "doc_id", "doc_time", "vector")
    )

    def score(asks_pdf: pd.DataFrame, docs_pdf: pd.DataFrame) -> pd.DataFrame:
        picked_q, picked_d = [], []
        if not asks_pdf.empty and not docs_pdf.empty:
            q = np.stack(asks_pdf["vector"].to_numpy()).astype(np.float64)
            d = np.stack(docs_pdf["vector"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]
            distance = np.floor((1.0 - (q @ d.T) / np.where(norms == 0, 1.0, norms)) * 1e9 + 0.5) / 1e9
            ids, times = docs_pdf["doc_id"].to_numpy(), docs_pdf["doc_time"].to_numpy()
            allowed = ids[None, :] != asks_pdf["query_id"].to_numpy()[:, None]
            if window is not None:
                age = asks_pdf["as_of"].to_numpy()[:, None] - times[None, :]
                allowed &= (age >= 0) & (age <= window)
            codes, _ = pd.factorize(docs_pdf["collection"])
            for code in np.unique(codes):
                member = np.flatnonzero(codes == code)
                rows, best = _least(np.where(allowed[:, member], distance[:, member], np.inf), ids[member], k)
                picked_q.append(rows)
                picked_d.append(member[best])
        at_q = np.concatenate(picked_q) if picked_q else np.empty(0, dtype=np.int64)
        at_d = np.concatenate(picked_d) if picked_d else np.empty(0, dtype=np.int64)
        chosen = docs_pdf.iloc[at_d]
        return pd.DataFrame({
            "query_id": asks_pdf["query_id"].to_numpy()[at_q],
            "collection": np.asarray(chosen["collection"], dtype=object),
            "doc_id": chosen["doc_id"].to_numpy(),
            "doc_time": chosen["doc_time"].to_numpy(),
            "distance": distance[at_q, at_d] if len(at_q) else np.empty(0),
        })

    scored = (
        ask_blocks.groupBy("_bucket", "_d", "_q")
        .cogroup(doc_blocks.groupBy("_bucket", "_d", "_q"))
        .applyInPandas(score, _SCHEMA)
    )
    return top_per_key(scored, ["query_id", "collection"], [F.col("distance"), F.col("doc_id")], k)


def _least(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least finite distances of each row, ties by id; more only where the k-th is tied.

    One partial selection for the whole block finds each row's k-th distance; only what is not above it is ordered.
    """
    if distance.shape[1] > k:
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero((distance <= limit) & np.isfinite(distance))
    else:
        rows, columns = np.nonzero(np.isfinite(distance))
    order = np.lexsort((ids[columns], distance[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def similarity(distance):
    """1 / (1 + distance)."""
    return F.lit(1.0) / (F.lit(1.0) + distance)
