"""Document retrieval over vectors, and the feed of documents to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.prices import decayed
from sigloft.functions.text import joined_text
from sigloft.operators.vectors import nearest_documents, similarity
from sigloft.session import stored
from sigloft.sources import tables


def decayed_context(queries: DataFrame, documents: DataFrame, k: int = 15, window: int = 72 * 3600,
                    floor: float = fv.SIMILARITY_FLOOR, gate: float = fv.RETRIEVAL_GATE) -> DataFrame:
    """Per query the k nearest documents per collection of the last three days, scored by similarity and age.

    Adds ``passes_gate``: whether the best similarity of the query (not the decayed score) reaches the gate.
    """
    near = nearest_documents(queries, documents, k, window).withColumn("similarity", similarity(F.col("distance")))
    kept = near.where(F.col("similarity") >= floor).join(queries.select("query_id", "as_of"), "query_id")
    hours = (F.col("as_of") - F.col("doc_time")) / 3600.0
    scored = kept.withColumn("score", decayed(F.col("similarity"), hours))
    best = scored.groupBy("query_id").agg((F.max("similarity") >= gate).alias("passes_gate"))
    return scored.join(best, "query_id")


def cascading_context(queries: DataFrame, documents: DataFrame, k: int = 3, floor: float = fv.SIMILARITY_FLOOR,
                      short: int = 900, long: int = 7200, enough: int = 2) -> DataFrame:
    """One row per query: the tier (short window, long window or ghost), its document count and best similarity."""

    def tier(window: int, name: str) -> DataFrame:
        near = nearest_documents(queries, documents, k, window).withColumn("similarity", similarity(F.col("distance")))
        return near.where(F.col("similarity") >= floor).groupBy("query_id").agg(
            F.count("*").alias(f"{name}_docs"), F.max("similarity").alias(f"{name}_best")
        )

    joined = queries.select("query_id").join(tier(short, "short"), "query_id", "left").join(tier(long, "long"), "query_id", "left")
    flash, echo = F.col("short_docs") >= enough, F.col("long_docs") >= enough
    return joined.select(
        "query_id", F.when(flash, "15m").when(echo, "2h").otherwise("ghost").alias("tier"),
        F.when(flash, F.col("short_docs")).when(echo, F.col("long_docs")).otherwise(0).alias("docs"),
        F.when(flash, F.col("short_best")).when(echo, F.col("long_best")).alias("best_similarity"),
    )


def point_in_time_context(queries: DataFrame, documents: DataFrame, k: int = 5, window: int = 7200,
                          floor: float = fv.STUDY_SIMILARITY_FLOOR) -> DataFrame:
    """Only documents already known at the event time."""
    near = nearest_documents(queries, documents, k, window).withColumn("similarity", similarity(F.col("distance")))
    return near.where(F.col("similarity") >= floor)


def embed_feed(articles: DataFrame, done: DataFrame, watermark: Column) -> DataFrame:
    """All rows not embedded yet.

    The watermark is the newest time already taken; rows of exactly that time are still considered and the ids already
    done are taken out, so a cut between rows of equal time loses nothing.
    """
    return articles.where(F.col("sec") >= watermark).join(done.select("link"), "link", "left_anti")


def embed_documents(feed: DataFrame, collection: str, max_chars: int = fv.MODEL_INPUT_CHARS) -> DataFrame:
    """One row per window of the text: id, window number, window, md5 of the whole text, metadata.

    A model of limited input takes ``max_chars`` characters, so the whole text is cut into consecutive windows of that length; an
    empty text is one empty window. The publish time falls back to ingest.
    """
    document = joined_text(F.col("title"), F.col("full_text"))
    last = F.greatest(F.ceil(F.length("_document") / max_chars) - 1, F.lit(0))
    windows = feed.withColumn("_document", document).withColumn("_window", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return windows.select(
        F.concat_ws("_", F.lit(collection), F.col("link")).alias("id"), F.col("_window").alias("window"), F.md5("_document").alias("document_md5"),
        F.substr("_document", (F.col("_window") * max_chars + 1).cast("int"), F.lit(max_chars)).alias("model_input"),
        F.col("sec").alias("ingested_timestamp"), F.coalesce("published_sec", "sec").alias("published_timestamp"),
        "source", F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment"),
    )


def pending_documents(feed: DataFrame, collection: str, held: DataFrame | None) -> DataFrame:
    """The rows of the feed whose document is not in the store as it is now: new ones and changed ones.

    ``held``: the store's rows (id, document_md5); every window of a document carries the md5 of the whole text.
    """
    if held is None:
        return feed
    known = held.groupBy("id").agg(F.max("document_md5").alias("_held"))
    wanted = feed.withColumn("id", F.concat_ws("_", F.lit(collection), F.col("link"))).join(known, "id", "left")
    changed = F.col("_held").isNull() | (F.col("_held") != F.md5(joined_text(F.col("title"), F.col("full_text"))))
    return wanted.where(changed).drop("id", "_held")


def sync_embeddings(spark: SparkSession, feed: DataFrame, collection: str, path: str, batch_size: int, max_chars: int = fv.MODEL_INPUT_CHARS) -> int:
    """Brings the store of windows to embed in line with the feed, oldest documents first, and returns how many batches it took.

    A batch is the ``batch_size`` oldest pending documents and all others of the last one's time, so a cut never parts rows of equal time;
    batches follow until none is pending. A batch replaces all windows of its documents, so a document that got shorter leaves none
    behind. Only the windows of a batch's documents are written, and what is in line already is not touched.
    """
    try:
        held = tables.read_buckets(spark, path, select=["id", "document_md5"])
    except FileNotFoundError:
        held = None
    pending = stored(pending_documents(feed, collection, held).repartitionByRange("sec"), "pending")
    batches, done = 0, None
    while True:
        rest = pending if done is None else pending.where(F.col("sec") > done)
        cut = rest.select("sec").orderBy("sec").limit(batch_size).agg(F.max("sec")).first()[0]
        if cut is None:
            return batches
        tables.replace_buckets(spark, path, embed_documents(rest.where(F.col("sec") <= cut), collection, max_chars), "id")
        batches, done = batches + 1, cut


def collection_stats(documents: DataFrame) -> DataFrame:
    size = F.size("vector")
    return documents.groupBy("collection").agg(
        F.count("*").alias("documents"), F.min(size).cast("bigint").alias("min_dims"),
        F.max(size).cast("bigint").alias("max_dims"), (F.sum(size) * 4).cast("bigint").alias("vector_bytes"),
        F.min("doc_time").alias("first_time"), F.max("doc_time").alias("last_time"),
    )
