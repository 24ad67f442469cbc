"""Retrieval over vectors and the embedding feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloft.catalog import views as v
from sigloft.catalog.registry import fx, query, with_ctes
from sigloft.functions.numeric import fixed
from sigloft.operators.keyed import top_per_key
from sigloft.operators.vector_index import build_index, calibrated_probes, indexed_nearest
from sigloft.operators.vectors import nearest_documents
from sigloft.plans import retrieval as plan
from sigloft.session import shared_folder, stored
from sigloft.sources import tables


def _inputs(spark, sf):
    return v.vector_queries(spark, sf), v.vectors(spark, sf).select("collection", "doc_id", "doc_time", "vector")


@query("topk_similarity", with_ctes(f"""
SELECT query_id, collection, doc_id, {fx('1 - distance / 2', 6)} AS similarity FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, doc_id) <= 5""", v.VECTORS))
def topk_similarity(spark, sf):
    """Five nearest documents per query and collection, without a time window."""
    near = nearest_documents(*_inputs(spark, sf), 5)
    return near.select("query_id", "collection", "doc_id", fixed(1 - F.col("distance") / 2, 6).alias("similarity"))


_TOPK = f"""
SELECT query_id, collection, doc_id, {fx('1 - distance / 2', 6)} AS similarity FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, doc_id) <= 5"""


def _index(spark, sf):
    """An index of all vectors with about as many lists as the square root of their number."""
    rows = _inputs(spark, sf)[1]
    return build_index(rows, max(1, round(rows.count() ** 0.5)), shared_folder(spark, "vector-index"))


@query("indexed_similarity", with_ctes(_TOPK, v.VECTORS))
def indexed_similarity(spark, sf):
    """The same five nearest documents from an inverted-file index, the lists that may still hold a nearer one included."""
    near = indexed_nearest(_index(spark, sf), _inputs(spark, sf)[0], 5, 8, complete=True)
    return near.select("query_id", "collection", "doc_id", fixed(1 - F.col("distance") / 2, 6).alias("similarity"))


@query("probed_similarity", with_ctes(f"SELECT query_id, collection, n >= 5 AS filled, true AS recalled FROM (SELECT query_id, collection, count(*) AS n FROM ({_TOPK}) GROUP BY 1, 2)", v.VECTORS))
def probed_similarity(spark, sf):
    """Per query and collection, whether as many lists as were found to be needed give at least 95 of 100 of the exact five nearest, over all queries."""
    queries, rows = _inputs(spark, sf)
    index = _index(spark, sf)
    exact = nearest_documents(queries, rows, 5).select("query_id", "collection", "doc_id")
    probed = indexed_nearest(index, queries, 5, calibrated_probes(index, queries, 5, 0.95)).select("query_id", "collection", "doc_id", F.lit(1).alias("hit"))
    met = stored(exact.join(probed, ["query_id", "collection", "doc_id"], "left"), "recall")
    recall = met.agg((F.count("hit") / F.count("*") >= 0.95)).scalar()
    return met.groupBy("query_id", "collection").agg((F.count("*") >= 5).alias("filled")).withColumn("recalled", recall)


def _window(seconds: int, k: int, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, 1 / (1 + distance) AS similarity FROM (
    SELECT * FROM pairs WHERE doc_time BETWEEN as_of - {seconds} AND as_of
    QUALIFY row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, doc_id) <= {k}))"""


@query("decayed_retrieval", with_ctes(f"""
SELECT query_id, collection, doc_id, {fx('similarity', 6)} AS similarity, {fx('similarity * (0.6::DOUBLE + 0.4::DOUBLE * exp(-0.693::DOUBLE * ((as_of - doc_time) / 3600) / 24))', 6)} AS score,
       max(similarity) OVER (PARTITION BY query_id) >= 0.63::DOUBLE AS passes_gate
FROM near WHERE similarity >= 0.5::DOUBLE""", v.VECTORS, _window(259_200, 15, "near")))
def decayed_retrieval(spark, sf):
    """Fifteen nearest documents of three days per collection, ranked by similarity and age."""
    rows = plan.decayed_context(*_inputs(spark, sf))
    return rows.select("query_id", "collection", "doc_id", fixed("similarity", 6).alias("similarity"), fixed("score", 6).alias("score"), "passes_gate")


@query("cascading_retrieval", with_ctes(f"""
SELECT query_id, CASE WHEN sn >= 2 THEN '15m' WHEN ln >= 2 THEN '2h' ELSE 'ghost' END AS tier, CASE WHEN sn >= 2 THEN sn WHEN ln >= 2 THEN ln ELSE 0 END AS docs,
       {fx('CASE WHEN sn >= 2 THEN sb WHEN ln >= 2 THEN lb END', 6)} AS best_similarity
FROM asks LEFT JOIN (SELECT query_id, count(*) AS sn, max(similarity) AS sb FROM short_w WHERE similarity >= 0.5::DOUBLE GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS ln, max(similarity) AS lb FROM long_w WHERE similarity >= 0.5::DOUBLE GROUP BY 1) USING (query_id)""",
    v.VECTORS, _window(900, 3, "short_w"), _window(7200, 3, "long_w")))
def cascading_retrieval(spark, sf):
    """Evidence of the last quarter-hour, else of two hours, else none."""
    return plan.cascading_context(*_inputs(spark, sf)).withColumn("best_similarity", fixed("best_similarity", 6))


@query("pit_retrieval", with_ctes(f"""
SELECT query_id, collection, doc_id, {fx('similarity', 6)} AS similarity FROM near WHERE similarity >= 0.45::DOUBLE""", v.VECTORS, _window(86_400, 5, "near")))
def pit_retrieval(spark, sf):
    """Only documents known at the time of the query, here of the last day."""
    rows = plan.point_in_time_context(*_inputs(spark, sf), window=86_400)
    return rows.select("query_id", "collection", "doc_id", fixed("similarity", 6).alias("similarity"))


@query("collection_stats", with_ctes("""
SELECT collection, count(*) AS documents, min(len(v)) AS min_dims, max(len(v)) AS max_dims, CAST(sum(len(v)) * 4 AS BIGINT) AS vector_bytes,
       min(doc_time) AS first_time, max(doc_time) AS last_time FROM vec GROUP BY collection""", v.VECTORS))
def collection_stats(spark, sf):
    return plan.collection_stats(v.vectors(spark, sf))


@query("collection_samples", with_ctes("""
SELECT collection, label::BIGINT AS label, doc_time FROM vec QUALIFY row_number() OVER (PARTITION BY collection ORDER BY vec_id) <= 5""", v.VECTORS))
def collection_samples(spark, sf):
    """The first five documents of every collection."""
    rows = v.vectors(spark, sf).select("collection", F.col("label").cast("bigint").alias("label"), "doc_time", "doc_id")
    return top_per_key(rows, ["collection"], [F.col("doc_id")], 5).drop("doc_id")


def _articles(spark, sf):
    rows = v.articles(spark, sf)
    return rows.select("doc_id", "link", "sec", "source", "sentiment_score", F.concat(F.lit("Article "), F.col("link")).alias("title"),
                       F.col("title").alias("full_text"), F.when(F.col("doc_id") % 4 != 0, F.col("sec") - 60).alias("published_sec"))


_MARK = f"(SELECT min(sec) + (max(sec) - min(sec)) // 3 FROM articles)"
_FEED = f"""
feed AS (SELECT * FROM articles WHERE sec >= {_MARK} AND doc_id NOT IN (SELECT doc_id FROM labels))"""


@query("embed_feed", with_ctes("SELECT link, sec FROM feed", v.ARTICLES, _FEED))
def embed_feed(spark, sf):
    """All articles behind the watermark that are not embedded yet (labelled documents are)."""
    return _feed(spark, sf).select("link", "sec")


def _feed(spark, sf):
    rows = _articles(spark, sf)
    done = v.table(spark, sf, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("link"))
    times = v.articles(spark, sf).agg((F.min("sec") + F.floor((F.max("sec") - F.min("sec")) / 3)).cast("bigint"))
    return plan.embed_feed(rows, done, times.scalar())


@query("doc_sentences", with_ctes("""
SELECT 'news_' || link AS id, w AS "window", md5(d) AS document_md5, md5(substr(d, w * 2000 + 1, 2000)) AS model_input_md5, sec AS ingested_timestamp,
       CASE WHEN doc_id % 4 <> 0 THEN sec - 60 ELSE sec END AS published_timestamp, source, sentiment_score AS sentiment
FROM (SELECT *, unnest(range(greatest(1, (length(d) + 1999) // 2000))) AS w FROM (SELECT *, 'Article ' || link || ' | ' || title AS d FROM articles))""", v.ARTICLES))
def doc_sentences(spark, sf):
    """Every article as the windows to embed: id, window, text, times, source, sentiment."""
    rows = plan.embed_documents(_articles(spark, sf), "news")
    return rows.select("id", "window", "document_md5", F.md5("model_input").alias("model_input_md5"), "ingested_timestamp",
                       "published_timestamp", "source", "sentiment")


@query("embedding_sync", with_ctes("""
SELECT 'news_' || link AS id, w AS "window", md5(d) AS document_md5, md5(substr(d, w * 2000 + 1, 2000)) AS model_input_md5
FROM (SELECT *, unnest(range(greatest(1, (length(d) + 1999) // 2000))) AS w FROM (SELECT link, 'Article ' || link || ' | ' || title AS d FROM articles))""", v.ARTICLES))
def embedding_sync(spark, sf):
    """The store of windows after two runs in three batches each: first with half of the texts longer than they are now, then as they are."""
    path = shared_folder(spark, "embedding-store")
    rows = _articles(spark, sf)
    size = rows.agg(F.ceil(F.count("*") / 3)).first()[0]
    longer = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", *["full_text"] * 3)).otherwise(F.col("full_text"))
    for feed in (rows.withColumn("full_text", longer), rows):
        plan.sync_embeddings(spark, feed, "news", path, size)
    return tables.read_buckets(spark, path, select=["id", "window", "document_md5", F.md5("model_input").alias("model_input_md5")])
