"""An inverted-file index of vectors: lists around learnt centroids, probing, exact re-ranking.

Centroids are learnt by k-means on a bounded sample; every vector is then filed under its nearest centroid, and the index is a Parquet
folder with one partition per list. A query meets only the lists of its nearest centroids, in blocks, and what it meets is ranked by the exact
distance. How far a list reaches from its centroid is kept beside it. By the triangle inequality of angles this tells which other lists
could still hold a nearer document than the k-th found so far: with ``complete`` those are searched too, and the result is the exact one.

The number of lists should grow with the square root of the table; a probe then costs a query lists + probes x rows / lists rows. What goes
to every task are the centroids, whose number is bounded by MOST_LISTS.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.operators.keyed import top_per_key
from sigloft.operators.vectors import nearest_documents, nearest_in_buckets

#: Vectors that k-means sees for each list, and the most lists there may be.
SAMPLE, MOST_LISTS = 256, 16_384
#: Room for rounding when angles are compared.
SLACK = 1e-4


def unit(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length 1 (zero vectors stay zero)."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def learnt_centroids(vectors: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of length 1, one for each list, learnt from at most about SAMPLE vectors a list that are chosen by the hash of their id."""
    if not 1 <= lists <= MOST_LISTS:
        raise ValueError(f"between 1 and {MOST_LISTS} lists")
    share = min(1.0, SAMPLE * lists / max(vectors.count(), 1))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sample = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).where(norm > 0)
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="v").fit(
        sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("v")))
    return unit(pd.Series(list(model.clusterCenters())))


@dataclass(frozen=True)
class VectorIndex:
    """Where the lists are, their centroids, and how far (as an angle) each reaches."""

    path: str
    centroids: np.ndarray
    reach: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def build_index(vectors: DataFrame, lists: int, path: str) -> VectorIndex:
    """Files ``vectors`` (collection, doc_id, doc_time, vector), all of them, under ``path``; rows without a vector have no distance and stay out."""
    vectors = vectors.where("vector IS NOT NULL")
    centroids = learnt_centroids(vectors, lists)

    @F.pandas_udf("list int, angle double")
    def filed(batch: pd.Series) -> pd.DataFrame:
        near = unit(batch) @ centroids.T
        best = near.argmax(axis=1)
        return pd.DataFrame({"list": best.astype(np.int32), "angle": np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))})

    rows = vectors.withColumn("_f", filed("vector")).select("collection", "doc_id", "doc_time", "vector", "_f.angle", "_f.list")
    rows.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(path)
    reach = np.full(len(centroids), -np.inf)
    for row in vectors.sparkSession.read.parquet(path).groupBy("list").agg(F.max("angle").alias("angle")).toLocalIterator():
        reach[row["list"]] = row["angle"]
    return VectorIndex(path, centroids, reach)


def _met(index: VectorIndex, asks: DataFrame, spark: SparkSession, k: int, window: int | None) -> DataFrame:
    """Queries with their lists against the rows of those lists; only the partitions of lists that are asked for are read."""
    wanted = [r[0] for r in asks.select(F.col("_bucket").cast("int")).distinct().collect()]  # at most one for each list
    rows = index.rows(spark).where(F.col("list").isin(wanted) if wanted else F.lit(False))
    docs = rows.select("collection", "doc_id", "doc_time", "vector", F.col("list").cast("bigint").alias("_bucket"))
    return nearest_in_buckets(asks, docs, k, window)


def probed_lists(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """The queries (query_id, as_of, vector), each once for every list of its ``probes`` nearest centroids, as ``_bucket``."""
    centroids = index.centroids

    @F.pandas_udf("array<bigint>")
    def nearest(batch: pd.Series) -> pd.Series:
        order = np.argsort(-(unit(batch) @ centroids.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype(np.int64)))

    return queries.withColumn("_bucket", F.explode(nearest("vector")))


def remaining_lists(index: VectorIndex, queries: DataFrame, found: DataFrame, probes: int, k: int, collections: int) -> DataFrame:
    """The queries for every list behind the first ``probes`` that may hold a document nearer than (or as near as) their k-th one.

    The k-th of the collection that is worst off counts; a query with fewer than k in a collection asks all lists.
    """
    centroids, reach = index.centroids, index.reach
    worst = found.groupBy("query_id", "collection").agg(F.count("*").alias("n"), F.max("distance").alias("d")).groupBy("query_id").agg(
        F.count_if(F.col("n") >= k).alias("full"), F.max("d").alias("d"))
    bound = F.when(F.col("full") >= collections, F.col("d")).otherwise(F.lit(2.0))

    @F.pandas_udf("array<bigint>")
    def open_lists(batch: pd.Series, distance: pd.Series) -> pd.Series:
        near = unit(batch) @ centroids.T
        order = np.argsort(-near, axis=1, kind="stable")[:, probes:]
        apart = np.arccos(np.clip(np.take_along_axis(near, order, axis=1), -1, 1)) - reach[order]
        limit = np.arccos(np.clip(1 - distance.to_numpy(), -1, 1))[:, None] + SLACK
        return pd.Series([row[keep].astype(np.int64) for row, keep in zip(order, apart <= limit)])

    asked = queries.join(worst.select("query_id", bound.alias("_d")), "query_id", "left").withColumn("_d", F.coalesce("_d", F.lit(2.0)))
    return asked.withColumn("_bucket", F.explode(open_lists("vector", "_d"))).drop("_d")


def calibrated_probes(index: VectorIndex, queries: DataFrame, k: int, recall: float, window: int | None = None) -> int:
    """The least number of probes at which the lists of these queries hold the wanted share of their exact k nearest documents.

    How much that is of the index depends on how far the vectors gather: measure it on some queries before choosing between the index and the
    full comparison. The queries (a bounded, stated set) are compared with all rows once.
    """
    centroids = index.centroids

    @F.pandas_udf("int")
    def place(vectors: pd.Series, lists: pd.Series) -> pd.Series:
        order = np.argsort(-(unit(vectors) @ centroids.T), axis=1, kind="stable")
        return pd.Series((order == lists.to_numpy()[:, None]).argmax(axis=1).astype(np.int32))

    rows = index.rows(queries.sparkSession)
    near = nearest_documents(queries, rows.select("collection", "doc_id", "doc_time", "vector"), k, window)
    placed = near.select("query_id", "collection", "doc_id").join(rows.select("collection", "doc_id", "list"), ["collection", "doc_id"])
    found = placed.join(queries.select("query_id", "vector"), "query_id").groupBy(place("vector", "list").alias("place")).count().orderBy("place").collect()
    total, met = sum(r["count"] for r in found), 0
    for r in found:  # at most one for each list
        met += r["count"]
        if met >= recall * total:
            return r["place"] + 1
    return len(centroids)


def indexed_nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int, window: int | None = None, complete: bool = False) -> DataFrame:
    """Top-k documents per (query, collection) as :func:`sigloft.operators.vectors.nearest_documents`, from the lists of the ``probes``
    nearest centroids; with ``complete`` from all lists that may hold one of them, which makes the result exact."""
    spark = queries.sparkSession
    found = _met(index, probed_lists(index, queries, probes), spark, k, window)
    if complete:
        collections = index.rows(spark).select("collection").distinct().count()
        more = remaining_lists(index, queries, found, probes, k, collections)
        found = found.unionByName(_met(index, more, spark, k, window))
    return top_per_key(found, ["query_id", "collection"], [F.col("distance"), F.col("doc_id")], k)
