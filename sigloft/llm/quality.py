"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words and runs of signs are hashed into VOCABULARY rows. Every row has a fixed sparse index vector of a few signed entries; a row's context
vector is the sum of the index vectors that stand beside it anywhere in the corpus, learnt in one pass over all documents. Each task sums
into a table of fixed size; tables are added up by blocks of rows, so no task holds more than its share of all of them. A document's
features are the mean of its words' vectors and the mean agreement of neighbours. A network with one hidden layer is fitted on a bounded
sample: at most TRAINING labelled rows, the first by hash of the id. Part of them sets the temperature that makes the
probabilities honest.

Null and empty texts have no features and get the score of an average document. Rows with a null id are scored; without any usable label (or only one
value of it) every score is the share of label 1, or 0.5. Rows of labels with a null or that name no document are not used; of repeated
labels of a document each counts. Repeated rows give one row each, empty tables none. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import below, id_and_text
from sigloft.session import stored

VOCABULARY, DIMENSIONS, ENTRIES = 1 << 14, 48, 4
HIDDEN, TRAINING, CALIBRATION, EPOCHS, SEED = 32, 20_000, 0.2, 60, 7
#: Means of three kinds and a number; means over few tokens are drawn towards the average by so many tokens.
FEATURES, DRAWN = 3 * DIMENSIONS + 1, 16
#: Rows of the table that one message of a task to the next step carries.
BLOCK = 1 << 11
#: Tokens that are worked on at once.
CHUNK = 1 << 18
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str) -> np.ndarray:
    """Each word or run of signs as the number of its row."""
    words = TOKEN.findall(text)
    found = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint32, len(words))
    return (found % VOCABULARY).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the entries of each row's index vector."""
    random = np.random.default_rng(SEED)
    places = np.argsort(random.random((VOCABULARY, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places, random.choice(np.array([-1.0, 1.0]), (VOCABULARY, ENTRIES))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    places, signs = index_vectors()
    total = np.zeros(VOCABULARY * DIMENSIONS)

    def add(word: np.ndarray, beside: np.ndarray) -> None:
        for e in range(ENTRIES):
            at = word * DIMENSIONS + places[beside, e]
            total[:] += np.bincount(at, weights=signs[beside, e], minlength=total.size)

    waiting: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal waiting, size
        joined = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
        for i in range(0, len(joined), CHUNK):
            a, b = joined[i : i + CHUNK], joined[i + 1 : i + 1 + CHUNK]
            a = a[: len(b)]
            both = (a >= 0) & (b >= 0)
            add(a[both], b[both])
            add(b[both], a[both])
        waiting, size = [], 0

    for batch in batches:
        for text in batch["text"]:
            found = tokens(text)
            waiting += [found, np.array([-1])]
            size += len(found) + 1
            if size >= CHUNK:
                flush()
    flush()
    table = total.reshape(VOCABULARY, DIMENSIONS)
    part = TaskContext.get().partitionId()
    yield pd.DataFrame([(i // BLOCK, part, table[i : i + BLOCK].astype(np.float64).tobytes()) for i in range(0, VOCABULARY, BLOCK)], columns=["block", "part", "sums"])


def _added(keys: list[str]):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(zip(*(batch[k] for k in keys)), batch["sums"]):
                values = np.frombuffer(raw, np.float64)
                sums[key] = sums[key] + values if key in sums else values.copy()
        yield pd.DataFrame([(*(int(k) for k in key), v.tobytes()) for key, v in sorted(sums.items())], columns=[*keys, "sums"])

    return add


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The vectors of all rows: their context over the whole table, at length 1; rows that no document has are zero.

    Every task's table has the same fixed size. The tables meet in two steps, groups of 64 tasks first, so the work of one task stays small.
    """
    parts = id_and_text(docs, text_col, text_col).select("text").mapInPandas(_contexts, "block int, part int, sums binary")
    groups = parts.withColumn("group", F.floor(F.col("part") / 64).cast("int"))
    some = groups.repartition("block", "group").mapInPandas(_added(["block", "group"]), "block int, group int, sums binary")
    whole = some.repartition("block").mapInPandas(_added(["block"]), "block int, sums binary").collect()
    table = np.zeros((VOCABULARY, DIMENSIONS))
    for r in whole:
        table[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.float64).reshape(-1, DIMENSIONS)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, size, out=np.zeros_like(table), where=size > 0).astype(np.float32)


def pool(found: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A document's features from its tokens: means of their context and index vectors and of the agreement of neighbours, and the
    number of tokens."""
    if not len(found):
        return np.zeros(FEATURES, np.float32)
    sums = np.zeros(3 * DIMENSIONS)
    for i in range(0, len(found), CHUNK):
        a, b = found[i : i + CHUNK], found[i + 1 : i + 1 + CHUNK]
        mine = own[a]
        sums[:DIMENSIONS] += vectors[a].sum(axis=0)
        sums[DIMENSIONS : 2 * DIMENSIONS] += mine.sum(axis=0)
        sums[2 * DIMENSIONS :] += (mine[: len(b)] * own[b]).sum(axis=0)
    return np.append(sums / len(found), len(found)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features``: every document's features as packed 32-bit numbers. The vectors sent to the tasks have a fixed size."""

    @F.pandas_udf("binary")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, signs = index_vectors()
        own = np.zeros((VOCABULARY, DIMENSIONS), np.float32)
        np.put_along_axis(own, places, (signs / np.sqrt(ENTRIES)).astype(np.float32), axis=1)
        for batch in texts:
            yield batch.map(lambda t: pool(tokens(t), vectors, own).tobytes())

    return id_and_text(docs, id_col, text_col).select("doc_id", features("text").alias("features"))


class Network:
    """A two-layer network: scaled features, a hidden layer, one probability. The last feature is the number of tokens."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        random = np.random.default_rng(SEED)
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = bool(len(y)) and 0 < self.share < 1
        if not self.fitted:
            return
        order = random.permutation(len(y))
        held = order[: int(len(y) * CALIBRATION)]
        fit = order[len(held) :]
        if not 0 < y[fit].mean() < 1:
            held, fit = order[:0], order
        self.middle, self.scale = x[fit, :-1].mean(axis=0), x[fit, :-1].std(axis=0) + 1e-6
        z = self.scaled(x)
        self.w = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1] - 1, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._train(z[fit], y[fit], random)
        if len(held):
            logits = self.logits(z[held])
            temperatures = np.geomspace(0.25, 8, 101)
            loss = [np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t).mean() for t in temperatures]
            self.temperature = float(temperatures[int(np.argmin(loss))])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x[:, :-1] - self.middle) / self.scale, -8, 8) * (x[:, -1:] / (x[:, -1:] + DRAWN))

    def logits(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def _train(self, z: np.ndarray, y: np.ndarray, random: np.random.Generator, rate: float = 3e-3, decay: float = 1e-4, size: int = 256) -> None:
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for i in range(0, len(y), size):
                at = order[i : i + size]
                w1, b1, w2, b2 = self.w
                hidden = np.tanh(z[at] @ w1 + b1)
                error = (1 / (1 + np.exp(-(hidden @ w2 + b2[0]))) - y[at]) / len(at)
                back = np.outer(error, w2) * (1 - hidden**2)
                slopes = [z[at].T @ back + decay * w1, back.sum(axis=0), hidden.T @ error + decay * w2, np.array([error.sum()])]
                step += 1
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-self.logits(self.scaled(x)) / self.temperature))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no label is learnt from; null ids belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    features = stored(pooled(docs, word_vectors(docs, text_col), id_col, text_col), "features")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    # Labels of documents that are not given don't count towards the bound.
    known = stored(known.join(features.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    # A little over the sample passes by its hash, so that few rows meet where the first are chosen.
    known = known.filter(below(F.col("h"), TRAINING + TRAINING // 4, known.count()))
    sample = features.join(known, "doc_id").orderBy("h", "doc_id", "label", "features").limit(TRAINING).select("features", "label").collect()
    x = np.frombuffer(b"".join(bytes(r.features) for r in sample), np.float32).reshape(-1, FEATURES)
    network = Network(x.astype(np.float64), np.array([r.label > 0 for r in sample], np.float64))

    @F.pandas_udf("double")
    def score(packed: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(packed), np.float32).reshape(-1, FEATURES)
        return pd.Series(network.probability(rows.astype(np.float64)))

    out = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject. Rows with a null id stay; rows of one id share its lowest verdict."""
    bad = scored(docs, labels, id_col, text_col).filter("predicted = 0").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
