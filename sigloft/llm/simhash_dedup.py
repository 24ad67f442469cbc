"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits, cut into two segments of 32. Two fingerprints at three or fewer differing bits differ by at most one bit
in one of the segments, so every fingerprint looks up the 33 values of the ball of radius 1 around each of its segments in a table
of segment values; the complete distance decides. Equal fingerprints are one class before any lookup, so a large group of copies
costs one row. Links are between classes; components of links are then joined back to the documents.

Null texts are empty texts. Texts without a word have fingerprint zero and are linked like any other. Rows with a null id keep their
fingerprint and take part in no component of others: their component is that of the smallest id of their class, null if there is none.
Repeated ids give one row each. Empty tables give empty results. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sigloft.llm.common import id_and_text
from sigloft.llm.components import components
from sigloft.session import stored

SEED = 42
SHINGLE = 3
RADIUS = 3
CHUNK = 1 << 16
BALL = [0, *(1 << i for i in range(32))]
#: A byte's eight bits, the highest first, each in a byte of its own: up to 255 such numbers add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes, one row of bytes each, have each bit set; the highest bit of the first byte comes first."""
    n, width = hashes.shape
    padded = np.zeros((width, -(-n // 255) * 255), np.uint64)
    padded[:, :n] = LANES[hashes.T]
    sums = padded.reshape(width, -1, 255).sum(axis=2)
    return sums.view(np.uint8).reshape(width, -1, 8).sum(axis=1, dtype=np.int64).ravel()


def simhash64(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number: bit i is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    of = xxhash.xxh64_digest
    votes = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = b"".join([of(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK])])
        votes += bit_votes(np.frombuffer(part, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = np.fromiter(map(simhash64, batch), np.uint64, len(batch))
        yield pd.Series(found.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed number."""
    return id_and_text(docs, id_col, text_col).select("doc_id", _fingerprints("text").alias("fp"))


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, other``: each pair of distinct fingerprints at ``radius`` or fewer differing bits, once."""
    if radius > 3:
        raise ValueError("balls of radius 1 around two segments find distances up to 3")
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.array(F.struct(F.lit(0).alias("segment"), high.alias("value")), F.struct(F.lit(1).alias("segment"), low.alias("value")))
    entries = classes.select("fp", F.explode(segments).alias("s")).select("fp", "s.segment", "s.value")
    ball = F.array(*[F.lit(x).cast("long") for x in BALL])
    probes = entries.select("fp", "segment", F.explode(F.transform(ball, lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
    p, e = probes.alias("p"), entries.alias("e")
    differing = F.col("p.fp").bitwiseXOR(F.col("e.fp"))
    first = F.bit_count(F.shiftrightunsigned(differing, 32))
    return p.join(
        e,
        (F.col("p.segment") == F.col("e.segment")) & (F.col("p.value") == F.col("e.value")) & (F.col("p.fp") < F.col("e.fp"))
        & (F.bit_count(differing) <= radius) & ((F.col("p.segment") == 0) | (first > 1)),
    ).select(F.col("p.fp").alias("fp"), F.col("e.fp").alias("other"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component is the smallest id reachable over links."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    grouped = components(links(classes.select("fp")), "fp", "other")
    named = classes.join(grouped, classes.fp == grouped.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, those with its smallest id. Rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
