"""Document fingerprints by SimHash, and the search for fingerprints within a Hamming radius.

The terms of a text are its lower-cased three-word shingles, weighted by their damped number. Each term's 128-bit hash votes on the
signed bits with its weight. The likeness of two fingerprints is the cosine that their differing bits stand for, 0 at least.

The search lays each fingerprint into six permuted block tables. The two halves have three blocks each; at three or fewer differing bits
one half has at most one of them, so two of its blocks agree: every table leads with two blocks of a half, and fingerprints that meet
there are compared in whole.

Null texts are empty; a text of one or two words is one term; texts without a word have fingerprint zero, like one another at 1. The
order of documents for neighbours is by id, then by the text's hash; null ids come first. Repeated rows are documents of their own. One
row is its own next document; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text
from sigloft.llm.simhash_dedup import bit_votes
from sigloft.session import stored

BITS = 128
SHINGLE = 3
RADIUS = 3
CHUNK = 1 << 16
#: The blocks of a half, as (lowest bit, number of bits).
BLOCKS = ((0, 22), (22, 21), (43, 21))
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(text: str) -> int:
    words = text.lower().encode().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        terms = Counter([b" ".join(words)])
    else:
        terms = Counter(b" ".join(t) for t in zip(words, words[1:], words[2:]))
    by_number: dict[int, list[bytes]] = {}
    for term, n in terms.items():
        by_number.setdefault(n, []).append(term)
    votes = np.zeros(BITS)
    for n, group in sorted(by_number.items()):
        for i in range(0, len(group), CHUNK):
            hashes = b"".join(map(xxhash.xxh3_128_digest, group[i : i + CHUNK]))
            part = np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8)
            votes += (1 + math.log(n)) * (2 * bit_votes(part) - len(part))
    return int.from_bytes(np.packbits(votes > 1e-9).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    """The cosine of the angle that the share of differing bits stands for; 0 for a right angle or more."""
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / BITS))


def hexadecimal(value: int) -> str:
    return f"{value:0{BITS // 4}x}"


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(doc_id, text: str, of: int, following: str, of_next: int) -> tuple:
    new = edited(text, following)
    of_new = fingerprint(new)
    digest = hashlib.sha256(new.encode()).hexdigest()
    return doc_id, len(text), digest, hexadecimal(of), hexadecimal(of_new), likeness(of, of_new), likeness(of, of_next)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of one range in order: each is compared with the next; the first and last go on to meet those of other ranges."""
    held, part = None, TaskContext.get().partitionId()
    names = [c.split()[0] for c in ROW.split(", ")] + ["part", "edge", "text"]
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            of = fingerprint(text)
            if held is None:
                out.append((doc_id, *[None] * 6, part, "first", text))
            else:
                out.append((*_compared(*held, text, of), part, None, None))
            held = (doc_id, text, of)
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})
    if held is not None:
        yield pd.DataFrame([(held[0], *[None] * 6, part, "last", held[1])], columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [
            _compared(None if pd.isna(i) else int(i), text, fingerprint(text), following, fingerprint(following))
            for i, text, following in zip(batch["doc_id"], batch["text"], batch["following"])
        ]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")]).astype({"doc_id": "Int64"})


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW for every document: its fingerprint, that of its edited text, and their and the next document's likeness."""
    spark = docs.sparkSession
    # With the hash in the ranges, many rows of one id, or without one, spread over tasks.
    order = F.col("doc_id"), F.xxhash64("text")
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    done = stored(ordered.mapInPandas(_rows, ROW + ", part int, edge string, text string"), "fingerprint-ranges")
    # One row for each range: which range comes next, the first after the last.
    parts = sorted(r.part for r in done.filter("edge = 'first'").select("part").collect())
    after = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next int")
    firsts = done.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = done.filter("edge = 'last'").select("doc_id", "text", "part").join(after, "part").join(firsts, "next")
    names = [c.split()[0] for c in ROW.split(", ")]
    return done.filter("edge IS NULL").select(*names).unionByName(lasts.select("doc_id", "text", "following").mapInPandas(_edges, ROW))


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fingerprint, other, distance`` for all pairs of distinct fingerprints (hexadecimal) within ``radius``, each once."""
    if radius > 3:
        raise ValueError("two blocks of a half are sure to agree up to distance 3")
    half = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long")
    whole = prints.select("fingerprint").distinct().select("fingerprint", half(1).alias("high"), half(17).alias("low"))
    masks = [~(((1 << n) - 1) << at) & (2**64 - 1) for at, n in BLOCKS]
    signed = [m - 2**64 if m >> 63 else m for m in masks]
    tables = F.array(*[
        F.struct(F.lit(3 * h + i).alias("table"), F.col(side).bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for h, side in enumerate(("high", "low")) for i, m in enumerate(signed)
    ])
    laid = whole.select("fingerprint", "high", "low", F.explode(tables).alias("t")).select("fingerprint", "high", "low", "t.table", "t.key")
    a, b = laid.alias("a"), laid.alias("b")
    high, low = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("high", "low"))
    distance = F.bit_count(high) + F.bit_count(low)
    # A pair meets in every table whose leading blocks agree; it counts in the first of them.
    agree = [(high if h == 0 else low).bitwiseAND(F.lit(m).cast("long")) == 0 for h in range(2) for m in signed]
    first = F.coalesce(*[F.when(x, F.lit(i)) for i, x in enumerate(agree)])
    met = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fingerprint") < F.col("b.fingerprint")) & (distance <= radius) & (first == F.col("a.table")))
    return met.select(F.col("a.fingerprint").alias("fingerprint"), F.col("b.fingerprint").alias("other"), distance.alias("distance"))


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fingerprint, n_near``: how many other distinct fingerprints lie within the radius; only those that have any."""
    pairs = near_pairs(prints, radius)
    both = pairs.select("fingerprint").unionByName(pairs.select(F.col("other").alias("fingerprint")))
    return both.groupBy("fingerprint").agg(F.count("*").alias("n_near"))
