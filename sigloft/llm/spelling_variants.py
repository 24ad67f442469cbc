"""Spelling variants of the words of a corpus, found by asymmetric chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The shorter word of a pair (either, if they
are equally long) gives two disjoint chunks of half its length, its first and its last letters; the other gives the positional grams of
that size. One edit leaves one of the chunks whole, and it then stands in the other word at its place or one further on, so an equi-join
of chunks with the grams shifted by at most one finds every near pair. What is left of both words without the chunk and the gram is at
most one edit apart too, so its first or its last half is whole as well: that half is part of the join key, and a chunk that very many
words share (a common ending) is split by it on both sides. What meets is verified by the exact edit distance.

All steps are DataFrame functions. Words are counted before anything is joined, on the map side first, so a word that makes up a third
of a corpus is one row; the join's rows are 12 and 4 for each distinct word. A pair that meets by several keys is one pair. No join
sends a table through the driver: all of them grow with the distinct words.

Null texts have no words; a null id counts as an empty string where letters are dropped. Repeated rows count again. Texts of any length
are taken whole. Ties between equally frequent neighbours go to the smallest word in code-point order. Empty tables give empty results,
and only the named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text
from sigloft.session import stored

#: Fixed value: what counts as a run of letters.
LETTERS = "[A-Za-zÀ-ÿ]+"


def _merged(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join by sorting both sides, also where Spark would broadcast one.

    Spark sizes a stored table by its compressed files, and rows exploded from it as if they were no more than the table's, so what it
    takes for small may be over a hundred times that in the driver's memory.
    """
    return left.join(right.hint("merge"), key, how)


def damaged_words(docs: DataFrame, every: int | None = 199, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``word`` for each run of letters that has ``least`` code points or more, with A-Z lower-cased.

    Where ``every`` divides the CRC-32 of "id:run", one letter of the run is dropped, at the place that the CRC-32 names; None drops
    nothing.
    """
    runs = id_and_text(docs, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 0)).alias("run"))
    lower = runs.where(F.length("run") >= least).withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    if every is None:
        return lower.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, dropped).otherwise(F.col("run"))
    return lower.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least)


def counted(words: DataFrame, least: int = 6, most_rare: int = 5) -> DataFrame:
    """``word, n`` for the words of ``least`` code points or more that stand at least ``most_rare`` times."""
    found = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= most_rare)


def _cut(word: Column, place: Column, size: Column) -> tuple[Column, Column]:
    """The gram at a place counted from 0, and the word without it."""
    gram = F.substring(word, place + 1, size)
    return gram, F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + size + 1, F.length(word)))


def _keys(size: Column, shifts: tuple[int, ...]) -> list[Column]:
    """The join keys of a word as partner of one of ``size`` code points: chunk number, gram, kept half of the rest."""
    word, q = F.col("word"), F.floor(size / 2).cast("int")
    half = F.floor((size - q) / 2).cast("int")
    keys = []
    for number, start in enumerate((F.lit(0), size - q)):
        for shift in shifts:
            gram, rest = _cut(word, start + shift, q)
            front, back = F.substring(rest, F.lit(1), half), F.substring(rest, F.length(rest) - half + 1, half)
            keys += [F.xxhash64(size, F.lit(number), gram, F.lit(side), part) for side, part in enumerate((front, back))]
    return keys


def near_pairs(words: DataFrame, least: int = 6) -> DataFrame:
    """``a, b, n_a, n_b``: each pair of words one edit apart, once; a is the shorter one, or the smaller of equally long ones.

    ``words``: word, n; a word once; of ``least`` code points or more, which must be at least 4 so that no chunk is empty.
    """
    if least < 4:
        raise ValueError("words need at least four code points for two chunks and two halves")
    words = words.where(F.length("word") >= least)
    size = F.length("word")
    chunks = words.select(F.explode(F.array(*_keys(size, (0,)))).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = F.concat(F.array(*_keys(size, (0,))), F.when(size > least, F.array(*_keys(size - 1, (0, 1)))).otherwise(F.array().cast("array<bigint>")))
    grams = words.select(F.explode(F.array_distinct(grams)).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = _merged(chunks, grams, "key").where(ordered & (F.length("a") <= F.length("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def roots_of(links: DataFrame) -> DataFrame:
    """``word, root``: each word's last one along ``links`` (word, form; a word once, no cycles), by doubling the steps."""
    roots = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = _merged(roots, onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = 5, least: int = 6) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (word, n).

    form: the near word of largest n, if that is at least ``ratio`` times the word's, else null, with form_n its n; root: the last form
    reached from the word, itself if it has none; n_near: the number of near words.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants, or they could form cycles")
    words = stored(words, "words")
    pairs = near_pairs(words, least)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    near = pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best")
    )
    most = -F.col("best.m")
    formed = _merged(words, near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(most >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), most.alias("form_n"))).alias("f"),
    )
    formed = stored(formed.select("word", "f.form", "n", "n_near", "f.form_n"), "forms")
    roots = roots_of(formed.where("form IS NOT NULL"))
    return _merged(formed, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
