"""Sentiment of a text by a word list and the published rules of position: negation, degree words, capitals, contrast and marks.

A text is its stretches without white space, with signs at their ends taken off (stretches that would keep at most two characters stay
whole). Each word of the list has a valence. In the order of the rules: capitals in a text that isn't all capitals raise it; each of the
three words before it, unless it has a valence of its own, raises or lowers it if it is a degree word (less with distance) and turns and
dampens it if it denies; "least" before it denies too. Words before the first contrast word count half, those behind it one and a half
times. Exclamation and question marks push the sum further from zero, and the sum s becomes s / sqrt(s^2 + 15).

Only words of the list leave their text: what the three words before a word say goes with it as numbers, and which of them have a valence is
told by a window over the list's words of a text. Valences are summed in millionths, so the result doesn't depend on the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloft.functions import fixed_values as fv
from sigloft.functions.text import sentiment_label

SPACES = "[ \\t\\n\\f\\r]+"


def in_capitals(word: Column) -> Column:
    return word.rlike("[A-Z]") & ~word.rlike("[a-zß-ÿ]")


def marks(text: Column) -> Column:
    """What exclamation and question marks add to the sum."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    asked = count("?")
    return F.least(count("!"), F.lit(4)) * fv.EXCLAMATION + F.when(asked > 3, fv.MANY_QUESTIONS).when(asked > 1, asked * fv.QUESTION).otherwise(0.0)


def _any(*flags: Column) -> Column:
    return reduce(or_, flags)


#: What a word says wherever it stands, as bits: it raises, lowers, denies, is in capitals in a text that isn't all capitals, and the words
#: of the special rules.
RAISES, LOWERS, DENIES, LOUD, NEVER, NEARER, WITHOUT, DOUBT, LEAST, MOST = (1 << i for i in range(10))
_SPECIAL = {NEVER: ("never",), NEARER: ("so", "this"), WITHOUT: ("without",), DOUBT: ("doubt",), LEAST: ("least",), MOST: ("at", "very")}


def _words(texts: DataFrame, row_id: str, text: str, negations: Sequence[str], degrees: Mapping[str, float], contrast: str) -> DataFrame:
    """``_id``, and of each text its words in lower case, their bits and the place of the first contrast word."""
    known = {RAISES: [w for w, x in degrees.items() if x > 0], LOWERS: [w for w, x in degrees.items() if x < 0], DENIES: list(negations)} | _SPECIAL
    bit = lambda flag, value: F.when(flag, F.lit(value)).otherwise(F.lit(0))
    bare = lambda x: F.trim(x, F.lit(fv.SIGNS))
    # White space at the ends goes first, so only an empty text has an empty stretch, which is no word of a list. Each array is made once.
    found = texts.select(F.col(row_id).alias("_id"), F.split(F.trim(F.col(text), F.lit(" \t\n\f\r")), SPACES).alias("_parts"))
    found = found.withColumn("_written", F.transform(F.transform("_parts", bare), lambda x, i: F.when(F.length(x) <= 2, F.get("_parts", i)).otherwise(x)))
    found = found.withColumn("_lower", F.transform("_written", F.lower))
    found = found.withColumn("_capitals", F.transform("_written", lambda x, i: (x != F.get("_lower", i)) & in_capitals(x)))
    found = found.withColumn("_emphasis", F.array_contains("_capitals", True) & F.array_contains("_capitals", False))

    def bits(word: Column, i: Column) -> Column:
        said = reduce(lambda x, y: x + y, (bit(word.isin(*words), value) for value, words in known.items() if value != DENIES))
        said = said + bit(word.isin(*known[DENIES]) | word.contains("n't"), DENIES)
        named = word.isin(*{w for words in known.values() for w in words}) | word.contains("n't")
        return F.when(named, said).otherwise(F.lit(0)) + bit(F.col("_emphasis") & F.get("_capitals", i), LOUD)

    return found.select("_id", "_lower", F.transform("_lower", bits).alias("_bits"), (F.nullif(F.array_position("_lower", contrast), F.lit(0)) - 1).alias("_turn"))


def _has(k: int, value: int) -> Column:
    """Whether the word ``k`` places before says so; there may be none."""
    return F.coalesce(F.col(f"_b{k}").bitwiseAND(F.lit(value)) != 0, F.lit(False))


def _shifted(old: Column, k: int, known: Column) -> Column:
    """The valence after the word ``k`` places before it; ``known``: that word has a valence itself."""
    degree = F.when(_has(k, RAISES), fv.MORE).when(_has(k, LOWERS), fv.LESS)
    loud = F.when(_has(k, LOUD), F.when(old > 0, fv.CAPITALS).otherwise(-fv.CAPITALS)).otherwise(0.0)
    step = old + F.coalesce((F.when(old < 0, -degree).otherwise(degree) + loud) * fv.DISTANCE[k - 1], F.lit(0.0))
    turned = F.when(F.col(f"_b{k}").isNull() | known, old)
    if k > 1:  # "never so good" and "without doubt good" keep their direction
        turned = turned.when(_has(k, NEVER) & _any(*(_has(j, NEARER) for j in range(1, k))), step * fv.NEVER_SO)
        turned = turned.when(_has(k, WITHOUT) & _any(*(_has(j, DOUBT) for j in range(1, k))), step)
    return turned.when(_has(k, DENIES), step * fv.DENIAL).otherwise(step)


def sentence_sentiment(texts: DataFrame, row_id: str, text: str, lexicon: DataFrame, negations: Sequence[str] = fv.NEGATIONS,
                       degrees: Mapping[str, float] = fv.DEGREES, contrast: str = "but") -> DataFrame:
    """``row_id, sentiment_score, sentiment_label`` of every text, whose ``row_id`` is its own. ``lexicon``: word (lower case), valence, one row
    per word. ``degrees``: above zero for words that raise, below for those that lower.

    Null texts and texts without a word of the list score 0.
    """
    words = _words(texts, row_id, text, negations, degrees, contrast)
    placed = words.select("*", F.posexplode_outer("_lower").alias("_at", "word")).where("word <> ''")
    # What the words before say is looked up before rows meet the list, so only numbers travel.
    weight = F.when(F.col("_at") < F.col("_turn"), 0.5).when(F.col("_at") > F.col("_turn"), 1.5).otherwise(1.0)
    placed = placed.select("_id", "_at", "word", weight.alias("_weight"), *(F.get("_bits", F.col("_at") - k).alias(f"_b{k}") for k in range(4)))
    raised = F.col("valence") + F.when(F.col("valence") > 0, fv.CAPITALS).otherwise(-fv.CAPITALS)
    met = placed.join(lexicon, "word").withColumn("_v", F.when(_has(0, LOUD), raised).otherwise(F.col("valence"))).drop("word", "valence", "_b0")
    own = Window.partitionBy("_id").orderBy("_at")
    met = met.withColumns({f"_p{k}": F.lag("_at", k).over(own) for k in (1, 2, 3)})
    met = met.withColumns({f"_k{k}": _any(*(F.coalesce(F.col(f"_p{j}") == F.col("_at") - k, F.lit(False)) for j in (1, 2, 3))) for k in (1, 2, 3)})
    for k in (1, 2, 3):
        met = met.withColumn("_v", _shifted(F.col("_v"), k, F.col(f"_k{k}")))
    least = _has(1, LEAST) & ~F.col("_k1") & ~_has(2, MOST)
    shifted = met.withColumn("_v", F.when(least, F.col("_v") * fv.DENIAL).otherwise(F.col("_v")))
    sums = shifted.groupBy("_id").agg(F.sum(F.floor(F.col("_v") * F.col("_weight") * 1e6 + 0.5)).alias("_sum"))
    total = texts.select(F.col(row_id).alias("_id"), marks(F.coalesce(F.col(text), F.lit(""))).alias("_marks")).join(sums, "_id", "left")
    s = F.coalesce("_sum", F.lit(0)) / 1e6
    s = F.when(s > 0, s + F.col("_marks")).when(s < 0, s - F.col("_marks")).otherwise(0.0)
    scored = total.select(F.col("_id").alias(row_id), s.alias("_s")).withColumn("sentiment_score", F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15.0))
    return scored.select(row_id, "sentiment_score", sentiment_label(F.col("sentiment_score")).alias("sentiment_label"))
