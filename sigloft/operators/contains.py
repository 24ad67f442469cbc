"""Substring join: which of many names occur inside which texts, without comparing every text with every name.

Every name has a seed (its first characters). The seeds at all positions of a text are looked up first, as short rows without the text;
where one is known, and only there, the pieces of the lengths that names with this seed have are cut out of the text and looked up among
the names. The work grows with the text length and the number of seeds met, whatever the longest name. Both lookups are against
rows that are unique per seed or name, so a very frequent seed only enlarges the probe side, which AQE can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 4


def contains_join(texts: DataFrame, text_key: Sequence[str], text: str, names: DataFrame, name: str,
                  on: Sequence[str] = (), shortest: int = 1) -> DataFrame:
    """Distinct (``on``, ``text_key``, ``name``) with the name inside the text; empty names match nothing.

    ``shortest`` is a guaranteed lower bound of the name length; up to 4 it saves the shorter seeds.
    """
    shortest = min(shortest, SEED)
    wanted = (
        names.where(F.length(name) >= shortest).select(*on, F.col(name).alias("_name")).distinct()
        .withColumn("_seed", F.substring("_name", 1, SEED))
    )
    sizes = wanted.groupBy(*on, "_seed").agg(F.collect_set(F.length("_name")).alias("_sizes"))
    keys = [*on, *text_key]
    known = texts.where(F.length(text) >= shortest).select(*keys, F.col(text).alias("_text"))
    places = known.select(*keys, F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("_text")), lambda i: F.substr("_text", i, F.lit(SEED))
    )).alias("_at", "_cut"))
    seeds = F.array(*[F.substring("_cut", 1, n) for n in range(shortest, SEED + 1)])
    met = places.withColumn("_seed", F.explode(F.array_distinct(seeds))).join(sizes, [*on, "_seed"]).select(*keys, "_at", F.explode("_sizes").alias("_size"))
    probes = (
        met.distinct().join(known, keys).where(F.length("_text") >= F.col("_at") + F.col("_size"))
        .select(*keys, F.substr("_text", F.col("_at") + 1, F.col("_size")).alias("_name"))
        .distinct()
    )
    return probes.join(wanted.drop("_seed"), [*on, "_name"]).withColumnRenamed("_name", name)
