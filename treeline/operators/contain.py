"""Which texts hold which names anywhere, inside words included: a join on the names' rarest q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.plans.session import kept

#: Characters of a seed.
Q = 6


def _grams(text: Column, n: Column | int) -> Column:
    """All runs of ``n`` characters; none if the text is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(text, i, n))


def holding(texts: DataFrame, names: DataFrame, q: int = Q) -> DataFrame:
    """``pos``, ``name`` of each text (pos, text) and name (name) that it holds; empty and null names are in none.

    A name is looked up by its seed, the one of its runs of ``q`` characters that the fewest names have (a shorter name is its
    own seed).  Texts give their runs of the lengths that seeds have, at most ``q`` of them; only where a seed is met, the
    text is searched for the name.  So no text meets every name.
    """
    names = kept(names.select("name").filter("name <> ''").distinct())
    runs = names.select("name", F.explode(F.array_distinct(_grams(F.col("name"), F.least(F.length("name"), F.lit(q))))).alias("seed"))
    common = runs.groupBy("seed").agg(F.count("*").alias("n"))
    seeds = kept(runs.join(common, "seed").groupBy("name").agg(F.min_by("seed", F.struct("n", "seed")).alias("seed")))
    lengths = [r["n"] for r in seeds.select(F.length("seed").alias("n")).distinct().collect()]  # q numbers at most
    if not lengths:
        return texts.select("pos").crossJoin(names).limit(0)
    every = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), n) for n in sorted(lengths)])))
    met = texts.select("pos", F.explode(every).alias("seed")).join(seeds, "seed").select("pos", "name").distinct()
    return met.join(texts.select("pos", "text"), "pos").filter(F.col("text").contains(F.col("name"))).select("pos", "name")
