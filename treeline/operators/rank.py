"""Importance ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.plans.session import kept

#: Weights of churn, in-degree and size; the deep slice's share and least score.
CHURN, DEGREE, SIZE = 0.45, 0.35, 0.20
SLICE, LEAST_SCORE = 0.15, 0.30


def counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    """How often each key occurs."""
    return rows.groupBy(F.col(key).alias("path")).agg(F.count("*").alias(name))


def in_degree(edges: DataFrame) -> DataFrame:
    """Distinct sources of each target, self-edges aside."""
    return edges.filter("from <> to").groupBy(F.col("to").alias("path")).agg(F.count_distinct("from").alias("in_degree"))


def _logged(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0)).cast("double"))


def score(files: DataFrame, churn: DataFrame, degree: DataFrame) -> DataFrame:
    """``files`` (path, loc, multiplier, ...) with churn, in_degree, the three components and the score.

    Components are logarithms over the largest of all files; that one row is made by one aggregation and
    joined to every row, so ranking isn't a window over the whole table.
    """
    joined = files.join(churn, "path", "left").join(degree, "path", "left")
    joined = kept(joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("churn", "in_degree")}))  # read twice below
    cols = {"churn_part": "churn", "degree_part": "in_degree", "size_part": "loc"}
    most = joined.agg(*[F.max(_logged(F.col(c))).alias(f"max_{c}") for c in cols.values()])
    part = lambda c: F.when(F.coalesce(F.col(f"max_{c}"), F.lit(0.0)) == 0, 0.0).otherwise(_logged(F.col(c)) / F.col(f"max_{c}"))
    out = joined.join(F.broadcast(most)).withColumns({k: part(c) for k, c in cols.items()}).drop(*[f"max_{c}" for c in cols.values()])
    total = (CHURN * F.col("churn_part") + DEGREE * F.col("degree_part") + SIZE * F.col("size_part")) * F.col("multiplier")
    return out.withColumn("score", F.least(F.lit(1.0), total))


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their global position from 1, without a window over all of them.

    Rows are range-sorted and kept; a row's place is its partition's offset, from one count per partition,
    plus its place inside.
    """
    held = kept(rows.sort(*order)).withColumn("__id", F.monotonically_increasing_id())
    held = held.withColumn("__part", F.shiftright("__id", 33))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return held.join(F.broadcast(offsets), "__part").withColumn(name, place.cast("long")).drop("__id", "__part", "__before")


def numbered_within(rows: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their position from 1 in their group, without a task that holds a whole group.

    As ``numbered``, with one count per partition and group; a null group is a group.
    """
    held = kept(rows.sort(group, *order)).withColumn("__id", F.monotonically_increasing_id())
    held = held.withColumn("__part", F.shiftright("__id", 33))
    runs = held.groupBy(F.col(group).alias("__group"), "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__group").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__group", F.col("__part").alias("__at"), "__first", before.alias("__before"))
    met = held.join(runs, held[group].eqNullSafe(runs["__group"]) & (held["__part"] == runs["__at"]))
    place = F.col("__before") + F.col("__id") - F.col("__first") + 1
    return met.withColumn(name, place.cast("long")).drop("__id", "__part", "__group", "__at", "__first", "__before")


def deep_slice(ranked: DataFrame, key: str = "path") -> DataFrame:
    """Rows of score above 0: the first 15 %, and all of 0.30 or more, with their rank."""
    placed = numbered(ranked.filter("score > 0"), [F.col("score").desc(), F.col(key)])
    sums = placed.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= LEAST_SCORE).alias("hits"))
    cut = sums.select(F.greatest(F.ceil(F.col("n") * SLICE), F.col("hits")).alias("keep"))
    return placed.join(F.broadcast(cut)).filter("rank <= keep").drop("keep")


def why(churn: Column, degree: Column, loc: Column, kind: Column) -> Column:
    """``N commits · N importers · N loc · class``, parts of 0 left out."""
    bit = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    return F.concat_ws(" · ", bit(churn, "commits"), bit(degree, "importers"), bit(loc, "loc"), kind)
