"""Ordered picks: per-group bests, quotas, first and last, chat windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: turns a chat keeps.
CHAT_TURNS = 30


def best(rows: DataFrame, by: list[str], order: list, n: int, back: list | None = None) -> DataFrame:
    """The first n rows of each group, with their rank; ``back`` re-ranks those kept in another order."""
    kept = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)
    if back is None:
        return kept
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*back)).cast("long"))


def headline(symbols: DataFrame, by: list[str], n: int) -> DataFrame:
    """A file's headline symbols: no variables; documented, then exported, then longest; in line order."""
    order = [F.col("doc").isNull(), ~F.col("exported"), (F.col("start") - F.col("end")), F.col("pos")]
    return best(symbols.filter("kind <> 'variable'"), by, order, n, [F.col("start"), F.col("pos")])


def quota(rows: DataFrame, key: str, group: str, rank: str, degree: str, n: int) -> DataFrame:
    """An itinerary of n rows: the best ranked; the one of most importers; then by rank, each group at most
    ``max(2, ceil(n / 2))`` times, and without that cap if places stay free.

    Equal to the greedy loop: a row's place within its group, seeds counted first, tells whether the first
    pass takes it.  Only rows that can be among the n leave their groups.
    """
    cap = max(2, -(-n // 2))
    entry = rows.orderBy(rank, key).limit(1).select(key, F.lit(0).alias("seed"))
    first = entry.first()
    taken = first[key] if first else None
    hub = rows.filter((F.col(degree) > 0) & (F.col(key) != F.lit(taken))).orderBy(F.col(degree).desc(), rank, key).limit(1)
    seeds = entry.unionByName(hub.select(key, F.lit(1).alias("seed")))
    marked = rows.join(F.broadcast(seeds), key, "left")
    is_seed = F.col("seed").isNotNull()
    place = F.row_number().over(W.partitionBy(group).orderBy((~is_seed).cast("int"), rank, key))
    phase = F.when(is_seed, 0).when(F.col("__place") <= cap, 1).otherwise(2)
    near = marked.withColumn("__place", place).filter(is_seed | (F.col("__place") <= n)).withColumn("pass", phase)
    order = W.orderBy("pass", F.coalesce("seed", F.lit(9)), rank, key)
    top = near.orderBy("pass", F.coalesce("seed", F.lit(9)), rank, key).limit(max(n, 2))
    return top.withColumn("ordinal", F.row_number().over(order).cast("long")).filter(F.col("ordinal") <= n).drop("__place", "seed")


def first_by(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The whole row of each group that comes first; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("x"))
    return picked.select(*by, *[F.col(f"x.{c}").alias(c) for c in rest])


def last_by(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return picked.select(*by, *[F.col(f"x.{c}").alias(c) for c in rest])


def occurrence(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rows with ``n``: how many of their group came before."""
    return rows.withColumn("n", (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def chat_window(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = CHAT_TURNS) -> DataFrame:
    """The last n turns with text, from the first of the user on; any role but the assistant's is the user's."""
    said = turns.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    said = said.withColumn("role", F.when(F.col("role") == "assistant", "assistant").otherwise("user"))
    late = said.withColumn("rn", F.row_number().over(W.partitionBy(conv).orderBy(F.col(turn).desc()))).filter(F.col("rn") <= n)
    first = F.min(F.when(F.col("role") == "user", F.col(turn))).over(W.partitionBy(conv))
    return late.withColumn("first", first).filter(F.col(turn) >= F.col("first")).drop("rn", "first")
