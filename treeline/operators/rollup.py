"""Directory rollups: sums, histograms, top files and content hashes of every directory of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P

TOP_FILES = 10


def tiers(files: DataFrame) -> DataFrame:
    """Per directory, ancestors included: file_count, loc (of known sizes), public_symbols, score (largest).

    ``files`` has path, loc, score, public_symbols.  Each file adds to as many rows as its path has
    directories, which are summed before the shuffle.
    """
    spread = files.withColumn("dir", F.explode(P.ancestors(F.col("path"))))
    loc = F.sum(F.when(F.col("loc") > 0, F.col("loc")).otherwise(0))
    return spread.groupBy("dir").agg(
        F.count("*").alias("file_count"), loc.alias("loc"), F.sum("public_symbols").alias("public_symbols"), F.max("score").alias("score")
    )


def histogram(files: DataFrame, column: str) -> DataFrame:
    """Files per directory and value of ``column``."""
    return files.withColumn("dir", F.explode(P.ancestors(F.col("path")))).groupBy("dir", column).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """One map per key from (key, value, n) rows, entries by value."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(value), F.col(n))))
    return counts.groupBy(key).agg(F.map_from_entries(entries).alias("histogram"))


def top_files(files: DataFrame, k: int = TOP_FILES) -> DataFrame:
    """The k best files of every directory (dir, rank, path, score).

    The k best of a subtree hold the k best of its parents' shares, so the list is first cut within each
    file's own directory.
    """
    best = lambda by: W.partitionBy(by).orderBy(F.col("score").desc(), F.col("path"))
    own = files.withColumn("own", P.dirname(F.col("path"))).withColumn("rn", F.row_number().over(best("own"))).filter(F.col("rn") <= k)
    spread = own.drop("rn", "own").withColumn("dir", F.explode(P.ancestors(F.col("path"))))
    ranked = spread.withColumn("rank", F.row_number().over(best("dir")).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("dir", "rank", "path", "score")


def tier_kind(path: Column, is_root: Column, parent_is_root: Column) -> Column:
    return F.when(is_root, "repo").when(parent_is_root, "subsystem").otherwise("directory")


def max_depth(files: DataFrame) -> int:
    """Levels of the tree (an action)."""
    return files.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0


def merkle(files: DataFrame, depth: int | None = None) -> DataFrame:
    """A hash per directory over its child directories' ``path:hash`` lines and then its files' ``path:sha``
    lines, each sorted.  ``files`` has path, sha.

    A parent needs its children's hashes, so the plan has one level per directory level, deepest first;
    each is one aggregation over that level's entries alone.
    """
    depth = max_depth(files) if depth is None else depth
    leaves = files.select(P.dirname(F.col("path")).alias("dir"), F.lit(1).alias("kind"), "path", F.col("sha").alias("hash"))
    leaves = leaves.withColumn("level", P.depth(F.col("dir")))
    below = None
    out = None
    for level in range(depth - 1, -1, -1):
        entries = leaves.filter(F.col("level") == level).select("dir", "kind", "path", "hash")
        if below is not None:
            up = below.select(P.dirname(F.col("dir")).alias("dir"), F.lit(0).alias("kind"), F.col("dir").alias("path"), "hash")
            entries = entries.unionByName(up)
        lines = F.array_sort(F.collect_list(F.struct("kind", "path", "hash")))
        text = F.array_join(F.transform(lines, lambda x: F.concat(x["path"], F.lit(":"), x["hash"], F.lit("\n"))), "")
        below = entries.groupBy("dir").agg(F.sha2(text, 256).alias("hash"))
        out = below if out is None else out.unionByName(below)
    return out if out is not None else files.select(F.lit("").alias("dir"), F.lit("").alias("hash")).limit(0)
