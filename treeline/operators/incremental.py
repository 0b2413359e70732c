"""What changed between two snapshots of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths as P


def diff(prior: DataFrame, current: DataFrame) -> DataFrame:
    """``path``, ``status``, ``from_path``, ``sha`` over both snapshots (path, sha).

    reuse: same path and content; recompute: same path, other content; carried: a new path whose content a
    path that is gone had (``from_path``, the least such); added: any other new path; deleted: a path that is
    gone and from which nothing was carried.  Several new paths may carry from one.
    """
    both = prior.select("path", F.col("sha").alias("old")).join(current.select("path", F.col("sha").alias("new")), "path", "full")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "reuse").otherwise("recompute")
    both = both.withColumn("status", status)
    source = both.filter("status = 'gone'").groupBy(F.col("old").alias("sha")).agg(F.min("path").alias("from_path"))
    fresh = both.filter("status = 'new'").select("path", F.col("new").alias("sha")).join(source, "sha", "left")
    fresh = fresh.select("path", F.when(F.col("from_path").isNull(), "added").otherwise("carried").alias("status"), "from_path", "sha")
    taken = fresh.filter("status = 'carried'").select(F.col("from_path").alias("path")).distinct()
    gone = both.filter("status = 'gone'").join(taken, "path", "left_anti")
    none = F.lit(None).cast("string").alias("from_path")
    kept = both.filter("status IN ('reuse', 'recompute')").select("path", "status", none, F.col("new").alias("sha"))
    return kept.unionByName(fresh).unionByName(gone.select("path", F.lit("deleted").alias("status"), none, F.col("old").alias("sha")))


def counts(plan: DataFrame) -> DataFrame:
    """One row: files by status, how many exist now, and the share reused (100 if there are none)."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = plan.agg(*[one(s) for s in ("reuse", "recompute", "carried", "added", "deleted")])
    total = F.col("reuse") + F.col("recompute") + F.col("carried") + F.col("added")
    share = F.when(total == 0, 100.0).otherwise(F.round(100.0 * (F.col("reuse") + F.col("carried")) / total, 6))
    return out.withColumn("total", total).withColumn("percent_reused", share)


def stale_tiers(plan: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Directories whose content changed: ancestors of all paths but the reused, within ``known`` (dir) if given."""
    touched = plan.filter("status <> 'reuse'").select(F.explode(F.array("path", "from_path")).alias("path")).filter("path IS NOT NULL")
    dirs = touched.select(F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct()
    return dirs if known is None else dirs.join(known, "dir", "left_semi")


def reused(current: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Splits rows into those whose key is in ``cache``, with what it holds, and those to be computed."""
    return current.join(cache, key), current.join(cache, key, "left_anti")
