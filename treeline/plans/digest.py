"""The digest: inventory, extraction, graph, ranking, rollup and what changed since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.extract import api
from treeline.functions import paths as P
from treeline.operators import classify as CL
from treeline.operators import graph as G
from treeline.operators import incremental as INC
from treeline.operators import rank as R
from treeline.operators import rollup as RU
from treeline.plans.session import kept
from treeline.sources.files import inventory


def digest(
    raw: DataFrame, commits: DataFrame, repos: DataFrame | None = None, marks: DataFrame | None = None, prior: DataFrame | None = None,
    cache: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All relations of a tree.  ``raw`` is a tree's files, ``commits`` a log, ``prior`` (path, sha) the last
    index, ``cache`` the last ``extracts`` with their sha: content found there isn't parsed again."""
    files = kept(inventory(raw, repos, marks))
    index = files.select("path", F.col("sha256").alias("sha"))
    targets = files.filter(CL.parse_target(F.col("path"), F.col("class"), F.col("binary"))).withColumnRenamed("sha256", "sha")
    if cache is not None:
        known, fresh = INC.reused(targets.select("path", "sha", "language", "text"), cache.drop("path", "language"), ["sha"])
        made = api.extract(fresh).join(fresh.select("path", "sha"), "path")
        extracts = kept(made.unionByName(known.drop("text").select(*made.columns)))
    else:
        extracts = kept(api.extract(targets).join(targets.select("path", "sha"), "path"))
    symbols = api.symbols(extracts)
    imports = resolved(api.imports(extracts), files)
    edges = kept(G.edges(imports))
    churn = R.counts(commits.filter("path IS NOT NULL"), "path", "churn")
    public = symbols.filter("exported").groupBy("path").agg(F.count("*").alias("public_symbols"))
    base = files.join(public, "path", "left").withColumn("public_symbols", F.coalesce("public_symbols", F.lit(0)))
    ranked = kept(R.score(base.drop("text").withColumn("multiplier", CL.multiplier(F.col("class"))), churn, R.in_degree(edges)))
    out = {
        "files": files, "extracts": extracts, "symbols": symbols, "imports": imports, "edges": edges, "coverage": G.coverage(imports),
        "ranked": ranked, "deep_slice": R.deep_slice(ranked), "tiers": RU.tiers(ranked), "tier_top_files": RU.top_files(ranked),
        "tier_languages": RU.histogram(ranked.filter("language IS NOT NULL"), "language"), "tier_classes": RU.histogram(ranked, "class"),
        "tier_hashes": RU.merkle(index), "unparsed": extracts.filter("reason IS NOT NULL").select("path", "reason"), "index": index,
        "skipped": raw.filter("skipped IS NOT NULL").select("path", F.col("skipped").alias("reason")) if "skipped" in raw.columns else index.limit(0).select("path", F.lit("").alias("reason")),
    }
    if prior is not None:
        out["plan"] = INC.diff(prior, index)
        out["plan_counts"] = INC.counts(out["plan"])
        out["stale_tiers"] = INC.stale_tiers(out["plan"])
    return out


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with the file each means."""
    met = imports.join(files.select("path", "repo"), "path", "left").withColumn("repo", F.coalesce("repo", F.lit("")))
    tried = F.when(F.col("language") == "python", G.python_candidates(F.col("raw"), F.col("path"), F.col("repo")))
    met = met.withColumn("candidates", tried.otherwise(G.js_candidates(F.col("raw"), F.col("path"))))
    return G.resolve(met, files, ["path", "pos"]).drop("candidates", "repo")


def manifest(relations: dict[str, DataFrame]) -> DataFrame:
    """One row: files, lines, classes and imports of a digest."""
    files = relations["files"].agg(
        F.count("*").alias("files"), F.sum(F.when(F.col("loc") > 0, F.col("loc")).otherwise(0)).alias("loc"), F.sum("bytes").alias("bytes"),
        *[F.count_if(F.col("class") == c).alias(c) for c in CL.MULTIPLIERS],
    )
    parsed = relations["extracts"].agg(F.count("*").alias("parsed"), F.count_if(F.col("parse_errors") > 0).alias("with_errors"))
    return files.join(F.broadcast(parsed)).join(F.broadcast(relations["coverage"]))


def parts(relations: dict[str, DataFrame], repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Architecture parts with what they own, and the imports that cross between them."""
    files = relations["ranked"].withColumn("code", F.col("class").isin("source", "structural", "test") & F.col("language").isin(*CL.CODE))
    roots = G.parts(files.select("path", "code"), repos)
    owned = G.owner(files.select("path", "loc", "score", "public_symbols"), roots).filter("owner IS NOT NULL")
    size = F.sum(F.when(F.col("loc") > 0, F.col("loc")).otherwise(0)).alias("loc")
    sums = owned.groupBy(F.col("owner").alias("root")).agg(F.count("*").alias("file_count"), size, F.max("score").alias("score"), F.sum("public_symbols").alias("public_symbols"))
    return roots.join(sums, "root"), G.contracted(relations["edges"], owned.select("path", "owner"))


def kind_of_tiers(tiers: DataFrame, repos: DataFrame) -> DataFrame:
    """``tiers`` with their kind: a repository's root, directly under one, or a directory."""
    roots = repos.select(F.col("root").alias("dir")).distinct().withColumn("is_root", F.lit(True))
    above = roots.select(F.col("dir").alias("parent"), F.lit(True).alias("under"))
    met = tiers.withColumn("parent", P.dirname(F.col("dir"))).join(roots, "dir", "left").join(above, "parent", "left")
    kind = RU.tier_kind(F.col("dir"), F.coalesce("is_root", F.lit(False)) | (F.col("dir") == ""), F.coalesce("under", F.lit(False)))
    return met.withColumn("kind", kind).drop("is_root", "under", "parent")
