"""Reading itineraries over a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators import intervals as IV
from treeline.operators import rank as R
from treeline.operators import windows as WN

#: Files of a tour and headline symbols of a file.
FILES, SYMBOLS = 8, 3


def code_tour(relations: dict[str, DataFrame], files: int = FILES, symbols: int = SYMBOLS) -> DataFrame:
    """Ordered steps (ordinal, path, start, end, title, text): per file of the itinerary an opening, then its
    headline symbols, long ones in sections."""
    ranked, every = relations["ranked"], relations["symbols"]
    with_symbols = every.select("path").distinct()
    candidates = ranked.filter("score > 0 AND NOT binary AND loc > 0").join(with_symbols, "path", "left_semi")
    candidates = R.numbered(candidates, [F.col("score").desc(), F.col("path")]).withColumn("dir", P.dirname(F.col("path")))
    stops = WN.quota(candidates, "path", "dir", "rank", "in_degree", files).select(F.col("ordinal").alias("stop"), "path", "loc", "class", "in_degree")
    first = every.groupBy("path").agg(F.min("line").alias("first"))
    says = F.concat_ws(" · ", F.col("class"), T.plural(F.col("loc"), "line"), F.when(F.col("in_degree") > 0, T.plural(F.col("in_degree"), "importer")))
    opening = stops.join(first, "path").select(
        "stop", F.lit(0).alias("step"), "path", F.lit(1).cast("long").alias("start"), IV.opening(F.col("first"), F.col("loc")).cast("long").alias("end"),
        P.short_name(F.col("path")).alias("title"), says.alias("text"),
    )
    heads = every.select("path", "pos", "name", "kind", F.col("line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), "exported", "doc")
    best = WN.headline(heads.join(stops.select("path", "stop"), "path"), ["path"], symbols)
    blanks = relations["files"].join(stops.select("path"), "path", "left_semi").select("path", F.split("text", "\n").alias("lines"))
    numbers = F.filter(F.transform("lines", lambda x, i: F.when(F.trim(x) == "", (i + 1).cast("long"))), lambda x: x.isNotNull())
    best = best.join(blanks.select("path", numbers.alias("blanks")), "path").withColumn("part", F.explode(IV.sections(F.col("start"), F.col("end"), F.col("blanks"))))
    told = F.coalesce("doc", F.concat(F.col("kind"), F.lit(" of "), T.plural(F.col("end") - F.col("start") + 1, "line")))
    rest = best.select("stop", F.col("rank").cast("int").alias("step"), "path", F.col("part.start").alias("start"), F.col("part.end").alias("end"), F.col("name").alias("title"), told.alias("text"))
    steps = opening.unionByName(rest)
    return steps.withColumn("ordinal", F.row_number().over(W.orderBy("stop", "step", "start")).cast("long")).drop("stop", "step")


def overlay(relations: dict[str, DataFrame], repos: DataFrame | None = None) -> DataFrame:
    """One row, what a tour over the tables points at: the best file, the most churned small one, the largest, the most
    imported, and the best subsystem of more than one file (from ``tiers``); of equals the first in rank order.

    ``repos`` (root, commit_count) adds all commits and the deepest repository.
    """
    r = relations["ranked"]
    rank = F.struct(F.col("score"), -F.col("loc"), F.col("path"))  # only a tie of all three is left to the path
    best = lambda metric, cond: F.max_by(F.when(cond, F.col("path")), F.when(cond, F.struct(metric, rank)))
    small = (F.col("score") > 0) & (F.col("loc") > 0) & (F.col("loc") < 400) & (F.col("churn") > 0)
    out = r.agg(
        F.max_by("path", rank).alias("top"), best(F.col("churn"), small).alias("churned_small"), best(F.col("loc"), F.col("loc") > 0).alias("largest"),
        best(F.col("in_degree"), F.col("in_degree") > 0).alias("hub"),
    )
    if "kinds" in relations:
        fit = relations["kinds"].filter("kind = 'subsystem' AND file_count > 1")
        out = out.join(F.broadcast(fit.agg(F.max_by("dir", F.struct("score", "dir")).alias("subsystem"))))
    if repos is not None:
        depth = F.size(F.split("root", "/"))
        out = out.join(F.broadcast(repos.agg(F.sum("commit_count").alias("commits"), F.max_by("root", F.struct(depth, "root")).alias("deepest"))))
    return out


def overlay_steps(targets: DataFrame) -> DataFrame:
    """The targets of :func:`overlay` as ordered steps (ordinal, target, path), those that there are."""
    order = [c for c in ("top", "churned_small", "largest", "hub", "subsystem", "deepest") if c in targets.columns]
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(c).alias("target"), F.col(c).alias("path")) for i, c in enumerate(order)])
    return targets.select(F.explode(rows).alias("s")).select("s.*").filter("path IS NOT NULL")


def merged(steps: DataFrame, meanings: DataFrame) -> DataFrame:
    """Steps with what an interpretation says of their place (path, start, end, what, why, summary), where it does."""
    met = steps.join(meanings, ["path", "start", "end"], "left")
    told = T.narrate(F.coalesce(F.concat_ws(" ", "what", "why"), F.col("text")), F.col("summary"))
    return met.withColumn("n", told).select(*steps.columns, F.col("n.summary").alias("summary"), F.col("n.expandable").alias("expandable"))
