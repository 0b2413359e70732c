"""The import graph: resolution, edges, coverage, owners, reachability, architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths as P

#: Suffixes tried for an import, in order.
JS_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")


def python_candidates(raw: Column, path: Column, repo: Column) -> Column:
    """Paths a Python import may mean, likeliest first."""
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    bare = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(P.dirname(path), "/"), lambda s: s != "")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    join = lambda *x: P.normalize(F.concat_ws("/", *x))
    bases = F.when(dots > 0, F.array(join(up, bare))).otherwise(F.array(join(repo, bare), join(repo, F.lit("src"), bare), bare))
    return F.flatten(F.transform(bases, lambda b: F.transform(F.array(*[F.lit(x) for x in (".py", "/__init__.py", ".pyi")]), lambda x: F.concat(b, x))))


def js_candidates(raw: Column, path: Column) -> Column:
    """Paths a relative JavaScript or TypeScript import may mean; none for a package's name."""
    base = P.normalize(F.concat_ws("/", P.dirname(path), raw))
    tails = F.array(*[F.lit(x) for x in JS_SUFFIXES])
    add = lambda b, mid="": F.transform(tails, lambda x: F.concat(b, F.lit(mid), x))
    bare = F.regexp_replace(base, r"\.(js|mjs|cjs)$", "")
    swapped = F.when(bare != base, add(bare)).otherwise(F.array().cast("array<string>"))
    return F.when(raw.startswith("."), F.concat(F.array(base), add(base), add(base, "/index"), swapped)).otherwise(F.array().cast("array<string>"))


def resolve(imports: DataFrame, files: DataFrame, keys: list[str], candidates: str = "candidates") -> DataFrame:
    """``imports`` with ``resolved``: the first of its candidate paths that is a file; null if none is."""
    tried = imports.select(*keys, F.posexplode(candidates).alias("__try", "__path"))
    there = files.select(F.col("path").alias("__path")).distinct()
    hits = tried.join(there, "__path").groupBy(*keys).agg(F.min_by("__path", "__try").alias("resolved"))
    return imports.join(hits, keys, "left")


def edges(imports: DataFrame) -> DataFrame:
    """Distinct resolved (from, to) pairs, self-imports aside; ``imports`` has path and resolved."""
    pairs = imports.filter("resolved IS NOT NULL AND resolved <> path")
    return pairs.select(F.col("path").alias("from"), F.col("resolved").alias("to")).distinct()


def coverage(imports: DataFrame) -> DataFrame:
    """One row: imports, those resolved to another file, and those that left the tree (self-imports do)."""
    inside = F.coalesce(F.col("resolved") != F.col("path"), F.lit(False))
    out = imports.agg(F.count("*").alias("total"), F.count_if(inside).alias("resolved"))
    return out.withColumn("left_tree", F.col("total") - F.col("resolved"))


def importers(edge: DataFrame) -> DataFrame:
    """Per target: how many import it, and who, in order."""
    return edge.groupBy(F.col("to").alias("path")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("from")).alias("importers"))


def owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` with ``owner``: the longest root (``root``) that is the path or lies above it; null if none.

    Each path meets its own prefixes by equality, so no pair of path and root is compared.
    """
    tried = paths.select("path").distinct().withColumn("root", F.explode(P.self_and_ancestors(F.col("path"))))
    best = tried.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("owner"))
    return paths.join(best, "path", "left")


def contracted(edge: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between owners (path, owner) with how many cross; those inside one owner go."""
    a = owners.select(F.col("path").alias("from"), F.col("owner").alias("a"))
    b = owners.select(F.col("path").alias("to"), F.col("owner").alias("b"))
    met = edge.join(a, "from").join(b, "to").filter("a <> b")
    return met.groupBy(F.col("a").alias("from"), F.col("b").alias("to")).agg(F.count("*").alias("count"))


def ripple(moved: DataFrame, edge: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``path``, ``hop``: who imports the moved paths, who imports those, and so on; each at its least hop.

    The edges are kept once, dealt by what they point at.  One job a hop: the frontier meets the edges, and what was
    seen drops out.  Every round is kept by checkpoint, so neither the plan nor the lineage grows.
    """
    from treeline.plans.session import kept

    edge = kept(edge.select("from", "to").repartition("to"))
    frontier = kept(moved.select("path").distinct().withColumn("hop", F.lit(0).cast("long")))
    seen, hop = frontier, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = edge.join(frontier.select(F.col("path").alias("to")), "to").select(F.col("from").alias("path")).distinct()
        frontier = kept(reached.join(seen, "path", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = kept(seen)
    return seen.filter("hop > 0")


def parts(files: DataFrame, repos: DataFrame, least_files: int = 2) -> DataFrame:
    """Roots of architecture parts: directories with enough direct code files, and nested repositories; never
    the scan root.  ``files`` has path, code."""
    direct = files.filter("code").groupBy(P.dirname(F.col("path")).alias("root")).agg(F.count("*").alias("n"))
    roots = direct.filter(F.col("n") >= least_files).select("root", F.lit("directory").alias("kind"))
    all_roots = roots.unionByName(repos.select("root", F.lit("repo").alias("kind"))).filter("root <> ''")
    return all_roots.groupBy("root").agg(F.max("kind").alias("kind"))


def layers(nodes: list[str], edge: list[tuple[str, str]]) -> tuple[list[list[str]], list[str]]:
    """Rows of parts, ways in first and foundations last, and the parts without an edge.

    Parts are few and on the driver.  Each row holds what no remaining part imports; on a cycle, what the
    fewest import, and the least name.
    """
    joined = {x for e in edge for x in e}
    left = {n for n in nodes if n in joined}
    rows: list[list[str]] = []
    while left:
        into = {n: sum(1 for a, b in edge if b == n and a in left and a != n) for n in left}
        row = sorted(n for n in left if not into[n]) or [min(left, key=lambda n: (into[n], n))]
        rows.append(row)
        left -= set(row)
    return rows, sorted(n for n in nodes if n not in joined)
