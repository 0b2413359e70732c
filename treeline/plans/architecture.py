"""The parts of a tree, how they lean on each other, and the steps that tell it before any code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T
from treeline.operators.peel import peeled


def layered(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``root``, ``layer``: ways in first (0), foundations last; parts without an edge to another have none.

    Each layer holds what no remaining part imports; on a cycle, what the fewest import, and then the least name.
    """
    names = parts.select("root").distinct()
    there = edges.filter("from <> to").join(names.withColumnRenamed("root", "from"), "from", "left_semi").join(names.withColumnRenamed("root", "to"), "to", "left_semi")
    ends = there.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    waves = peeled(ends.withColumn("group", F.lit("")), there.select(F.lit("").alias("group"), F.col("to").alias("node"), F.col("from").alias("need")))
    return names.join(waves.select(F.col("node").alias("root"), F.col("wave").alias("layer")), "root", "left")


def steps(parts: DataFrame, edges: DataFrame, total_files: DataFrame, name: str) -> DataFrame:
    """``ordinal``, ``part`` (null for the whole), ``title``, ``text``; none for fewer than two parts.

    ``parts`` has root, kind, file_count, loc, public_symbols, top (array of paths); ``edges`` from, to, count;
    ``total_files`` one row with n.
    """
    short = lambda c: P.basename(F.col(c))
    into = edges.groupBy(F.col("to").alias("root")).agg(F.array_sort(F.collect_list(short("from"))).alias("users"))
    out = edges.groupBy(F.col("from").alias("root")).agg(F.array_sort(F.collect_list(short("to"))).alias("used"))
    met = parts.join(into, "root", "left").join(out, "root", "left")
    leans = F.concat_ws("; ", F.concat(F.lit("imported by "), F.array_join("users", ", ")), F.concat(F.lit("imports "), F.array_join("used", ", ")))
    told = F.when(leans == "", "No import connects it to the other parts.").otherwise(F.concat(F.lit("It is "), leans, F.lit(".")))
    weight = F.when(F.size("top") > 0, F.concat(F.lit(" Most of its weight: "), F.array_join(F.transform("top", lambda p: P.basename(p)), ", "), F.lit(".")))
    counted = F.concat(T.plural(F.col("file_count"), "code file"), F.lit(", "), T.plural(F.col("loc"), "line"), F.lit(", "), T.plural(F.col("public_symbols"), "public symbol"))
    text = F.concat(counted, F.when(F.col("kind") == "repo", ", a repository of its own").otherwise(""), F.lit(". "), told, F.coalesce(weight, F.lit("")))
    each = met.select(F.col("root").alias("part"), F.col("root").alias("title"), text.alias("text"), (F.row_number().over(W.orderBy("root"))).cast("long").alias("ordinal"))
    alone = met.filter("users IS NULL AND used IS NULL").agg(F.array_sort(F.collect_list(short("root"))).alias("alone"))
    sums = parts.agg(F.count("*").alias("parts"), F.sum("file_count").alias("inside")).join(F.broadcast(edges.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("crossing"))))
    one = sums.join(F.broadcast(alone)).join(F.broadcast(total_files.select("n")))
    flow = F.when(F.col("crossing") > 0, F.concat(T.plural(F.col("crossing"), "import"), F.lit(" cross between them."))).otherwise("No import crosses between them.")
    lone = F.when(F.size("alone") > 0, F.concat(F.lit(" Unconnected: "), F.array_join("alone", ", "), F.lit(".")))
    rest = F.when(F.col("n") > F.col("inside"), F.concat(F.lit(" "), T.plural(F.col("n") - F.col("inside"), "file"), F.lit(" lie outside.")))
    whole = F.concat(T.plural(F.col("parts"), "part"), F.lit(" carry "), T.plural(F.col("n"), "file"), F.lit(". "), flow, F.coalesce(lone, F.lit("")), F.coalesce(rest, F.lit("")))
    first = one.filter("parts > 1").select(F.lit(None).cast("string").alias("part"), F.lit(name).alias("title"), whole.alias("text"), F.lit(0).cast("long").alias("ordinal"))
    return first.unionByName(each.join(F.broadcast(first.select(F.lit(1).alias("__many"))), how="left_semi", on=F.lit(True)))
