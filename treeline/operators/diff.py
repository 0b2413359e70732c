"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def numbered(lines: DataFrame) -> DataFrame:
    """Diff lines (file, pos, line) as (file, hunk, pos, kind, old_no, new_no, text, header).

    ``diff --git`` ends a hunk, a header begins one; lines outside, empty and ``\\`` lines go.  Context has both
    numbers, a deletion no new one, an addition no old one.  One sort per file.
    """
    order = W.partitionBy("file").orderBy("pos")
    head = F.col("line").rlike(HEADER)
    start = F.col("line").startswith("diff --git")
    marked = lines.withColumn("is_head", head).withColumn("section", F.sum(F.when(start, 1).otherwise(0)).over(order))
    marked = marked.withColumn("hunk", F.sum(F.when(head, 1).otherwise(0)).over(order))
    inside = W.partitionBy("file", "section", "hunk").orderBy("pos")
    get = lambda i: F.regexp_extract("line", HEADER, i)
    first = lambda c: F.first(F.when(F.col("is_head"), c), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumns({"old_start": first(get(1).try_cast("long")), "new_start": first(get(3).try_cast("long")), "header": first(F.trim(get(5)))})
    sign = F.substring("line", 1, 1)
    kind = F.when(F.col("is_head"), None).when(sign == "+", "add").when(sign == "-", "del").when(sign == " ", "ctx")
    body = marked.withColumn("kind", kind).filter("old_start IS NOT NULL")
    rows = inside.rowsBetween(W.unboundedPreceding, 0)
    old = F.sum(F.when(F.col("kind").isin("ctx", "del"), 1).otherwise(0)).over(rows)
    new = F.sum(F.when(F.col("kind").isin("ctx", "add"), 1).otherwise(0)).over(rows)
    body = body.withColumns({"o": F.col("old_start") + old - 1, "n": F.col("new_start") + new - 1}).filter("kind IS NOT NULL")
    return body.select(
        "file", F.col("hunk").cast("long"), F.col("pos").cast("long"), "kind", F.when(F.col("kind") != "add", F.col("o")).cast("long").alias("old_no"),
        F.when(F.col("kind") != "del", F.col("n")).cast("long").alias("new_no"), F.expr("substring(line, 2)").alias("text"), "header",
    )


def totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("file").agg(F.count_if(F.col("kind") == "add").alias("added"), F.count_if(F.col("kind") == "del").alias("removed"))


def hunks(lines: DataFrame) -> DataFrame:
    """Hunk ranges from headers (file, pos, line): start, end of the new side, lines added and removed.

    An omitted count is 1; a range starts and ends at 1 at least.
    """
    get = lambda i: F.regexp_extract("line", HEADER, i)
    count = lambda i: F.when(get(i) == "", 1).otherwise(get(i).try_cast("long"))
    start = get(3).try_cast("long")
    end = F.greatest(start + count(4) - 1, start)
    one = lambda c: F.greatest(c, F.lit(1)).cast("long")
    return lines.filter(F.col("line").rlike(HEADER)).select(
        "file", F.col("pos").cast("long"), one(start).alias("start"), one(end).alias("end"), count(4).cast("long").alias("added"), count(2).cast("long").alias("removed")
    )
