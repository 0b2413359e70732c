"""Line ranges: containment, gaps, picks and sections.  Ranges are closed; ``pos`` is the order in the file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Load-bearing symbols of a file, least span of a variable or type, lines of a section.
PICKS, LEAST_SPAN, SECTION_LINES = 5, 3, 45


def strictly_containing(ranges: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``ranges`` with ``contains``: whether another range of the group lies inside and isn't equal.

    One sort per group and no pairs: a range that starts later and ends no later, or starts on the same line and
    ends earlier.
    """
    line = W.partitionBy(*by).orderBy(F.col(start).cast("long")).rangeBetween(1, W.unboundedFollowing)
    same = W.partitionBy(*by, start)
    later, equal = F.min(end).over(line), F.min(end).over(same)
    return ranges.withColumn("contains", F.coalesce(later <= F.col(end), F.lit(False)) | (equal < F.col(end)))


def eligible(kind: Column, span: Column) -> Column:
    return kind.isin("function", "method", "class", "interface", "enum") | (span >= LEAST_SPAN)


def greedy(items: Column, limit: int = PICKS) -> Column:
    """From ``array<struct<..., start, end>>`` in order of preference: those that overlap none taken before."""
    empty = F.slice(items, F.lit(1), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"]))
        return F.when((F.size(acc) >= limit) | clash, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, empty, step)


def load_bearing(symbols: DataFrame, by: list[str], limit: int = PICKS) -> DataFrame:
    """The symbols that carry each file: biggest span first, no overlaps, back in line order.

    ``symbols`` has start, end, pos.  A file's list is folded in memory.
    """
    pick = F.struct((F.col("start") - F.col("end")).alias("rank"), "start", "pos", "end")
    lists = symbols.groupBy(*by).agg(F.array_sort(F.collect_list(pick)).alias("items"))
    taken = lists.withColumn("x", F.explode(greedy(F.col("items"), limit)))
    return taken.select(*by, F.col("x.pos").alias("pos"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def gaps(ranges: DataFrame, by: list[str], start: str = "start", end: str = "end", size: str | None = None) -> DataFrame:
    """What a group's ranges leave free, from 1 to ``size`` (or the last end)."""
    order = W.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    open_at = F.coalesce(before, F.lit(0)) + 1
    inner = ranges.select(*by, open_at.cast("long").alias("gap_start"), (F.col(start) - 1).cast("long").alias("gap_end"))
    if size is not None:
        last = ranges.groupBy(*by).agg((F.max(end) + 1).cast("long").alias("gap_start"), F.max(size).cast("long").alias("gap_end"))
        inner = inner.unionByName(last)
    return inner.filter("gap_start <= gap_end")


def opening(first_symbol: Column, loc: Column) -> Column:
    """Last line of a file's opening stop."""
    head = F.greatest(F.least(first_symbol - 1, F.lit(24)), F.lit(6))
    return F.least(head, F.greatest(loc, F.lit(1)))


def sections(start: Column, end: Column, blanks: Column, lines: int = SECTION_LINES) -> Column:
    """A stop's range as one to three ranges, cut at the blank line nearest each even point.

    Spans up to 1.4 times ``lines`` stay whole, and so does one without a blank line 5 lines from its ends.
    ``blanks`` are the file's blank lines.
    """
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  an expression named twice is computed twice

    def cut(own: Column) -> Column:
        start, end, n = own["start"], own["end"], own["n"]
        span = end - start + 1
        whole = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        near = lambda inner, at: F.array_min(F.transform(inner, lambda b: F.struct(F.abs(b - at).alias("far"), b.alias("line"))))["line"]

        def ranges(points: Column) -> Column:
            starts, ends = F.concat(F.array(start.cast("long")), F.transform(points, lambda p: (p + 1).cast("long"))), F.concat(F.transform(points, lambda p: p.cast("long")), F.array(end.cast("long")))
            return F.arrays_zip(starts.alias("start"), ends.alias("end"))

        def points(inner: Column) -> Column:
            each = F.transform(F.sequence(F.lit(1), n - 1), lambda i: start + (span * i / n))
            nearest = F.array_sort(F.array_distinct(F.transform(each, lambda at: near(inner, at))))
            return F.when(F.size(inner) == 0, whole).otherwise(once(nearest, ranges))

        # the bounds are elements of an array of one, so that a line costs a comparison and not their computation
        low, high = start + 5, end - 5
        inner = once(F.struct(low.alias("low"), high.alias("high")), lambda x: F.filter(blanks, lambda b: (b >= x["low"]) & (b <= x["high"])))
        return F.when((span <= 1.4 * lines) | (n < 2), whole).otherwise(once(inner, points))

    n = F.least(F.ceil((end - start + 1) / lines), F.lit(3)).cast("int")
    return once(F.struct(start.alias("start"), end.alias("end"), n.alias("n")), cut)


def change_stop(hunks: DataFrame, by: list[str]) -> DataFrame:
    """Three lines before the first hunk to three after the last."""
    lo, hi = F.greatest(F.min("start") - 3, F.lit(1)), F.max("end") + 3
    return hunks.groupBy(*by).agg(lo.cast("long").alias("start"), hi.cast("long").alias("end"))


def budgeted(rows: DataFrame, by: list[str], order: list, size: str, budget: int, free: str | None = None) -> DataFrame:
    """Rows admitted in order while their sizes fit a budget; one that doesn't is skipped and later ones tried.

    Rows where ``free`` is true are always admitted and don't count.  A group's rows pass by in order, of which
    only the budget used so far is held.
    """
    flag = F.coalesce(F.col(free), F.lit(False)) if free else F.lit(False)
    marked = rows.withColumns({"__size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "__free": flag})
    ordered = marked.repartition(*by).sortWithinPartitions(*by, *order)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by))
            fits = []
            for key, n, always in zip(keys, batch.column("__size").to_pylist(), batch.column("__free").to_pylist()):
                if key != now:
                    now, used = key, 0
                fits.append(always or used + n <= budget)
                used += n if fits[-1] and not always else 0
            yield batch.filter(pa.array(fits)).select(names)

    return ordered.mapInArrow(run, rows.schema)


def interpreted_stop(start: Column, loc: Column, lines: int = 60) -> Column:
    """Last line of what an interpretation reads from ``start``: ``lines`` of them, or as many as the file has."""
    return F.least(start + lines - 1, F.greatest(loc, F.lit(1)))


def admissible(path: Column, kind: Column, binary: Column, loc: Column, size: Column, tooling: Column, most: int = 400_000) -> Column:
    """Whether a file may be shown on a page: read, with lines, not made or vendored, not too large, not of a tool."""
    return ~binary & (loc > 0) & ~kind.isin("generated", "vendored", "lockfile") & (size <= most) & ~tooling
