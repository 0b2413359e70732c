"""Running folds over arrays, by DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def running(xs: Column, zero: Column, item: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = BLOCK) -> Column:
    """The array of what ``step(state, x)`` gives beside its next state, from left to right.

    ``item`` is the type of an element.  Appending to an array copies it, so the elements of ``block`` steps are
    gathered first and the gathered arrays then: ``n * (block + n / block)`` copies in all rather than ``n * n``.
    """
    none, nones = F.array().cast(f"array<{item}>"), F.array().cast(f"array<array<{item}>>")
    count = F.size(xs)
    starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(block))).otherwise(F.array().cast("array<int>"))

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["one"], F.array(out.cast(item))).alias("one"), acc["all"].alias("all"))

    def many(acc: Column, at: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), none.alias("one"), acc["all"].alias("all"))
        end = lambda a: F.struct(a["state"].alias("state"), F.concat(a["all"], F.array(a["one"])).alias("all"))
        return F.aggregate(F.slice(xs, at, F.lit(block)), begin, one, end)

    return F.aggregate(starts, F.struct(zero.alias("state"), nones.alias("all")), many, lambda a: F.flatten(a["all"]))
