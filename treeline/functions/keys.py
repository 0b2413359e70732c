"""Content keys: stable ids of steps, stops and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str, size: int = 64) -> Column:
    """The first ``size`` hex digits of the SHA-256 of the parts, joined by a NUL."""
    return F.left(F.sha2(F.concat_ws("\0", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256), F.lit(size))


def step_key(file: Column, start: Column, end: Column) -> Column:
    return F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def step_id(file: Column, kind: Column, name: Column, number: Column) -> Column:
    """16 hex digits from file, kind and name; a later symbol of the same name also has its number."""
    tail = F.when(number > 0, F.concat(F.lit("#"), number.cast("string"))).otherwise(F.lit(""))
    return digest(file, kind, F.concat(name, tail), size=16)


def stop_key(version: str, sha: Column, start: Column, end: Column, writer: Column, excerpt: Column) -> Column:
    """A key of everything that an interpretation depends on; the writer counts unless it is the default (null)."""
    return digest(F.lit(version), sha, start.cast("string"), end.cast("string"), writer, excerpt, size=32)
