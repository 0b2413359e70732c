"""Path columns.  Paths are relative, with ``/`` between segments and no leading one; '' is the root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The parent directory; '' for a path without one."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' if there is none or the name is only a dot-name."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def ancestors(path: Column) -> Column:
    """Every parent directory of a path, the root first; the path itself isn't one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def self_and_ancestors(path: Column) -> Column:
    return F.concat(ancestors(path), F.array(path))


def depth(path: Column) -> Column:
    """Number of segments; 0 for the root."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def normalize(path: Column) -> Column:
    """POSIX form: ``.`` and empty segments go, ``..`` takes back a segment; what climbs out keeps its ``..``."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(acc: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(back, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def beneath(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies under it; everything lies under ''."""
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def short_name(path: Column) -> Column:
    """The last two segments."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2)), "/")
