"""A tree of files as a table: through Spark's readers, or a local checkout with reasons for what is skipped."""

from __future__ import annotations

import hashlib
import itertools
import os
import stat
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.functions.text import line_count
from treeline.operators import classify as CL

#: Folders never entered, text kept of a file, bytes looked at for a NUL, attributes file's limit.
NEVER = (
    "node_modules .venv venv __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .next .nuxt .svelte-kit .turbo .parcel-cache .gradle "
    ".idea .vscode-test site-packages .terraform .git .treeline"
).split()
MAX_READ, PROBE, ATTRIBUTES_BYTES = 8 << 20, 8192, 1 << 20
CHUNK = 1 << 20
SCHEMA = "path string, bytes long, sha256 string, binary boolean, truncated boolean, text string, skipped string"


def probe(content: Column, max_read: int = MAX_READ) -> dict[str, Column]:
    """Hash of all bytes, whether the start holds a NUL, and the text kept."""
    nul = F.hex(F.substring(content, 1, PROBE)).rlike("^(?:..)*?00")
    return {
        "bytes": F.octet_length(content).cast("long"), "sha256": F.sha2(content, 256), "binary": nul, "truncated": F.octet_length(content) > max_read,
        "text": F.when(~nul, F.decode(F.substring(content, 1, max_read), "UTF-8")),
    }


def read_tree(spark: SparkSession, root: str, max_read: int = MAX_READ) -> DataFrame:
    """All files under a folder of any store, with ``path`` relative to it; skipped folders are dropped by path.

    Spark's readers leave out names that begin with a dot or an underscore; :class:`TreeSource` doesn't.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    rel = F.regexp_replace("path", r"^.*?" + "".join("\\" + c if not c.isalnum() else c for c in base), "")
    kept = raw.withColumn("path", rel).filter(~F.exists(F.split("path", "/"), lambda s: s.isin(NEVER)))
    return kept.select("path", *[c.alias(k) for k, c in probe(F.col("content"), max_read).items()])


class _Part(InputPartition):
    def __init__(self, paths: list[tuple[str, str | None]]) -> None:
        super().__init__(paths)
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["path"])
        self.max_read = int(options.get("maxReadBytes", MAX_READ))
        self.size = int(options.get("filesPerPartition", 500))

    def partitions(self) -> list[_Part]:
        found = sorted(self.walk())
        return [_Part(found[i : i + self.size]) for i in range(0, max(len(found), 1), self.size)]

    def walk(self) -> Iterator[tuple[str, str | None]]:
        """Relative paths, each with a reason if it is skipped.  Links aren't followed, and only regular files are
        files; a folder that can't be read is skipped with the reason."""
        stack = [""]
        while stack:
            folder = stack.pop()
            try:
                entries = list(os.scandir(os.path.join(self.root, folder)))
            except OSError as e:
                yield folder, e.strerror or "unreadable"
                continue
            for e in entries:
                path = os.path.join(folder, e.name)
                if e.is_symlink():
                    yield path, "symlink"
                elif e.is_dir():
                    if e.name not in NEVER:
                        stack.append(path)
                elif e.is_file():
                    yield path, None

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, reason in partition.paths:
            if reason:
                yield path, None, None, None, None, None, reason
                continue
            try:
                yield (path, *self.one(os.path.join(self.root, path)), None)
            except OSError as e:
                yield path, None, None, None, None, None, e.strerror or "unreadable"

    def one(self, path: str) -> tuple[int, str, bool, bool, str | None]:
        return content(path, self.max_read)


def guarded(path: str, most: int | None = None) -> BinaryIO:
    """The file at ``path``, opened for reading if it is a regular file of at most ``most`` bytes; else an OSError.

    No link is followed and no pipe waited for.  What was opened is looked at again: it must be of that kind and size, and the
    file that was there before.
    """
    before = os.lstat(path)
    fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    opened = os.fstat(fd)
    reason = None
    if not stat.S_ISREG(before.st_mode) or not stat.S_ISREG(opened.st_mode):
        reason = "not a regular file"
    elif (before.st_dev, before.st_ino) != (opened.st_dev, opened.st_ino):
        reason = "another file while it was opened"
    elif most is not None and max(before.st_size, opened.st_size) > most:
        reason = "too large"
    if reason:
        os.close(fd)
        raise OSError(0, reason)
    return os.fdopen(fd, "rb")


def read_guarded(path: str, most: int) -> bytes | None:
    """The bytes of a regular file of at most ``most``; None for anything else, as for a file that isn't there.

    A file that grows meanwhile is read up to the size it had.
    """
    try:
        with guarded(path, most) as f:
            return f.read(os.fstat(f.fileno()).st_size)
    except OSError:
        return None


def content(path: str, max_read: int = MAX_READ) -> tuple[int, str, bool, bool, str | None]:
    """Size, hash of all bytes, binary, truncated, text kept; a megabyte at a time."""
    with guarded(path) as f:
        sha, size, kept, binary = hashlib.sha256(), 0, bytearray(), False
        while chunk := f.read(CHUNK):
            if not size:
                binary = b"\0" in chunk[:PROBE]
            sha.update(chunk)
            size += len(chunk)
            if len(kept) < max_read:
                kept += chunk[: max_read - len(kept)]
    return size, sha.hexdigest(), binary, size > max_read, None if binary else kept.decode("utf-8", "replace")


def entries(root: str, folder: str) -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, reason) of what a folder holds: file, folder, repo (the folder itself, if it holds ``.git``) or skipped.

    Links aren't followed, only regular files are files, and a folder that can't be read is skipped with the reason.
    """
    try:
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError as e:
        yield folder, "skipped", e.strerror or "unreadable"
        return
    for e in found:
        path = os.path.join(folder, e.name)
        if e.name == ".git":
            yield folder, "repo", "pointer" if e.is_symlink() or not e.is_dir() else None
        if e.is_symlink():
            yield path, "skipped", "symlink"
        elif e.is_dir():
            if e.name not in NEVER:
                yield path, "folder", None
        elif e.is_file():
            yield path, "file", None


def walk(spark: SparkSession, root: str, parallel: int = 200) -> DataFrame:
    """``path``, ``kind``, ``reason`` of all that lies under a folder that every executor sees (see :func:`entries`).

    One round a level: the folders of a level are dealt to tasks, and what they list is kept, its folders being the next
    level.  The driver holds no name.
    """
    from treeline.plans.session import kept

    at = os.path.realpath(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["path"]:
                found = entries(at, folder)
                while some := list(itertools.islice(found, 4096)):
                    yield pd.DataFrame(some, columns=["path", "kind", "reason"])

    level, out, n = spark.createDataFrame([("",)], "path string"), None, 0
    while True:
        here = kept(level.repartition(parallel, "path").mapInPandas(run, "path string, kind string, reason string"))
        out = here if out is None else out.unionByName(here)
        level, n = here.filter("kind = 'folder'").select("path"), n + 1
        if level.isEmpty():
            return out
        if n % 16 == 0:
            out = kept(out)


def walked(found: DataFrame, root: str, max_read: int = MAX_READ, parallel: int = 200) -> DataFrame:
    """The files of a walk as raw rows (``SCHEMA``), read by whoever holds their names; skipped ones with the reason."""
    at = os.path.realpath(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, kind, reason in zip(frame["path"], frame["kind"], frame["reason"]):
                if kind == "file":
                    try:
                        row = (path, *content(os.path.join(at, path), max_read), None)
                    except OSError as e:
                        row = (path, None, None, None, None, None, e.strerror or "unreadable")
                else:
                    row = (path, None, None, None, None, None, reason)
                yield pd.DataFrame([row], columns=["path", "bytes", "sha256", "binary", "truncated", "text", "skipped"])

    return found.filter("kind IN ('file', 'skipped')").repartition(parallel, "path").mapInPandas(run, SCHEMA)


def repositories(found: DataFrame) -> DataFrame:
    """``root``, ``pointer`` of the nested repositories of a walk: folders that hold ``.git``, a pointer if that is no folder."""
    return found.filter("kind = 'repo'").select(F.col("path").alias("root"), F.col("reason").isNotNull().alias("pointer"))


class TreeSource(DataSource):
    """``spark.read.format("treeline_tree").load(folder)``: a local checkout, read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "treeline_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _TreeReader(self.options)


def inventory(raw: DataFrame, repos: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Files as rows: path, bytes, loc, language, sha256, class, signals, binary, text, repo.

    ``raw`` comes from :func:`read_tree` or :class:`TreeSource`; ``marks`` (path, mark) from :func:`attribute_marks`.
    """
    files = raw.filter("sha256 IS NOT NULL")
    mark = F.lit(None).cast("string")
    if marks is not None:
        files, mark = files.join(marks, "path", "left"), F.col("mark")
    told = CL.classify(F.col("path"), F.coalesce("text", F.lit("")), mark, F.col("binary"), F.col("truncated"))
    loc = F.when(F.col("binary"), F.lit(-1).cast("long")).otherwise(line_count(F.coalesce("text", F.lit("")), F.col("truncated")))
    out = files.withColumn("__c", told).withColumns({"loc": loc, "language": CL.language(F.col("path"))})
    out = out.select("path", "bytes", "loc", "language", "sha256", F.col("__c.class").alias("class"), F.col("__c.signals").alias("signals"), "binary", "text")
    if repos is None:
        return out.withColumn("repo", F.lit(""))
    from treeline.operators.graph import owner

    return owner(out, repos).withColumnRenamed("owner", "repo")


def attribute_rules(text: str) -> list[tuple[int, str, str]]:
    """(position, pattern, mark) of the lines that mark generated or vendored files; vendored wins on one line."""
    out = []
    for i, line in enumerate(text[:ATTRIBUTES_BYTES].splitlines()):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        for mark in ("vendored", "generated"):
            if f"linguist-{mark}" in words[1:] or f"linguist-{mark}=true" in words[1:]:
                out.append((i, words[0], mark))
                break
    return out


def attribute_marks(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, mark) by the first rule that matches.  ``rules`` (pos, pattern, mark) are one attributes file's,
    limited to a megabyte, so every file may meet all of them."""
    compiled = rules.withColumn("regex", CL.attribute_pattern(F.col("pattern")))
    met = files.select("path").join(F.broadcast(compiled), F.regexp(F.col("path"), F.col("regex")))
    return met.groupBy("path").agg(F.min_by("mark", "pos").alias("mark"))


def repo_roots(root: str) -> list[str]:
    """Folders under ``root`` that hold a ``.git`` entry, relative to it ('' for itself)."""
    found = []
    for folder, folders, names in os.walk(root):
        rel = os.path.relpath(folder, root)
        if ".git" in folders or ".git" in names:
            found.append("" if rel == "." else rel)
        folders[:] = [f for f in folders if f not in NEVER and not os.path.islink(os.path.join(folder, f))]
    return sorted(found)
