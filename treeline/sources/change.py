"""What a change between two commits holds: its paths, its diff, and both sides of each file.

Every reader lists the change's paths by itself and takes those whose hash falls to its partition, so the paths never lie on
the driver.  Git's output is read as it comes; no reader holds more than one file's share of it.  The repository must be
at the same place for all executors.
"""

from __future__ import annotations

import hashlib
import math
import os
import subprocess
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.operators import classify as CL
from treeline.sources.files import CHUNK, MAX_READ, PROBE
from treeline.sources.git import safe_ref

#: Bytes of a file's diff that are shown, bytes of a file that are read, paths listed at once, and the bytes
#: by which a file that can't be read is classed.
DIFF_BYTES, SIDE_BYTES, LISTED, START = 32 << 20, 64 << 20, 500, 64 << 10
#: Files whose diffs one process writes.
DIFFED = 64
MIB = 1 << 20

SET = "path string, status string, from_path string, base_blob string, head_blob string, lines long"
DIFF = "file string, pos long, line string, too_big boolean, added long, removed long, blobs string"
SIDE = "path string, state string, reason string, bytes long, sha256 string, binary boolean, truncated boolean, text string"


class GitError(RuntimeError):
    pass


def _start(repo: str, *args: str, **pipes) -> subprocess.Popen:  # noqa: ANN003
    return subprocess.Popen(["git", "-C", repo, "-c", "core.quotePath=false", *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE if not pipes else subprocess.DEVNULL, **pipes)


def fields(repo: str, *args: str) -> Iterator[str]:
    """The parts of a command's output between zero bytes, as they come; a failure is an error."""
    run, rest = _start(repo, *args), b""
    try:
        while chunk := run.stdout.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\0")
            for part in whole:
                yield part.decode("utf-8", "surrogateescape")
        said = run.stderr.read().decode("utf-8", "replace").strip()
        if run.wait():
            raise GitError(said.splitlines()[0] if said else f"git {args[0]} failed")
    finally:
        run.kill()
        run.wait()


def listed(repo: str, base: str, head: str) -> Iterator[tuple[str, str, str | None, str, str]]:
    """(path, status, old path of a rename, blobs of both sides) of all that differs."""
    parts = fields(repo, "diff", "--raw", "-z", "--no-abbrev", "-M", base, head)
    for entry in parts:
        if not entry.startswith(":"):
            continue
        _, _, old_blob, new_blob, status = entry.split(" ")
        path = next(parts)
        if status[0] == "C":
            next(parts)
        elif status[0] == "R":
            yield next(parts), "R", path, old_blob, new_blob
        else:
            yield path, status[0], None, old_blob, new_blob


def shown(path: str) -> str:
    """A path as text: bytes that aren't UTF-8 become replacement characters."""
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class _Slice(InputPartition):
    def __init__(self, at: int, of: int) -> None:
        super().__init__(at)
        self.at, self.of = at, of

    def holds(self, path: str) -> bool:
        return zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.of == self.at


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.base, self.head = options["repo"], safe_ref(options["base"]), safe_ref(options["head"])
        self.parts = int(options.get("parts", "8"))
        self.options = dict(options)

    def partitions(self) -> list[_Slice]:
        return [_Slice(i, self.parts) for i in range(self.parts)]

    def own(self, part: _Slice) -> list[tuple[str, str, str | None, str, str]]:
        return [x for x in listed(self.repo, self.base, self.head) if part.holds(x[0])]


class _SetReader(_Reader):
    def read(self, partition: _Slice) -> Iterator[tuple]:
        own = {x[0]: x for x in self.own(partition)}
        lines: dict[str, int] = {}
        parts = fields(self.repo, "diff", "--numstat", "-z", "-M", self.base, self.head)
        for part in parts:
            added, removed, path = part.split("\t", 2)
            if not path:  # a rename: both names follow
                next(parts)
                path = next(parts)
            if path in own:
                lines[path] = sum(int(x) for x in (added, removed) if x != "-")
        for path, status, old, a, b in own.values():
            yield shown(path), status, old and shown(old), a, b, lines.get(path, 0)


class _DiffReader(_Reader):
    """A row per line of a file's diff; a file whose diff is too big has one row with the counts in its place."""

    def read(self, partition: _Slice) -> Iterator[tuple]:
        own, limit, context = self.own(partition), int(self.options.get("limit", DIFF_BYTES)), int(self.options.get("context", 6))
        plain = sorted((x for x in own if x[1] != "R"), key=lambda x: x[0].encode("utf-8", "surrogateescape"))
        groups = [(plain[i : i + DIFFED], "--no-renames") for i in range(0, len(plain), DIFFED)]
        groups += [([x], "-M") for x in own if x[1] == "R"]  # alone, so that git pairs no other two
        for group, renames in groups:
            names = [n for x in group for n in (x[0], x[2]) if n]
            # a file that becomes a link, or the reverse, has two sections
            order = [x[0] for x in group for _ in range(2 if x[1] == "T" else 1)]
            yield from self._sections(order, limit, "diff", f"-U{context}", renames, "-O/dev/null", "--no-color", "--no-ext-diff", "--no-textconv", self.base, self.head, "--", *[f":(top,literal){n}" for n in names])

    def _sections(self, order: list[str], limit: int, *args: str) -> Iterator[tuple]:
        run = _start(self.repo, *args, stdin=subprocess.DEVNULL)
        try:
            files = iter(order)
            file, held, size, pos, counts, inside, blobs, fresh = None, [], 0, 0, [0, 0], False, "", True
            while True:
                raw = run.stdout.readline(MIB)
                if not raw or (fresh and raw.startswith(b"diff --git ")):
                    name = next(files, None) if raw else None
                    if not raw or name != file:
                        if file is not None and size > limit:
                            yield shown(file), 0, None, True, *counts, blobs
                        yield from held
                        file, held, size, pos, counts, blobs = name, [], 0, 0, [0, 0], ""
                    inside = False
                    if not raw:
                        break
                if fresh:
                    inside = inside or raw.startswith(b"@@")
                    if inside and raw[:1] in (b"+", b"-"):
                        counts[raw[:1] == b"-"] += 1
                    if not inside and raw.startswith(b"index ") and not blobs:
                        blobs = raw[6:].split()[0].decode()
                size += len(raw)
                if size > limit:
                    held = []
                elif fresh:
                    held.append((shown(file), pos, raw.decode("utf-8", "replace").removesuffix("\n"), False, None, None, None))
                    pos += 1
                else:  # a very long line goes on
                    last = held.pop()
                    held.append((*last[:2], last[2] + raw.decode("utf-8", "replace").removesuffix("\n"), *last[3:]))
                fresh = raw.endswith(b"\n")
            if run.wait():
                raise GitError("git diff failed")
        finally:
            run.kill()
            run.wait()


class _Blobs:
    """One ``git cat-file --batch``, begun anew when it dies of an object."""

    def __init__(self, repo: str) -> None:
        self.repo, self.run = repo, None

    def close(self) -> None:
        if self.run:
            self.run.kill()
            self.run.wait()
            self.run = None

    def get(self, blob: str, limit: int) -> tuple[int, bytes, hashlib._Hash | None] | None:
        """Size, the bytes kept (all that is read of one too large are its first) and the hash of all; None if git can't."""
        if self.run is None:
            self.run = _start(self.repo, "cat-file", "--batch", stdin=subprocess.PIPE)
        try:
            self.run.stdin.write(blob.encode() + b"\n")
            self.run.stdin.flush()
            said = self.run.stdout.readline().split()
        except OSError:
            said = []
        if len(said) != 3 or not said[2].isdigit():
            if not said:
                self.close()
            return None
        size = int(said[2])
        kept, sha, left = bytearray(), hashlib.sha256(), size
        while left:
            chunk = self.run.stdout.read(min(left, CHUNK))
            if not chunk:
                self.close()
                return None
            left -= len(chunk)
            sha.update(chunk)
            most = START if size > limit else MAX_READ
            kept += chunk[: max(most - len(kept), 0)]
        self.run.stdout.read(1)
        return size, bytes(kept), sha


class _SideReader(_Reader):
    """A row per path of the change that one side may have, as that side's commit has it."""

    def read(self, partition: _Slice) -> Iterator[tuple]:
        before, limit = self.options["side"] == "base", int(self.options.get("limit", SIDE_BYTES))
        commit = self.base if before else self.head
        own = [((old or path) if before else path, path) for path, status, old, _, _ in self.own(partition) if status != ("A" if before else "D")]
        blobs = _Blobs(self.repo)
        try:
            for at in range(0, len(own), LISTED):
                batch = own[at : at + LISTED]
                try:
                    tree = dict(self._tree(commit, [source for source, _ in batch]))
                except GitError as e:
                    for _, path in batch:
                        yield shown(path), "unlisted", f"git could not list it: {e}", None, None, None, None, None
                    continue
                for source, path in batch:
                    yield (shown(path), *self._one(tree.get(source), blobs, limit))
        finally:
            blobs.close()

    def _tree(self, commit: str, paths: list[str]) -> Iterator[tuple[str, tuple[str, str, str]]]:
        for entry in fields(self.repo, "--literal-pathspecs", "ls-tree", "--full-tree", "-z", commit, "--", *paths):
            head, path = entry.split("\t", 1)
            mode, kind, blob = head.split(" ")
            yield path, (mode, kind, blob)

    def _one(self, entry: tuple[str, str, str] | None, blobs: _Blobs, limit: int) -> tuple:
        nothing = (None, None, None, None, None)
        if entry is None or entry[1] == "tree":
            return "absent", None, *nothing
        if entry[0] == "120000":
            return "link", "symlink", *nothing
        if entry[1] == "commit":
            return "link", "submodule", *nothing
        got = blobs.get(entry[2], limit)
        if got is None:
            return "unfetched", "git could not read it", *nothing
        size, kept, sha = got
        binary = b"\0" in kept[:PROBE]
        text = None if binary else kept[:MAX_READ].decode("utf-8", "replace")
        if size > limit:
            return "large", f"too large: {math.ceil(size / MIB * 10) / 10:.1f} MiB", size, None, binary, True, text
        return "whole", None, size, sha.hexdigest(), binary, size > MAX_READ, text


class SetSource(DataSource):
    """``treeline_git_change``: a row per path that differs between the options ``base`` and ``head`` of ``repo``."""

    kind, columns = _SetReader, SET

    @classmethod
    def name(cls) -> str:
        return "treeline_git_change"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return self.kind({k: self.options[k] for k in self.options})


class DiffSource(SetSource):
    """``treeline_git_diff``: the lines of the change, by file; further options ``context`` and ``limit``."""

    kind, columns = _DiffReader, DIFF

    @classmethod
    def name(cls) -> str:
        return "treeline_git_diff"


class SideSource(SetSource):
    """``treeline_git_side``: the files of the change on ``side`` (base or head); further option ``limit``."""

    kind, columns = _SideReader, SIDE

    @classmethod
    def name(cls) -> str:
        return "treeline_git_side"


def _load(spark: SparkSession, source: type[SetSource], repo: str, base: str, head: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    got = spark.read.format(source.name()).options(repo=os.path.abspath(repo), base=safe_ref(base), head=safe_ref(head))
    return got.options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def paths(spark: SparkSession, repo: str, base: str, head: str, parts: int = 8) -> DataFrame:
    """``path``, ``status`` (A, D, M, R, T), ``from_path`` of a rename, the blobs of both sides, ``lines`` added and removed."""
    return _load(spark, SetSource, repo, base, head, parts=parts)


def diff(spark: SparkSession, repo: str, base: str, head: str, context: int = 6, limit: int | None = None, parts: int = 8) -> DataFrame:
    """``file``, ``pos`` (in the file's diff), ``line``, and for a diff over the limit a single row without a line, with
    ``too_big``, the lines ``added`` and ``removed``, and ``blobs`` (``base..head``), which tell this change from another."""
    return _load(spark, DiffSource, repo, base, head, context=context, limit=limit, parts=parts)


def side(spark: SparkSession, repo: str, base: str, head: str, which: str, limit: int | None = None, parts: int = 8) -> DataFrame:
    """The change's files as the commit of one side has them, under the path of the head side.

    ``state``: whole, absent, link (a symbolic link or a submodule), large, unfetched, unlisted.  A large file's text is
    its first 64 KiB.
    """
    return _load(spark, SideSource, repo, base, head, side=which, limit=limit, parts=parts)


def raw(side_rows: DataFrame) -> DataFrame:
    """The files of a side that were read whole, as rows that ``files.inventory`` takes."""
    return side_rows.filter("state = 'whole'").select("path", "bytes", "sha256", "binary", "truncated", "text", F.lit(None).cast("string").alias("skipped"))


def class_reason(kind: Column, binary: Column) -> Column:
    """Why a file that could be read has no symbols."""
    return F.when(binary, "binary").when(kind.isin("generated", "vendored"), kind).otherwise("no parser for it")


def states(side_rows: DataFrame, extracts: DataFrame) -> DataFrame:
    """``path``, ``state struct<kind, reason>``, ``link`` (why, if it is one): what a side made of each path.

    Kinds: read; failed, if it should have been parsed and wasn't, or couldn't be listed; skipped, for what it is or for its class,
    which a file that can't be read has from its path and its start; absent.  ``extracts`` has path and reason (null if parsed).
    """
    told = CL.classify(F.col("path"), F.coalesce("text", F.lit("")), F.lit(None).cast("string"), F.coalesce("binary", F.lit(False)), F.coalesce("truncated", F.lit(False)))
    rows = side_rows.withColumn("__class", told["class"]).withColumn("__binary", F.coalesce("binary", F.lit(False)))
    rows = rows.join(extracts.select("path", F.lit(True).alias("__parsed"), F.col("reason").alias("__failed")), "path", "left")
    target = CL.parse_target(F.col("path"), F.col("__class"), F.col("__binary"))
    state, skipped = F.col("state"), class_reason(F.col("__class"), F.col("__binary"))
    as_ = lambda kind, reason=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))
    made = (
        F.when(state == "absent", as_("absent")).when(state == "link", as_("skipped", F.col("reason"))).when(state == "unlisted", as_("failed", F.col("reason")))
        .when(~target, as_("skipped", skipped)).when(state.isin("large", "unfetched"), as_("failed", F.col("reason")))
        .when(F.col("__parsed") & F.col("__failed").isNull(), as_("read")).otherwise(as_("failed", F.coalesce("__failed", F.lit("it was not parsed"))))
    )
    return rows.select("path", made.alias("state"), F.when(state == "link", F.col("reason")).alias("link"))
