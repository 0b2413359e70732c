"""Facts of git repositories as tables; one task per repository."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG = "repo string, pos long, sha string, date string, subject string, message string, path string, status string, old_path string"


def git(repo: str, *args: str) -> str | None:
    """Output of a git command in a repository, or None if it fails."""
    got = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    return got.stdout.decode("utf-8", "replace") if got.returncode == 0 else None


def safe_ref(ref: str) -> str:
    if not ref or ref.startswith("-"):
        raise ValueError(f"not a ref: {ref!r}")
    return ref


def facts(repo: str) -> dict:
    """Head, branch (None where unknown) and number of commits."""
    head, branch, count = git(repo, "rev-parse", "HEAD"), git(repo, "rev-parse", "--abbrev-ref", "HEAD"), git(repo, "rev-list", "--count", "HEAD")
    return {"head": head and head.strip(), "branch": branch and branch.strip(), "commit_count": int(count or 0)}


def fingerprint(repo: str, own: str = ".treeline", depth: int = 4) -> str | None:
    """24 hex digits from the head and what differs from it, the digest's own folder aside.

    Without git, from the newest time of change of what lies at most ``depth`` folders below, hidden names and
    ``node_modules`` aside; None if there is nothing to look at.
    """
    import hashlib

    head, dirty = git(repo, "rev-parse", "HEAD"), git(repo, "status", "--porcelain", "--", ".", f":(exclude){own}")
    if dirty is not None:
        return hashlib.sha256(f"{head or ''}{dirty}".encode()).hexdigest()[:24]
    newest = max(_times(repo, own, depth), default=None)
    return None if newest is None else hashlib.sha256(str(newest).encode()).hexdigest()[:24]


def _times(folder: str, own: str, depth: int) -> Iterator[int]:
    try:
        found = list(os.scandir(folder))
    except OSError:
        return
    for e in found:
        if e.name.startswith(".") or e.name in ("node_modules", own):
            continue
        try:
            yield e.stat().st_mtime_ns
            if depth and e.is_dir():
                yield from _times(e.path, own, depth - 1)
        except OSError:
            continue


def compared(repo: str, base: str | None = None, head: str | None = None, number: int | None = None) -> tuple[str, str]:
    """The commits of a change that is named by its two refs, and by nothing else.

    Exactly one form is taken: a number together with refs, or one ref alone, is an error, and so is a ref that names no
    commit.  Looking a number up needs a network, so that form is refused by name.
    """
    if number is not None and (base or head):
        raise ValueError("give either a number or two refs, not both")
    if number is not None:
        raise ValueError(f"change {number} can't be looked up here: give its two refs")
    if not base or not head:
        raise ValueError("give both refs of the change")
    found = []
    for name, ref in (("base", base), ("head", head)):
        sha = git(repo, "rev-parse", "--verify", "--quiet", f"{safe_ref(ref)}^{{commit}}")
        if not sha:
            raise ValueError(f"the {name} {ref!r} names no commit")
        found.append(sha.strip())
    return found[0], found[1]


def is_dirty(repo: str) -> bool:
    return bool(git(repo, "status", "--porcelain"))


def name_status(raw: str) -> Iterator[tuple[str, str, str | None]]:
    """(status, path, old path) from ``--name-status -z``; copies are dropped."""
    parts = iter(raw.split("\0"))
    for status in parts:
        if not status:
            continue
        if status[0] in "RC":
            old, new = next(parts), next(parts)
            if status[0] == "R":
                yield "R", new, old
        else:
            yield status[0], next(parts), None


class _Repo(InputPartition):
    def __init__(self, repo: str) -> None:
        super().__init__(repo)
        self.repo = repo


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repos = options["repos"].split("\n")
        self.range = options.get("range", "HEAD")

    def partitions(self) -> list[_Repo]:
        return [_Repo(r) for r in self.repos]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        """A row per commit and path, oldest first, of all commits; a commit without paths, or a merge, has one row with none."""
        form = "--format=%x01%H%x00%cs%x00%s%x00%B%x00"
        raw = git(partition.repo, "log", "--reverse", "--name-status", "-M", "-z", form, safe_ref(self.range)) or ""
        for pos, block in enumerate(raw.split("\x01")[1:]):
            sha, date, subject, message, rest = block.split("\0", 4)
            paths = list(name_status(rest.lstrip("\n\0"))) or [(None, None, None)]
            for status, path, old in paths:
                yield partition.repo, pos, sha, date, subject, message.strip(), path, status, old


class LogSource(DataSource):
    """``spark.read.format("treeline_git_log").option("repos", ...).load()``: commits with the paths they touch."""

    @classmethod
    def name(cls) -> str:
        return "treeline_git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _LogReader(self.options)


def log(spark: SparkSession, repos: list[str], revisions: str = "HEAD") -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.read.format("treeline_git_log").option("repos", "\n".join(repos)).option("range", revisions).load()


def churn(commits: DataFrame) -> DataFrame:
    """How many commits touch each path."""
    return commits.filter("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("churn"))


def first_commits(commits: DataFrame) -> DataFrame:
    """Per path, the first commit that added it or renamed another to it."""
    born = commits.filter("status IN ('A', 'R')")
    return born.groupBy("path").agg(F.min_by(F.struct("sha", "date", "subject"), "pos").alias("w")).select("path", "w.*")


def diff_set(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """Paths that differ between two commits: path, status, from_path, lines (see :mod:`treeline.sources.change`)."""
    from treeline.sources import change

    return change.paths(spark, repo, base, head).select("path", "status", "from_path", "lines")


def merge_base(repo: str, base: str, head: str) -> str:
    """The commit to compare with: the merge base where there is one, else the base."""
    got = git(repo, "merge-base", safe_ref(base), safe_ref(head))
    return (got or git(repo, "rev-parse", base) or base).strip()
