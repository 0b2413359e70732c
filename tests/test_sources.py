"""Fingerprints, forms of a change, and snapshots that can't be written."""

import os
import subprocess

import pytest

from treeline.sources import git, snapshots


def test_fingerprint_without_git(tmp_path):
    at = tmp_path / "plain"
    (at / "a/b/c/d/e").mkdir(parents=True)
    (at / ".hidden").mkdir()
    for name in ("a/x.py", "a/b/c/d/e/deep.py", ".hidden/y.py"):
        (at / name).write_text("1")
    first = git.fingerprint(str(at))
    assert first and len(first) == 24 and git.fingerprint(str(at)) == first
    os.utime(at / ".hidden/y.py", (4e9, 4e9))
    os.utime(at / "a/b/c/d/e/deep.py", (4e9, 4e9))
    assert git.fingerprint(str(at)) == first  # hidden, and too deep
    os.utime(at / "a/x.py", (4e9, 4e9))
    assert git.fingerprint(str(at)) != first and git.fingerprint(str(tmp_path / "nothing")) is None


def test_exactly_one_form_of_a_change(tmp_path):
    repo = str(tmp_path)
    subprocess.run(["git", "init", "-q", "-b", "main", repo], check=True)
    subprocess.run(["git", "-C", repo, "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    sha = git.facts(repo)["head"]
    assert git.compared(repo, "main", "HEAD") == (sha, sha)
    for wrong in ({"base": "main", "head": "HEAD", "number": 3}, {"number": 3}, {"base": "main"}, {"head": "main"}, {}, {"base": "--output=x", "head": "main"}, {"base": "nowhere", "head": "main"}):
        with pytest.raises(ValueError):
            git.compared(repo, **wrong)


def test_a_snapshot_that_cannot_be_written_is_told(spark, tmp_path):
    relations = {"files": spark.range(3)}
    assert snapshots.try_write(relations, str(tmp_path / "kept"), "s1") is None and snapshots.read(spark, str(tmp_path / "kept"), "s1")["files"].count() == 3
    (tmp_path / "elsewhere").mkdir()
    os.symlink(tmp_path / "elsewhere", tmp_path / "linked")
    assert snapshots.try_write(relations, str(tmp_path / "linked"), "s1").endswith("is a link") and not os.listdir(tmp_path / "elsewhere")
    (tmp_path / "file").write_text("not a folder")
    assert snapshots.try_write(relations, str(tmp_path / "file"), "s1")
    broken = {"files": spark.range(3), "odd": spark.range(1).selectExpr("raise_error('no disk') AS x")}
    assert "no disk" in snapshots.try_write(broken, str(tmp_path / "half"), "s1")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "half"), "s1")
