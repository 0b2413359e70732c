"""The walk over a tree by levels, and reads that nothing can be slipped under."""

import os

import pytest

from treeline.sources import files as FS


@pytest.fixture
def tree(tmp_path):
    at = tmp_path / "tree"
    for name, body in {"a.py": b"x = 1\n", "src/deep/er/b.ts": b"let b\n", "src/bin": b"a\0b", ".hidden/_c.md": b"c", "node_modules/x.js": b"x", "inner/.git/HEAD": b"ref", "inner/d.py": b"d", "linked/.git": b"gitdir: x", "odd \n name.txt": b""}.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(body)
    os.symlink("a.py", at / "link.py")
    os.symlink("src", at / "folder")
    os.mkfifo(at / "pipe")
    return at


def test_walk_equals_the_listing_of_one_task(spark, tree):
    found = FS.walk(spark, str(tree), parallel=3)
    spark.dataSource.register(FS.TreeSource)
    want = spark.read.format("treeline_tree").load(str(tree))
    key = lambda df: sorted(map(str, df.select("path", "bytes", "sha256", "binary", "truncated", "text", "skipped").collect()))
    got = FS.walked(found, str(tree), parallel=3)
    assert key(got) == key(want)
    assert {r["path"]: r["skipped"] for r in got.filter("skipped IS NOT NULL").collect()} == {"link.py": "symlink", "folder": "symlink"}
    assert sorted(map(tuple, FS.repositories(found).collect())) == [("inner", False), ("linked", True)]
    assert FS.walk(spark, str(tree / "nothing")).select("kind").collect()[0]["kind"] == "skipped"


def test_guarded_reads(tree):
    assert FS.read_guarded(str(tree / "a.py"), 100) == b"x = 1\n" and FS.read_guarded(str(tree / "a.py"), 5) is None
    for name in ("link.py", "folder", "pipe", "src", "gone"):
        assert FS.read_guarded(str(tree / name), 100) is None, name


@pytest.mark.parametrize("swap", ["link", "other", "pipe", "larger"])
def test_a_file_swapped_before_it_is_opened(tree, monkeypatch, swap):
    path, opened = str(tree / "a.py"), os.open

    def late(p, flags, *more):
        if p == path:
            if swap == "larger":
                with open(path, "ab") as f:
                    f.write(b"y" * 200)
            else:
                os.replace(path, path + ".old")
                {"link": lambda: os.symlink("src/bin", path), "other": lambda: (tree / "a.py").write_bytes(b"x"), "pipe": lambda: os.mkfifo(path)}[swap]()
        return opened(p, flags, *more)

    monkeypatch.setattr(os, "open", late)
    assert FS.read_guarded(path, 100) is None
    if swap != "larger":
        monkeypatch.setattr(os, "open", opened)
        os.remove(path)
        os.replace(path + ".old", path)
        monkeypatch.setattr(os, "open", late)
        with pytest.raises(OSError):
            FS.content(path)
