"""The readers of a change on a real repository: each state of a side, bounds, renames, links and odd names."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from treeline.operators import delta as D
from treeline.operators import graph as G
from treeline.plans import review as RV
from treeline.sources import change as CH

ENV = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}


def git(at, *args):
    return subprocess.run(["git", "-C", str(at), *args], check=True, env=ENV, capture_output=True).stdout.decode().strip()


def save(at, message):
    git(at, "add", "-A")
    git(at, "commit", "-qm", message)
    return git(at, "rev-parse", "HEAD")


def write(at, files):
    for name, text in files.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(text if isinstance(text, bytes) else text.encode())


FUNCTION = "def {0}(a):\n    b = a + 1\n    c = b * 2\n    return c - a\n\n\ndef {0}_two(a):\n    return a\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("change")
    subprocess.run(["git", "init", "-q", "-b", "main", str(at)], check=True, env=ENV)
    write(at, {
        "src/a.py": FUNCTION.format("a"), "src/uses.py": "from src.a import a\n", "src/far.py": "from src.uses import x\n", "src/moved.py": FUNCTION.format("moved"), "src/gone.py": "class Gone:\n    kind = 1\n    size = 2\n    name = 3\n    more = 4\n    rest = 5\n    last = 6\n    end = 7\n", "big.py": "x = 1\n", "wide.txt": "one\n",
        "turned.py": "y = 1\n", "notes.md": "words\n", "[odd] *name?.py": "z = 1\n", "src/ü ber.py": "u = 1\n", "image.bin": b"a\0b", "vendor/lib.py": "v = 1\n", "same.py": "s = 1\n", "mode.sh": "echo\n",
    })
    save(at, "first")
    git(at, "checkout", "-qb", "change")
    write(at, {
        "src/a.py": FUNCTION.format("a") + "\n\ndef fresh():\n    return 3\n", "src/new.py": FUNCTION.format("new"), "big.py": "x = 2\n" + "# filler line\n" * 9000, "wide.txt": "one" * 3000 + "\nlast\n",
        "notes.md": "other\nwords\n", "[odd] *name?.py": "z = 2\n", "src/ü ber.py": "u = 2\n", "image.bin": b"a\0c", "vendor/lib.py": "v = 2\n",
    })
    os.rename(at / "src/moved.py", at / "src/here.py")
    os.remove(at / "src/gone.py")
    os.remove(at / "turned.py")
    os.symlink("same.py", at / "turned.py")
    os.chmod(at / "mode.sh", 0o755)
    save(at, "second")
    git(at, "checkout", "-q", "main")
    return at


def of(df, *columns):
    return {r["path"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_paths(spark, repo):
    got = of(CH.paths(spark, str(repo), "main", "change", parts=3), "status", "from_path", "lines")
    assert got == {
        "src/a.py": ("M", None, 4), "src/new.py": ("A", None, 8), "src/gone.py": ("D", None, 8), "src/here.py": ("R", "src/moved.py", 0), "big.py": ("M", None, 9002), "wide.txt": ("M", None, 3), "turned.py": ("T", None, 2),
        "notes.md": ("M", None, 1), "[odd] *name?.py": ("M", None, 2), "src/ü ber.py": ("M", None, 2), "image.bin": ("M", None, 0), "vendor/lib.py": ("M", None, 2), "mode.sh": ("M", None, 0),
    }
    with pytest.raises(ValueError):
        CH.paths(spark, str(repo), "--output=x", "main")
    with pytest.raises(Exception, match="bad revision|unknown revision"):
        CH.paths(spark, str(repo), "nowhere", "main").collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_diff_equals_git_file_by_file(spark, repo, parts):
    rows = CH.diff(spark, str(repo), "main", "change", parts=parts).collect()
    files = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        files.setdefault(r["file"], []).append(r["line"])
    for path, (status, old, _) in of(CH.paths(spark, str(repo), "main", "change"), "status", "from_path", "lines").items():
        names = [f":(top,literal){n}" for n in (path, old) if n]
        want = git(repo, "-c", "core.quotePath=false", "diff", "-U6", "-M", "main", "change", "--", *names).split("\n")
        assert files[path] == want, path
    assert not any(r["too_big"] for r in rows)


def test_one_file_too_big_to_show(spark, repo):
    rows = CH.diff(spark, str(repo), "main", "change", limit=20_000).collect()
    big = [r for r in rows if r["too_big"]]
    blobs = of(CH.paths(spark, str(repo), "main", "change"), "base_blob", "head_blob")["big.py"]
    assert [(r["file"], r["line"], r["added"], r["removed"]) for r in big] == [("big.py", None, 9001, 1)]
    assert all(b.startswith(x) for b, x in zip(blobs, big[0]["blobs"].split("..")))
    assert [r for r in rows if r["file"] == "big.py"] == big and {r["file"] for r in rows} >= {"src/a.py", "wide.txt"}


def sides(spark, repo, which, **options):
    side = CH.side(spark, str(repo), "main", "change", which, **options)
    return {r["path"]: (r["state"]["kind"], r["state"]["reason"], r["link"]) for r in CH.states(side, RV.extracted(CH.raw(side))).collect()}


def test_states(spark, repo):
    base, head = sides(spark, repo, "base"), sides(spark, repo, "head", limit=50_000)
    assert base["src/a.py"] == head["src/a.py"] == ("read", None, None) and base["src/here.py"][0] == "read"  # read where it was, told where it is
    assert "src/new.py" not in base and "src/gone.py" not in head and base["src/gone.py"][0] == "read"
    assert base["turned.py"][0] == "read" and head["turned.py"] == ("skipped", "symlink", "symlink")
    assert head["big.py"] == ("failed", "too large: 0.2 MiB", None)
    assert head["notes.md"] == ("skipped", "no parser for it", None) and head["image.bin"][:2] == ("skipped", "binary") and head["vendor/lib.py"][:2] == ("skipped", "vendored")
    assert head["[odd] *name?.py"][0] == head["src/ü ber.py"][0] == "read"


def test_large_side_of_a_class_that_is_never_parsed(spark, repo):
    head = sides(spark, repo, "head", limit=3)
    assert head["notes.md"] == ("skipped", "no parser for it", None) and head["vendor/lib.py"][:2] == ("skipped", "vendored")
    assert head["image.bin"][:2] == ("skipped", "no parser for it") or head["image.bin"][:2] == ("skipped", "binary")
    assert head["src/a.py"][0] == "failed" and head["src/a.py"][1].startswith("too large")


def test_unfetched_and_unlisted(spark, repo, tmp_path):
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", str(repo), str(copy)], check=True)
    blob = git(copy, "rev-parse", "change:src/a.py")
    os.remove(copy / ".git/objects" / blob[:2] / blob[2:])
    broken = git(copy, "rev-parse", "change:src/ü ber.py")
    at = copy / ".git/objects" / broken[:2] / broken[2:]
    os.chmod(at, 0o644)
    at.write_bytes(b"not an object")
    head = sides(spark, copy, "head")
    assert head["src/a.py"] == ("failed", "git could not read it", None) and head["src/ü ber.py"][0] == "failed" and head["src/here.py"][0] == "read"
    tree = git(copy, "rev-parse", "change:src")
    reader = CH._SideReader({"repo": str(copy), "base": "main", "head": "change", "side": "head", "parts": "1"})
    reader.own = lambda part: [("src/a.py", "M", None, "", ""), ("src/new.py", "A", None, "", "")]
    os.remove(copy / ".git/objects" / tree[:2] / tree[2:])
    assert [(r[0], r[1]) for r in reader.read(CH._Slice(0, 1))] == [("src/a.py", "unlisted"), ("src/new.py", "unlisted")]
    schema = spark.createDataFrame(list(reader.read(CH._Slice(0, 1))), CH.SIDE)
    assert {r["state"]["kind"] for r in CH.states(schema, RV.extracted(CH.raw(schema))).collect()} == {"failed"}


def test_unread_sides_rule(spark):
    kinds = [("read", None), ("failed", "f"), ("skipped", "s"), ("absent", None)]
    rows = [(b, h, t) for b in kinds for h in kinds for t in "MT"]
    df = spark.createDataFrame(rows, "b struct<kind:string,reason:string>, h struct<kind:string,reason:string>, t string")
    link = lambda c: F.when(F.col(f"{c}.kind") == "skipped", F.lit("symlink"))
    got = df.select("*", D.link_sides(D.unread(F.col("b"), F.col("h")), F.col("t"), link("b"), link("h")).alias("u")).collect()
    for r in got:
        def told(one, other):
            if one["kind"] == "failed" or (one["kind"] == "skipped" and other["kind"] in ("read", "failed")):
                return one["reason"]
            return "symlink" if r["t"] == "T" and one["kind"] == "skipped" else None
        want = told(r["b"], r["h"]), told(r["h"], r["b"])
        assert (tuple(r["u"]) if r["u"] else (None, None)) == want


def test_review_of_a_change(spark, repo):
    edges = spark.createDataFrame([("src/uses.py", "src/a.py"), ("src/far.py", "src/uses.py")], "from string, to string")
    first = git(repo, "rev-parse", "main")
    out = RV.review(spark, str(repo), "main", "change", edges, checkpoint=first, side_bytes=50_000, diff_bytes=20_000)
    deltas = {r["path"]: r for r in out["deltas"].collect()}
    assert deltas["src/a.py"]["added"] == ["fresh"] and deltas["src/a.py"]["meaning_delta"] >= 0.5 and deltas["src/here.py"]["status"] == "R"
    assert deltas["big.py"]["sides"]["head"].startswith("too large") and deltas["big.py"]["basis"] == "unread" and deltas["big.py"]["added"] is None
    assert tuple(deltas["turned.py"]["sides"]) == (None, "symlink") and deltas["notes.md"]["sides"] is None
    assert [tuple(r) for r in out["too_big"].select("file", "added", "removed").collect()] == [("big.py", 9001, 1)]
    assert {(r["path"], r["hop"]) for r in out["ripple"].collect()} >= {("src/uses.py", 1), ("src/far.py", 2)}
    assert tuple(out["staleness"].select("behind", "overlap", "current").first()) == (0, [], True)
    told = [(r["chapter"], r["file"], r["text"]) for r in out["notices"].orderBy("ordinal").collect()]
    assert told == [
        ("what", "big.py", "2 files were not read: big.py on the head side: too large: 0.2 MiB, turned.py on the head side: symlink"),
        ("ripple", "src/uses.py", "1 file imports what moved here, unchanged; 1 more lie beyond."),
    ]


def test_a_stale_checkpoint(spark, repo):
    """The base gains a change to a file that the branch changes as well."""
    first = git(repo, "rev-parse", "main")
    git(repo, "checkout", "-q", "main")
    write(repo, {"notes.md": "words\nmore\n", "same.py": "s = 2\n"})
    save(repo, "third")
    edges = spark.createDataFrame([], "from string, to string")
    out = RV.review(spark, str(repo), "main", "change", edges, checkpoint=first)
    assert tuple(out["staleness"].select("sha", "behind", "overlap", "current").first()) == (first, 1, ["notes.md"], False)
    notice = out["notices"].filter("ordinal = 0").first()
    assert notice["file"] == "notes.md" and notice["text"] == "The digest is 1 commit behind the base, and 1 file changed here changed there as well."
    ahead = RV.unseen(spark, str(repo), git(repo, "rev-parse", "change"), first, CH.paths(spark, str(repo), first, "change")).first()
    assert ahead["behind"] == 0 and ahead["overlap"] == []
    assert RV.unseen(spark, str(repo), None, "main", CH.paths(spark, str(repo), first, "change")).first()["sha"] is None
    assert G.ripple(edges.select(F.col("to").alias("path")), edges).count() == 0
