"""Names held by texts, against Python's ``in``."""

import random

from treeline.operators import delta as D
from treeline.operators.contain import holding


def test_against_in(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abc.", k=rng.randint(1, 9))) for _ in range(60)} | {"src/part1.py", "src/part12.py", "ü", "no such name"})
    texts = [(i, "".join(rng.choices("abc. ", k=rng.randint(0, 40)))) for i in range(40)] + [(90, "see src/part12.python"), (91, None), (92, ""), (93, "für")]
    got = holding(spark.createDataFrame(texts, "pos long, text string"), spark.createDataFrame([(n,) for n in [*names, "", None, names[0]]], "name string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, n) for i, t in texts for n in names if n in (t or ""))
    assert holding(got.selectExpr("pos", "name AS text"), got.select("name").limit(0)).collect() == []


def test_why_meets_parts_of_words(spark):
    files = spark.createDataFrame([("src/core.py",), ("src/run.py",), ("lib/a.b.ts",), ("other.py",)], "path string")
    commits = [(0, "s0", "\nprerun.py without a subject"), (1, "s1", "rework the hardcored paths\n\nmore"), (2, "s2", "core.py again"), (3, "s3", " prerun.pyc \nx"), (4, "s4", "touch a.b")]
    got = D.why(files, spark.createDataFrame(commits, "pos long, sha string, message string"))
    assert {r["path"]: (r["why"], r["why_sha"]) for r in got.collect()} == {
        "src/core.py": ("rework the hardcored paths", "s1"), "src/run.py": ("prerun.pyc", "s3"), "lib/a.b.ts": (None, None), "other.py": (None, None),
    }
