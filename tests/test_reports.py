from pyspark.sql import functions as F

from treeline.operators import diff as DF
from treeline.operators import reports as RP
from treeline.plans import ask as AK
from treeline.plans import interpret as IP
from treeline.sources import files as FS


def files(spark):
    rows = [("src/a.py", "needle one\nx = 1\n", "h1", False), ("src/b.py", "Needle\n", "h2", False), (".env", "needle", "h3", False), ("bin", None, "h4", True)]
    return spark.createDataFrame(rows, "path string, text string, sha256 string, binary boolean")


def test_interpretation_is_cached_by_content(spark):
    f = files(spark).filter("path LIKE 'src/%'")
    stops = spark.createDataFrame([("src/a.py", 1, 2), ("src/b.py", 1, 1)], "path string, start long, end long")
    importers = spark.createDataFrame([("src/a.py", 3)], "path string, n long")
    asked = IP.prompts(f, stops, importers)
    cache = asked.filter("path = 'src/a.py'").select("key", F.lit('```json\n[{"start": 1, "end": 2, "what": "w", "why": "y"}]\n```').alias("answer"))
    calls = []

    def provider(df):
        calls.append(df.count())
        return df.select("key", F.lit(None).cast("string").alias("answer"))

    got, failed = IP.answers(asked, cache, provider)
    assert calls == [1] and [r["path"] for r in failed.collect()] == ["src/b.py"]
    assert [(r["path"], r["start"], r["what"]) for r in IP.meanings(asked, got).collect()] == [("src/a.py", 1, "w")]
    assert IP.answers(asked, cache, None)[0].count() == 1
    changed = IP.prompts(f.withColumn("sha256", F.lit("other")), stops, importers)
    assert changed.join(asked, "key").count() == 0
    assert IP.excerpts(f, 12).filter("path = 'src/a.py'").first()["left_out"] == 3


def test_questions(spark):
    f = files(spark)
    assert AK.fetch(f, "src") == "a.py\nb.py" and AK.fetch(f, "../x").startswith("refused") and AK.fetch(f, ".env").startswith("refused")
    assert AK.fetch(f, "bin") == "bin is binary" and AK.search(f, "x").startswith("refused") and AK.search(f, "zzz").startswith("no match")
    assert AK.search(f, "NEEDLE").splitlines()[:2] == [".env:1: needle", "src/a.py:1: needle one"]
    replies = iter(["FETCH: file src/b.py", "it is in src/b.py:1"])
    events = list(AK.ask(f, "where?", {"file": "x" * 9000}, lambda p: next(replies)))
    assert [e for e, _ in events] == ["lookup", "answer"]
    events = list(AK.ask(f, "where?", {}, lambda p: "FETCH: search needle"))
    assert events[-1][0] == "failed" and sum(e == "lookup" for e, _ in events) == AK.LOOKUPS + 1
    cited = AK.cited(f, "see src/b.py:1 and src/none.py", ["src/b.py"]).collect()
    assert sorted((r["path"], r["verdict"]) for r in cited) == [("src/b.py", "supplied"), ("src/none.py", "unknown")]


def test_reports(spark):
    lines = ["diff --git a/f b/f", "@@ -1,1 +1,2 @@ top", " a", "+b"]
    diff = DF.numbered(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos long, line string"))
    assert [r["kind"] for r in RP.diff_payload(diff).orderBy("pos").collect()] == ["hunk", "ctx", "add"]
    calls = spark.createDataFrame([(1, 10, 0.5, True, None), (2, 20, 0.25, True, "x")], "calls long, tokens long, usd double, metered boolean, failure string")
    assert tuple(RP.costs(calls).first()) == (3, 30, 0.75, True, 1) and RP.costs(calls.limit(0)).first()["calls"] == 0
    pages = spark.createDataFrame([("r", i, i) for i in range(6)], "repo string, id long, built_at long")
    assert sorted(r["id"] for r in RP.retained(pages).collect()) == [2, 3, 4, 5]
    notes = spark.createDataFrame([("f", 5, 6, "q", "late"), ("f", 1, 2, None, "early")], "file string, start long, end long, quote string, body string")
    text = RP.notes_markdown(notes).first()["markdown"]
    assert text.index("early") < text.index("late") and "> q" in text
    boxes, edges = RP.system_diagram(spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "layer int, part string"), spark.createDataFrame([("a", "b", 8)], "from string, to string, count long"))
    assert {r["part"]: r["x"] for r in boxes.collect()} == {"a": 0.0, "b": -0.5, "c": 0.5} and edges.first()["stroke"] == 4.0
    one = spark.createDataFrame([("M", None, False, 0.5, 3, 1, 0, 0)], "s string, k string, u boolean, d double, n long, a long, r long, c long")
    words = one.select(RP.change_word(F.col("s"), F.col("k"), F.col("u")), RP.stop_text(F.lit("moved"), F.col("d"), F.col("n"), F.col("a"), F.col("r"), F.col("c"))).first()
    assert tuple(words) == ("modified", "moved · 0.50 · 3 lines · +1 −0 ~0")


def test_attribute_marks(spark):
    rules = FS.attribute_rules("# c\n*.min.css linguist-vendored\ndocs/** linguist-generated=true\n*.css linguist-generated\nx text\n")
    assert rules == [(1, "*.min.css", "vendored"), (2, "docs/**", "generated"), (3, "*.css", "generated")]
    paths = spark.createDataFrame([("a/x.min.css",), ("docs/a/b.md",), ("y.css",), ("z.py",)], "path string")
    got = FS.attribute_marks(paths, spark.createDataFrame(rules, "pos int, pattern string, mark string"))
    assert sorted(map(tuple, got.collect())) == [("a/x.min.css", "vendored"), ("docs/a/b.md", "generated"), ("y.css", "generated")]
