"""Prompts and verdicts of a change's files."""

from treeline.plans import verdicts as V


def tables(spark, **changes):
    row = {"path": "a.py", "base_blob": "b1", "head_blob": "h1", "what": "keeps time", "line": "+x"} | changes
    changed = spark.createDataFrame([(row["path"], row["base_blob"], row["head_blob"]), ("lone.py", "b", "h")], "path string, base_blob string, head_blob string")
    lines = spark.createDataFrame([(row["path"], i, row["line"] + str(i)) for i in range(3)], "file string, pos long, line string")
    edges = spark.createDataFrame([(f"f{i:02d}", "a.py") for i in range(row.get("users", 14))], "from string, to string")
    meanings = spark.createDataFrame([(row["path"], row["what"], None)], "path string, what string, why string")
    return {r["path"]: r for r in V.prompts(changed, lines, edges, meanings, row.get("writer")).collect()}


def test_prompts_and_what_keys_depend_on(spark):
    got = tables(spark)
    named = ", ".join(f"f{i:02d}" for i in range(12))
    assert got["a.py"]["prompt"] == f"File a.py.\n\nBefore this change: keeps time\n\nImported by 14 files: {named} and 2 more.\n\nThe diff:\n+x0\n+x1\n+x2\n\n{V.ASK}"
    assert "Nothing imports it.\n\nThe diff:\n(none is shown)" in got["lone.py"]["prompt"] and len(got["a.py"]["key"]) == 32
    others = [tables(spark, **c)["a.py"]["key"] for c in ({"base_blob": "b2"}, {"head_blob": "h2"}, {"what": "other"}, {"users": 3}, {"writer": "w"})]
    assert len({got["a.py"]["key"], *others}) == 6 and tables(spark)["a.py"]["key"] == got["a.py"]["key"]


def test_long_diffs_are_cut(spark):
    lines = spark.createDataFrame([("a", i, "y" * 700) for i in range(40)] + [("b", 0, "z" * 20_000), ("c", 0, "s")], "file string, pos long, line string")
    got = {r["path"]: r["diff"] for r in V.shown_diffs(lines).collect()}
    assert got["a"] == "\n".join(["y" * 700] * 40)[:9000] + "\n… (more follows)" and got["b"] == "z" * 9000 + "\n… (more follows)" and got["c"] == "s"


def test_no_provider_and_no_cache_say_nothing_about_change(spark):
    asked = spark.createDataFrame([("k", "a.py", "?")], "key string, path string, prompt string")
    none = asked.selectExpr("key", "prompt AS answer").limit(0)
    row = V.judged(asked, none, None).first()
    assert (row["source"], row["magnitude"], row["kind"], row["changed"]) == ("unavailable", 0.5, "unclear", False)
    assert V.verdicts(V.judged(asked, none, None)).count() == 0
    broken = spark.createDataFrame([("k", "no answer")], "key string, answer string")
    fresh = V.judged(asked, broken, lambda rows: rows.selectExpr("key", """'{"kind": "surface", "magnitude": 0.4}' AS answer""")).first()
    assert (fresh["source"], fresh["magnitude"], fresh["kind"], fresh["changed"], fresh["headline"]) == ("model", 0.4, "surface", True, "no headline was given")
