"""The distance of two texts' claims, made in one pass of a task."""

import itertools
import time

from against import compare
from pyspark.sql import functions as F

from treeline import queries as Q
from treeline.operators import delta as D

ODD = ["", "and", "---", "-and- and-and --x--and--y--", "Sand_x sandX SandXy SANDx andA0 and0A _and and_", "thandat onTheHeon on-the-heon THANDAT x-thandat-y", "été and naïve ünder and\ttide", "the and of with"]


def test_distances_of_odd_words_equal_the_sql(spark, tmp_path):
    made = ["".join(x) for n in range(1, 5) for x in itertools.product(["and", "A", "0", "_", "-", "é"], repeat=n)]
    rows = list(enumerate([None, *ODD, *[f"{w} tide {w}" for w in made]]))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    at = tmp_path / "tables"
    at.mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(at / "documents.parquet")
    compare(spark, str(at), Q.meaning_distances, Q.SQL["meaning_distances"])


def test_distance_of_texts_is_that_of_their_claims(spark):
    rows = [(a, b, ["thandat", "onTheHeon", None], ["sand", "tide", None]) for a in [None, *ODD] for b in [None, *ODD, "sand tide sand"]]
    df = spark.createDataFrame(rows, "a string, b string, n array<string>, v array<string>")
    df = df.withColumn("one", D.text_distance(F.col("a"), F.col("b"), F.col("n"), F.col("v")))
    df = D.add_claims(D.add_claims(df, "x", F.col("a"), F.col("n"), F.col("v")), "y", F.col("b"), F.col("n"), F.col("v"))
    for r in df.select("a", "b", "one", D.meaning_distance(F.col("x"), F.col("y")).alias("two")).collect():
        assert r["one"] == (r["two"] if r["a"] is not None and r["b"] is not None else None), r


def test_texts_meet_in_one_step(spark, sf):
    """Both texts are cut into words in one step of Python, not by expressions for each word."""
    plan = Q.meaning_distances(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "split(" not in plan


def test_claims_take_time_in_proportion():
    """A word of many underscores, and many words spelled as code, are each read once."""
    n, at = 300_000, time.process_time()
    assert not D.identifiers(b"_" * n) and list(D.identifiers(b"a_" * n + b"a")) == ["a_" * n + "a"]
    assert list(D.identifiers(b"aB " * n)) == ["ab"] and list(D.identifiers(b"x " * n + b"aB")) == ["ab"]
    assert time.process_time() - at < 10
