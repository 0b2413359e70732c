from pyspark.sql import functions as F

from treeline.operators import intervals as IV


def test_a_stop_looks_for_its_blank_lines_once(spark):
    rows = spark.createDataFrame([(1, 100, [50]), (1, 60, [30]), (1, 140, [44, 45, 96]), (1, 200, []), (10, 120, [12, 118]), (1, 135, [45, 90])], "s int, e int, blanks array<int>")
    df = rows.select("s", "e", IV.sections(F.col("s") + 0, F.col("e") + 0, F.col("blanks")).alias("x"))
    got = [[(p["start"], p["end"]) for p in r["x"]] for r in df.collect()]
    assert got == [[(1, 50), (51, 100)], [(1, 60)], [(1, 45), (46, 96), (97, 140)], [(1, 200)], [(10, 120)], [(1, 45), (46, 90), (91, 135)]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1
