"""Whitening against numpy, and on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, many=4):
    """Fit list, exact deviations and projections by numpy; rows are (id, vector)."""
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows], dtype=np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :many] / np.sqrt(values[:many]), values / values.sum()


def held(got, rows, many=4):
    n, deviation, white, explained = plain(rows, many)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    signs = None
    for (i, _), d, w in zip(rows, deviation, white):
        own = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, many + 1)) and {r["n"] for r in own} == {n} and {r["deviation"] for r in own} == {int(d)}
        assert np.allclose([r["explained"] for r in own], explained[:many], rtol=1e-9) and {r["identity_error"] < 1e-9 for r in own} == {True}
        signs = np.sign([r["whitened"] for r in own] * w) if signs is None else signs
        assert np.allclose([r["whitened"] for r in own] * signs, w, atol=1e-9)


@pytest.mark.parametrize("products", [3, 8192])
def test_query(spark, sf, monkeypatch, products):
    if products == 3:  # the triangle in several aggregations, on few dimensions
        monkeypatch.setattr(whitening, "PRODUCTS", products)
        rng = np.random.default_rng(1)
        rows = [(i, [float(x) for x in rng.normal(size=5) * [1, 2, 3, 4, 5]]) for i in range(60)]
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("id", "vec_id").collect()
    else:
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        got = queries.op12_embedding_whitening(spark, sf).collect()
    assert len(got) == 4 * len(rows)
    held(got, rows)


def test_copies_weigh_once_and_bad_vectors_go(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(20)]
    copies = [(100 + i, good[0][1]) for i in range(50)]
    nan, inf = float("nan"), float("inf")
    bad = [(200, None), (201, []), (202, [1.0] * 5 + [None]), (203, [nan] + [1.0] * 5), (204, [1.0, -inf] + [1.0] * 4), (205, [1e300] * 6), (206, [1.0] * 7)]
    df = spark.createDataFrame(good + copies + bad, SCHEMA).withColumns({"x": F.lit(1), "id": F.lit("a"), "component": F.lit(2)})
    got = whitening.whiten(df).withColumnRenamed("id", "vec_id").collect()
    held(got, good + copies)
    assert {r["n"] for r in got} == {20} and not {r["vec_id"] for r in got} & set(range(200, 210))


def test_null_and_repeated_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(None, [float(x) for x in rng.normal(size=3)]), (1, [0.5, 0.0, -0.5]), (1, [0.5, 0.0, -0.5]), (2, [1.0, 2.0, 0.0]), (3, [0.0, 1.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 * len(rows) and max(r["component"] for r in got) == 3


def test_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], SCHEMA)).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: r["component"])] == [False] * 3 + [True] * 3
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 and r["identity_error"] < 1e-12 for r in line)


def test_deviation_beyond_64_bits(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0])], SCHEMA)).collect()
    assert all(r["deviation"] is None and r["whitened"] is not None for r in got if r["id"] < 3 and r["component"] == 1)


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
