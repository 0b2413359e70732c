"""Embedding whitening: covariance by one aggregation over all dimension pairs, decomposed by LAPACK.

Entries become integers (``floor(scale * c)``), so sums and deviations are exact.  The covariance is over each distinct
vector once, so a vector that many rows hold weighs as one.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import shared_dir

#: Production parameters: steps per unit, components returned, products summed by one aggregation, partial rows per sum.
SCALE, COMPONENTS, PRODUCTS, FAN = 256, 4, 8192, 64
#: Eigenvalues under this share of the greatest one are rounding: their directions hold no variance.
NOTHING = 1e-12


class Fit(NamedTuple):
    """What the fit list says: its size, sums by dimension, covariance, eigenvalues and unit eigenvectors (columns), falling."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` with ``x array<long>``, without the rows that can't be whitened.

    These are null vectors and those with a null or non-finite entry or one beyond 64 bits; further, vectors without
    entries, and those that have another number of entries than most have (of equally common numbers, the greatest):
    they lack entries, or have some that others lack.
    """
    c = F.col(vector).cast("array<double>")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(2**63)))  # infinities are beyond 64 bits
    whole = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(good)
    lengths = whole.groupBy(F.size(vector).alias("__d")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max_by("__d", F.struct("n", "__d")).alias("d")).first()["d"]
    return whole.filter(F.size(vector) == F.lit(most)).withColumn("x", F.transform(c, lambda v: F.floor(v * scale).cast("long")))


def summed(rows: DataFrame, exprs: list[str]) -> list:
    """Sums of SQL expressions over all rows; of no rows, zeros.

    One aggregation gives a row for each of ``FAN`` parts of the partitions, so that no task gets a row per partition;
    these few rows, as wide as the expressions are many, are added here.
    """
    part = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("__part")).agg(*[F.expr(f"sum({e})").alias(f"s{i}") for i, e in enumerate(exprs)])
    parts = [r[1:] for r in part.collect()]
    return [(math.fsum if isinstance(own[0], float) else sum)(own) for own in zip(*parts)] if parts else [0] * len(exprs)


def centred(x: str, means: list[float]) -> list[Column]:
    """A column ``c0 .. `` per dimension: the entry less its mean."""
    return [(F.col(x)[i].cast("double") - F.lit(m)).alias(f"c{i}") for i, m in enumerate(means)]


def fit(distinct: DataFrame, d: int) -> Fit:
    """Fits on ``distinct`` (x): two aggregations, of the sums and of the centred products of the upper triangle.

    Beyond ``PRODUCTS`` pairs of dimensions, the triangle takes several aggregations over the same rows.
    """
    n, *sums = summed(distinct, ["1", *[f"x[{i}]" for i in range(d)]])
    means = [s / n for s in sums]
    rows = distinct.select(*centred("x", means))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    products: list[float] = []
    for at in range(0, len(pairs), PRODUCTS):
        products += summed(rows, [f"c{i} * c{j}" for i, j in pairs[at : at + PRODUCTS]])
    covariance = np.zeros((d, d))
    for (i, j), p in zip(pairs, products):
        covariance[i, j] = covariance[j, i] = p / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])  # the largest entry is positive
    return Fit(n, sums, covariance, np.maximum(values, 0.0), vectors * flip)


def projections(f: Fit, components: int) -> list[Column]:
    """A column ``w1 ..`` per component, of the columns that ``centred`` makes; null where there is no variance."""
    out = []
    for k in range(components):
        if f.values[k] <= NOTHING * f.values[0]:
            out.append(F.lit(None).cast("double").alias(f"w{k + 1}"))
            continue
        terms = " + ".join(f"c{i} * {float(v)!r}D" for i, v in enumerate(f.vectors[:, k]))
        out.append((F.expr(terms) / F.lit(float(np.sqrt(f.values[k])))).alias(f"w{k + 1}"))
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row per vector
    that ``quantised`` keeps and component, at most as many as dimensions.

    The key may be null or repeated; repeated rows are repeated.  Where vectors have no variance in a component's
    direction (one distinct vector, or fewer than dimensions), ``whitened`` is null, and so is ``explained`` if there is none
    at all; ``identity_error`` measures the other components.  ``deviation`` is null where it exceeds 64 bits.  An empty
    table gives no rows.  Of other columns none is read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), "v", scale).select("id", "x")
    at = f"{shared_dir(spark).rstrip('/')}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(at)  # read three times, and by whoever takes over a lost executor's work
    distinct = spark.read.parquet(at)
    first = distinct.select(F.size("x").alias("d")).first()
    if first is None:
        kind = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (p.split() for p in kind.split(", "))]).limit(0)
    f = fit(distinct, first["d"])
    means, many = [s / f.n for s in f.sums], min(components, first["d"])
    done = distinct.select(*centred("x", means)).select(*projections(f, many))
    real = [k for k in range(many) if f.values[k] > NOTHING * f.values[0]]
    pairs = [(i, j) for i in real for j in real if i <= j]
    sums = summed(done, [f"w{i + 1} * w{j + 1}" for i, j in pairs]) if pairs else []
    error = max((abs(s / f.n - (i == j)) for (i, j), s in zip(pairs, sums)), default=None)

    trace = float(np.trace(f.covariance))
    terms = []
    for i, s in enumerate(f.sums):
        gap = F.try_subtract(F.try_multiply(F.lit(f.n).cast("long"), F.col("x")[i]), F.lit(s).cast("long"))
        terms.append(F.try_multiply(gap, gap))
    deviation = terms[0]
    for t in terms[1:]:
        deviation = F.try_add(deviation, t)
    out = rows.select("id", deviation.alias("deviation"), *centred("x", means)).select("id", "deviation", *projections(f, many))
    each = F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(float(f.values[k]) / trace if trace > 0 else None).cast("double").alias("explained"))
        for k in range(many)
    ]))
    return out.select("id", "deviation", each.alias("c")).select(
        "id", "c.component", F.lit(f.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error")
    )
