"""Batched fits against single ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import stability as sb


def single(x, y, C=1.0):
    """Newton's steps of one standardised logistic fit."""
    std = x.std(0)
    z = np.concatenate([(x - x.mean(0)) / np.where(std > 0, std, 1), np.ones((len(x), 1))], 1)
    pen, b = np.append(np.ones(x.shape[1]), 0) / C, np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.lstsq(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pen), z.T @ (p - y) + pen * b, rcond=None)[0]
    return b[:-1]


def test_all_at_once_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 4)) * [1, 5, 0.1, 0] + [0, 3, 0, 2], 3)
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=120) > 0.3).astype(int)
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(120) for j in range(4) if x[i, j]] + [(500, "f0", 9.0), (3, None, 1.0), (3, "f1", None)]
    features = spark.createDataFrame(rows, "source long, name string, value double").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(600, None), (601, 7)], "source long, y int")
    limits = sb.thresholds(spark.range(120).withColumnRenamed("id", "source"), 6, 0.7, 42)
    hashes = spark.range(120).select("id", F.array(*(F.xxhash64("id", F.lit(r), F.lit(42)) for r in range(6))).alias("h")).orderBy("id").collect()
    drawn = np.array([[r["h"][k] <= limits[k] for k in range(6)] for r in hashes])
    assert drawn.sum(0).tolist() == [84] * 6 and len({tuple(d) for d in drawn.T}) == 6
    fits = sb.replicate_fits(features.drop("y"), labels, replicates=6)
    got = np.zeros((6, 4))
    for r in fits.collect():
        got[r["replicate"], int(r["name"][1])] = r["coef"]
    want = np.array([single(x[d], y[d]) for d in drawn.T])
    assert np.abs(got - want).max() < 1e-6
    table = {r["name"]: r for r in sb.coefficient_stability(fits).collect()}
    assert np.allclose([table[f"f{j}"]["mean"] for j in range(4)], want.mean(0), atol=1e-6) and np.allclose([table[f"f{j}"]["std"] for j in range(4)], want.std(0, ddof=1), atol=1e-6)
    assert table["f0"]["same_sign"] == 1


def test_defined_cases(spark):
    features = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "source long, name string, value double")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "source long, y int")
    assert {r["coef"] for r in sb.replicate_fits(features, labels, 3).collect()} == {None}
    assert sb.replicate_fits(features.limit(0), labels, 3).count() == 0 == sb.replicate_fits(features, labels.limit(0), 3).count()
    wide = spark.range(300).select(F.lit(1).cast("long").alias("source"), F.col("id").cast("string").alias("name"), F.lit(1.0).alias("value"))
    with pytest.raises(ValueError, match="256"):
        sb.replicate_fits(wide, labels)
