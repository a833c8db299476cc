"""Sequential learners against plain loops, calibrated machines against uncalibrated ones."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors

from lexiloom.operators import linear as li
from lexiloom.operators import models as mo


def table(spark, x, y, parts):
    rows = [(i, SparseVector(x.shape[1], np.flatnonzero(v).tolist(), v[v != 0].tolist()) if i % 3 else Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), ["source", "features", "label"])


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(90, 5)) * (rng.random((90, 5)) < 0.7), 3)
    return x, (x @ [1.0, -2.0, 0.5, 0.0, 1.0] + 0.1 > 0).astype(int)


def test_perceptron_is_the_plain_loop_on_one_partition(spark, points):
    x, y = points
    model = mo.classifier("perceptron", max_iter=4, shuffle=False).fit(table(spark, x, y, 1))
    w, b, best = np.zeros(5), 0.0, None
    for _ in range(4):
        wrong = 0
        for v, t in zip(x, 2 * y - 1):
            if t * (w @ v + b) <= 0:
                w, b, wrong = w + t * v, b + t, wrong + 1
        if best is None or wrong < best[2]:
            best = (w.copy(), b, wrong)
    assert np.allclose(model.coefficients.toArray(), best[0]) and model.intercept == pytest.approx(best[1])


@pytest.mark.parametrize("loss", ["hinge", "log"])
def test_sgd_is_the_plain_loop_on_one_partition(spark, points, loss):
    x, y = points
    alpha, w, b, k, best = 0.01, np.zeros(5), 0.0, 0, None
    model = mo.classifier("sgd", alpha=alpha, loss=loss, max_iter=3, shuffle=False).fit(table(spark, x, y, 1))
    for _ in range(3):
        wrong = 0
        for v, t in zip(x, 2 * y - 1):
            eta, m = 1 / (1 + alpha * k), t * (w @ v + b)
            k, wrong = k + 1, wrong + (m <= 0)
            g = float(m < 1) if loss == "hinge" else 1 / (1 + np.exp(m))
            w, b = (1 - eta * alpha) * w + eta * g * t * v, b + eta * g * t
        if best is None or wrong < best[2]:
            best = (w.copy(), b, wrong)
    assert np.allclose(model.coefficients.toArray(), best[0]) and model.intercept == pytest.approx(best[1])


@pytest.mark.parametrize("name", ["perceptron", "sgd"])
def test_partitions_meet(spark, points, name):
    x, y = points
    df = table(spark, x, y, 4)
    got = mo.predict(mo.classifier(name, max_iter=12).fit(df), df).join(df, "source")
    assert got.where("y_pred = label").count() >= 0.93 * len(y)
    with pytest.raises(ValueError, match="no row"):
        mo.classifier(name).fit(df.limit(0))


def test_calibrated_rbf(spark, tmp_path):
    """Rings, which no line parts, with a tenth of the labels turned: probabilities are better than margins through a fixed sigmoid."""
    rng = np.random.default_rng(7)
    angle, radius = rng.uniform(0, 2 * np.pi, 240), np.where(np.arange(240) % 2, 1.0, 3.0) + 0.2 * rng.normal(size=240)
    x, y = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1), np.arange(240) % 2
    y = np.where(rng.random(240) < 0.1, 1 - y, y)
    train, test = table(spark, x[:160], y[:160], 2), table(spark, x[160:], y[160:], 2)
    model = mo.classifier("svm", gamma=0.5, C=1.0, n=160).fit(train)
    got = mo.predict(model, test).join(test, "source").collect()
    raw = li.margins(model.machine.transform(model.project.transform(test))).select("source", "margin").collect()
    truth, p = {r["source"]: r["label"] for r in got}, {r["source"]: r["y_pred"] for r in got}
    assert all(0 <= v <= 1 for v in p.values()) and np.mean([(p[i] > 0.5) == t for i, t in truth.items()]) > 0.8
    brier = lambda q: np.mean([(q[i] - t) ** 2 for i, t in truth.items()])
    assert brier(p) < brier({r["source"]: 1 / (1 + np.exp(-r["margin"])) for r in raw})
    model.save(f"file://{tmp_path}/svm")
    again = li.load_calibrated(spark, f"file://{tmp_path}/svm", mo.kernel_features(42, gamma=0.5))
    assert {r["source"]: r["y_pred"] for r in mo.predict(again, test).collect()} == pytest.approx(p)


def test_fourier_features_keep_the_kernel():
    """The bound holds for all but its share of pairs."""
    assert li.fourier_size(0.2) == 1060
    rng = np.random.default_rng(8)
    x, size, gamma = rng.normal(size=(60, 4)), li.fourier_size(0.2), 0.3
    z = np.sqrt(2 / size) * np.cos(x @ rng.normal(0, np.sqrt(2 * gamma), (4, size)) + rng.uniform(0, 2 * np.pi, size))
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    assert (np.abs(z @ z.T - kernel) > 0.2).mean() <= 0.01


def test_sigmoid_of_separable_margins_has_an_end(spark):
    a, b = li.fit_sigmoid(spark.createDataFrame([(float(m), float(m > 0)) for m in (-3, -2, -1, 1, 2, 3)], "margin double, label double"))
    assert 0 < a < 20 and abs(b) < 1e-3
    with pytest.raises(ValueError, match="both"):
        li.fit_sigmoid(spark.createDataFrame([(1.0, 1.0)], "margin double, label double"))
