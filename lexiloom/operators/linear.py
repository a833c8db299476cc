"""Linear machines that learn row by row, and probabilities for margins.

Sequential learners go over the rows of a partition one after the other in numpy and meet after each
epoch: the next one begins with the mean of the partitions' weights, each counted by its rows.  On one
partition this is the plain sequential algorithm.  Weights are dense, rows stay sparse; the partitions'
weights are added up in pieces by a shuffle, so that the driver gets one vector an epoch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as ml
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import TableStore

_PIECE = 8192


def sparse_rows(column: pa.Array) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """(indices, values) of each vector as it comes through Arrow; a dense one has all indices."""
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    indices, values = column.field("indices"), column.field("values")
    for kind, i, v in zip(column.field("type").to_pylist(), indices, values, strict=True):
        yield (i.values.to_numpy() if kind == 0 else slice(None)), v.values.to_numpy()


def perceptron_epoch(rows: Iterator[tuple], w: np.ndarray, b: float, seen: int, eta: float = 1.0) -> tuple[float, int, int]:
    """Mistake-driven updates of ``w`` in place: (intercept, rows, mistakes)."""
    n = wrong = 0
    for i, v, y in rows:
        n += 1
        if y * (w[i] @ v + b) <= 0:
            w[i] += eta * y * v
            b += eta * y
            wrong += 1
    return b, n, wrong


def sgd_epoch(rows: Iterator[tuple], w: np.ndarray, b: float, seen: int, alpha: float = 1e-4, loss: str = "hinge") -> tuple[float, int, int]:
    """Stochastic steps of size 1 / (alpha t), t counting from 1 / alpha, with a penalty of alpha / 2 w.w.

    ``w`` is held as a factor times a vector, so that shrinking it costs nothing.
    """
    n, wrong, factor = 0, 0, 1.0
    for i, v, y in rows:
        eta = 1.0 / (1.0 + alpha * (seen + n))
        n += 1
        margin = y * (factor * (w[i] @ v) + b)
        wrong += margin <= 0
        pull = float(margin < 1) if loss == "hinge" else 1 / (1 + math.exp(min(margin, 500.0)))
        factor *= 1 - eta * alpha
        if factor < 1e-9:
            w *= factor
            factor = 1.0
        if pull:
            w[i] += eta * pull * y / factor * v
            b += eta * pull * y
    w *= factor
    return b, n, wrong


@dataclass
class Sequential:
    """Estimator on ``features`` and ``label`` (0 or 1): ``epochs`` of ``step`` over all partitions, until no row is wrong or ``patience`` epochs bring no fewer mistakes.

    The best epoch's weights are the model's.  Without ``shuffle`` rows come in the table's order.
    """

    step: object
    options: dict
    epochs: int = 50
    patience: int = 5
    seed: int = 42
    shuffle: bool = True
    logistic: bool = False

    def fit(self, df: DataFrame) -> ml.LinearSVCModel:
        spark = df.sparkSession
        rows = df.select("features", F.when(F.col("label") == 1, 1).otherwise(-1).alias("y"))
        if self.shuffle:
            rows = rows.withColumn("_order", F.rand(self.seed)).sortWithinPartitions("_order").drop("_order")
        with TableStore(spark) as store:
            data = store.table("rows", "all", lambda: rows)  # written once: the order and the partitions stay
            first = data.select("features").first()
            if first is None:
                raise ValueError("there is no row to learn from")
            size = first[0].size
            w, b, seen, best, since = np.zeros(size), 0.0, 0, None, 0
            for _ in range(self.epochs):
                total, n, wrong = self._epoch(data, w, b, seen)
                if best is None or wrong < best[2]:
                    best, since = (total[:-1], total[-1], wrong), 0
                else:
                    since += 1
                w, b, seen = total[:-1], total[-1], seen + n
                if not wrong or since >= self.patience:
                    break
        return self._model(spark, *best[:2])

    def _epoch(self, data: DataFrame, w: np.ndarray, b: float, seen: int) -> tuple[np.ndarray, int, int]:
        """Mean weights with the intercept last, rows of the largest partition and mistakes of all."""
        step, options = self.step, self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = w.copy()

            def rows():
                for batch in batches:
                    yield from ((i, v, y) for (i, v), y in zip(sparse_rows(batch.column(0)), batch.column(1).to_pylist(), strict=True))

            bias, n, wrong = step(rows(), mine, b, seen, **options)
            if n:
                flat = np.append(mine, bias) * n
                pieces = [flat[k : k + _PIECE] for k in range(0, len(flat), _PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64())), pa.array([n] * len(pieces), pa.int64()), pa.array([wrong] * len(pieces), pa.int64())], ["piece", "v", "n", "wrong"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                for piece, v, n, wrong in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = held.setdefault(piece, [0.0, 0, 0, 0])
                    at[0], at[1], at[2], at[3] = at[0] + np.array(v), at[1] + n, max(at[2], n), at[3] + wrong
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h[0] / h[1] for h in held.values()], pa.list_(pa.float64())), pa.array([h[2] for h in held.values()], pa.int64()), pa.array([h[3] for h in held.values()], pa.int64())], ["piece", "v", "n", "wrong"])

        kind = "piece int, v array<double>, n long, wrong long"
        got = sorted(data.mapInArrow(run, kind).repartition("piece").mapInArrow(meet, kind).toArrow().to_pylist(), key=lambda r: r["piece"])
        return np.concatenate([np.array(r["v"]) for r in got]), got[0]["n"], got[0]["wrong"]

    def _model(self, spark, w: np.ndarray, b: float):
        kind, of = ("LogisticRegressionModel", ml.LogisticRegressionModel) if self.logistic else ("LinearSVCModel", ml.LinearSVCModel)
        made = getattr(spark._jvm.org.apache.spark.ml.classification, kind)(f"{kind}_{self.seed}", _py2java(spark.sparkContext, DenseVector(w)), float(b))
        return of(made)


def fourier_size(tolerance: float, miss: float = 0.01) -> int:
    """Random Fourier features that keep a kernel value's error within ``tolerance`` but for a chance of ``miss``.

    A value is a mean of terms between -2 and 2, so Hoeffding's bound holds: 2 exp(-size tolerance^2 / 8).
    """
    return math.ceil(8 * math.log(2 / miss) / tolerance**2)


def fit_sigmoid(margins: DataFrame) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a margin + b))) that fits (margin, label) best.

    Labels are drawn towards the middle by a row a class, so that separable margins have an end.
    """
    n = margins.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    if not n[0] or not n[1]:
        raise ValueError("a sigmoid needs rows of both classes")
    target = F.when(F.col("label") == 1, (n[0] + 1.0) / (n[0] + 2.0)).otherwise(1.0 / (n[1] + 2.0))
    both = margins.withColumn("t", target).select(array_to_vector(F.array("margin")).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("t")).alias("w")))).alias("s"))
    m = ml.LogisticRegression(weightCol="w", regParam=0.0, maxIter=200, tol=1e-10).fit(both.select("features", "s.label", "s.w"))
    return float(m.coefficients[0]), float(m.intercept)


@dataclass
class CalibratedSVM:
    """RBF machine with probabilities: random Fourier features, a linear machine, and a sigmoid of margins held out in ``folds``."""

    project: object
    machine: Callable[[int], object]  # of the number of rows, by which ``C`` is weighed
    folds: int = 3
    seed: int = 42

    def fit(self, df: DataFrame) -> CalibratedModel:
        with TableStore(df.sparkSession) as store:
            fold = F.floor(F.rand(self.seed) * self.folds).cast("int")
            data = store.table("rows", "all", lambda: self.project.transform(df.select("features", F.col("label").cast("double").alias("label"), *(c for c in ("weight",) if c in df.columns))).withColumn("fold", fold))
            machine, held = self.machine(data.count()), None
            for k in range(self.folds):
                inside, outside = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
                if inside.select("label").distinct().count() < 2:
                    continue
                m = margins(machine.fit(inside).transform(outside)).select("margin", "label")
                held = m if held is None else held.union(m)
            final = machine.fit(data)
            held = margins(final.transform(data)).select("margin", "label") if held is None else held
            a, b = fit_sigmoid(store.table("margins", "all", lambda: held))
        return CalibratedModel(self.project, final, a, b)


def margins(scored: DataFrame) -> DataFrame:
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1])


@dataclass
class CalibratedModel:
    project: object
    machine: object
    a: float
    b: float

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_pred``, the probability of class 1."""
        scored = margins(self.machine.transform(self.project.transform(df)))
        return scored.withColumn("y_pred", 1 / (1 + F.exp(-(self.a * F.col("margin") + self.b)))).select(*df.columns, "y_pred")

    def save(self, path: str) -> None:
        self.machine.write().overwrite().save(f"{path}/machine")
        SparkSession.getActiveSession().createDataFrame([(self.a, self.b)], "a double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/sigmoid")


def load_calibrated(spark: SparkSession, path: str, project) -> CalibratedModel:
    """What ``CalibratedModel.save`` wrote; the projection follows from its options."""
    row = spark.read.parquet(f"{path}/sigmoid").first()
    return CalibratedModel(project, ml.LinearSVCModel.load(f"{path}/machine"), row["a"], row["b"])
