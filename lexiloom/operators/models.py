"""Classifiers, grids, greedy search and cross-validation over Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml import classification as ml
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash
from . import linear as li
from .features import join_terms


def naive_bayes_log_odds(train: DataFrame, labels: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(source, log_odds) of class 1 against 0 by multinomial naive Bayes on ``(source, term, n)`` tables."""
    seen = stash(train.join(labels, "source").groupBy("term", "y").agg(F.sum("n").cast("double").alias("n")), "class_counts")
    grid = seen.select("term").distinct().crossJoin(F.broadcast(labels.select("y").distinct())).join(seen, ["term", "y"], "left").na.fill(0, ["n"])
    total = F.broadcast(grid.groupBy("y").agg(F.sum("n").alias("t"), F.count("*").alias("v")))
    lp = F.log((F.col("n") + alpha) / (F.col("t") + alpha * F.col("v")))
    odds = grid.join(total, "y").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, lp).otherwise(-lp)).alias("d"), F.sum("n").alias("_n"))
    prior = F.broadcast(labels.agg(F.log(F.count_if(F.col("y") == 1) / F.count_if(F.col("y") == 0)).alias("prior")))
    return join_terms(test, odds.withColumnRenamed("_n", "_all"), "_all").groupBy("source").agg(F.sum(F.col("n") * F.col("d")).alias("s")).crossJoin(prior).select("source", (F.col("prior") + F.col("s")).alias("log_odds"))


def naive_bayes_probabilities(counts: DataFrame, folds: DataFrame, terms: int, alphas: tuple[float, ...] = (1.0,), held: int | None = None) -> DataFrame:
    """(alpha, fold, source, y_true, y_pred): class 1's probability by multinomial naive Bayes of the other folds, for each smoothing.

    ``counts(source, label, fold, term, n)``, ``folds(source, label, fold)``; ``terms`` is the number of all terms, those
    that training rows lack included; ``held`` names the one fold to predict, else all are.  As Spark's estimator has it,
    which smooths the classes' shares too; but all folds and smoothings are one plan, without a vector.  A term's training
    counts of each fold are one row, made by one grouping; its sources' odds are the difference from a term without counts.
    """
    tests = [held] if held is not None else sorted(r["fold"] for r in folds.select("fold").distinct().collect()) or [0]  # a few folds
    one = folds.sparkSession.range(1, numPartitions=1)
    ids = F.broadcast(one.select(F.explode(F.array(*(F.lit(k).cast("int") for k in tests))).alias("held")))
    smooth = F.broadcast(one.select(F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha")))
    of = lambda y, k, v: F.sum(F.when((F.col("label") == y) & (F.col("fold") != k), v).otherwise(0)).cast("double")
    sizes = folds.groupBy("fold", "label").agg(F.count("*").alias("k")).crossJoin(ids).groupBy("held").agg(*(of(y, F.col("held"), F.col("k")).alias(f"k{y}") for y in (0, 1)))
    totals = counts.groupBy("fold", "label").agg(F.sum("n").alias("n")).crossJoin(ids).groupBy("held").agg(*(of(y, F.col("held"), F.col("n")).alias(f"t{y}") for y in (0, 1)))
    a = F.col("alpha")
    base = F.log((F.coalesce("t0", F.lit(0.0)) + a * terms) / (F.coalesce("t1", F.lit(0.0)) + a * terms))
    base = F.broadcast(sizes.join(totals, "held", "left").crossJoin(smooth).select("alpha", "held", F.log((F.col("k1") + a) / (F.col("k0") + a)).alias("_prior"), base.alias("_unseen")))
    rows = counts.groupBy("term").agg(F.array(*(F.struct(of(0, k, F.col("n")).alias("n0"), of(1, k, F.col("n")).alias("n1")) for k in tests)).alias("_by"), F.sum("n").alias("_all"))
    place = F.array_position(F.array(*map(F.lit, tests)), F.col("fold")).cast("int")
    met = join_terms(counts.where(F.col("fold").isin(tests)).select("source", "term", "n", "fold"), rows, "_all").select("source", "n", F.element_at("_by", place).alias("c"))
    d = [F.col("n") * (F.log(F.col("c.n1") + float(x)) - F.log(F.col("c.n0") + float(x))) for x in alphas]
    sums = met.groupBy("source").agg(F.array(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in d)).alias("_d"), F.sum("n").alias("_n"))
    known = folds.where(F.col("fold").isin(tests)).join(sums.hint("shuffle_hash"), "source", "left")
    each = known.select("fold", "source", F.col("label").cast("double").alias("y_true"), F.coalesce("_n", F.lit(0)).alias("_n"), F.posexplode(F.coalesce("_d", F.array(*(F.lit(0.0) for _ in alphas)))).alias("_i", "_d"))
    each = each.withColumn("alpha", F.array(*(F.lit(float(x)) for x in alphas))[F.col("_i")]).withColumnRenamed("fold", "held").join(base, ["alpha", "held"])
    log_odds = F.col("_prior") + F.col("_d") + F.col("_n") * F.col("_unseen")
    return each.select("alpha", F.col("held").alias("fold"), "source", "y_true", (0.5 * (1 + F.tanh(log_odds / 2))).alias("y_pred"))


def to_vectors(features: DataFrame, size: int, key: str = "idx", value: str = "n") -> DataFrame:
    """(source, features): sparse vectors of a long table; one row a source, as estimators want it."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = features.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("int").alias("i"), F.col(value).cast("double").alias("v")))).alias("p"))

    @F.udf(VectorUDT())
    def sparse(indices, values):
        return SparseVector(size, indices, values)

    return rows.select("source", sparse(F.col("p.i"), F.col("p.v")).alias("features"))


def stash_vectors(sources: DataFrame, features: DataFrame, size: int, tag: str, key: str = "idx", value: str = "n") -> DataFrame:
    """``sources`` with ``features``, sparse vectors of a long table, empty where it has no row of a source; as a table.

    The vectors are written as the plain fields that Spark keeps them in and read as vectors: no row passes through Python.
    """
    from pyspark.ml.linalg import VectorUDT

    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("int").alias("i"), F.col(value).cast("double").alias("v"))))
    rows = sources.join(features.groupBy("source").agg(pairs.alias("_p")), "source", "left")
    fields = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.coalesce("_p.i", F.array().cast("array<int>")).alias("indices"), F.coalesce("_p.v", F.array().cast("array<double>")).alias("values"))
    return stash(rows.select(*sources.columns, fields.alias("features")), tag, sources.schema.add("features", VectorUDT()))


def with_empty(df: DataFrame, size: int) -> DataFrame:
    """``df`` with an empty vector where ``features`` is null: a source none of whose terms the vocabulary holds."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    empty = F.udf(lambda: SparseVector(size, [], []), VectorUDT())
    return df.withColumn("features", F.coalesce("features", empty()))


class BoostedTrees:
    """SAMME boosting of weighted decision trees for two classes; each round reweights in one pass."""

    def __init__(self, n_estimators: int = 50, max_depth: int = 1, learning_rate: float = 1.0, seed: int = 42):
        self.n, self.depth, self.rate, self.seed = n_estimators, max_depth, learning_rate, seed

    def fit(self, df: DataFrame) -> BoostedModel:
        from math import log

        data, trees = stash(df.select("features", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("w")), "boost"), []
        for i in range(self.n):
            tree = ml.DecisionTreeClassifier(maxDepth=self.depth, weightCol="w", seed=self.seed + i).fit(data)
            scored = tree.transform(data).select("features", "label", "w", (F.col("prediction") != F.col("label")).alias("miss"))
            wrong, total = scored.agg(F.sum(F.when(F.col("miss"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
            err = wrong / total
            if err >= 0.5:
                break
            alpha = self.rate * log((1 - err) / max(err, 1e-10))
            trees.append((alpha, tree))
            if err <= 1e-10:
                break
            data = stash(scored.select("features", "label", (F.col("w") * F.when(F.col("miss"), F.exp(F.lit(alpha))).otherwise(1.0)).alias("w")), "boost")
        return BoostedModel(trees)


@dataclass
class BoostedModel:
    trees: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_pred``, the trees' weighted share of votes for class 1."""
        out, total = df.withColumn("_s", F.lit(0.0)), sum(a for a, _ in self.trees) or 1.0
        for a, tree in self.trees:
            out = tree.transform(out).withColumn("_s", F.col("_s") + a * F.col("prediction")).drop("prediction", "rawPrediction", "probability")
        return out.withColumn("y_pred", F.col("_s") / total).drop("_s")


class RandomFourier(Transformer):
    """Random Fourier features of an RBF kernel, so that a linear machine separates as a kernel one does."""

    def __init__(self, gamma: float = 0.1, size: int = 128, seed: int = 42):
        super().__init__()
        self.gamma, self.size, self.seed = gamma, size, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = self.gamma, self.size, self.seed

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            rng = np.random.default_rng(seed)
            w, b = rng.normal(0, np.sqrt(2 * gamma), (rows.shape[1], size)), rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2 / size) * np.cos(rows @ w + b)))

        return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def classifier(name: str, seed: int = 42, **kw):
    """An estimator with ``features`` and ``label`` for each name of ``CLASSIFIERS``."""
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; one of {sorted(CLASSIFIERS)}")
    return CLASSIFIERS[name](seed, **kw)


def _logistic(seed: int, C: float = 1.0, n: int = 1, weightCol: str | None = None, max_iter: int = 100):
    """``C`` scales the data term, so the penalty a row is 1 / (C n)."""
    return ml.LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter, **({"weightCol": weightCol} if weightCol else {}))


def _linear_svm(seed: int, C: float = 1.0, n: int = 1, max_iter: int = 50, weightCol: str | None = None):
    return ml.LinearSVC(regParam=1.0 / (C * max(n, 1)), standardization=False, maxIter=max_iter, **({"weightCol": weightCol} if weightCol else {}))


def _svm(seed: int, C: float = 1.0, n: int | None = None, kernel: str = "rbf", gamma: float = 0.1, tolerance: float = 0.2, weightCol: str | None = None):
    return li.CalibratedSVM(kernel_features(seed, kernel, gamma, tolerance), lambda rows: _linear_svm(seed, C, n or rows, weightCol=weightCol), seed=seed)


class AsTheyAre(Transformer):
    """The features of a linear kernel."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df


def kernel_features(seed: int, kernel: str = "rbf", gamma: float = 0.1, tolerance: float = 0.2) -> Transformer:
    if kernel not in ("rbf", "linear"):
        raise ValueError("kernel must be 'rbf' or 'linear'")
    return RandomFourier(gamma, li.fourier_size(tolerance), seed) if kernel == "rbf" else AsTheyAre()


CLASSIFIERS: dict[str, Callable] = {
    "logistic": _logistic,
    "linear_svm": _linear_svm,
    "svm": _svm,
    "perceptron": lambda seed, eta0=1.0, max_iter=50, shuffle=True: li.Sequential(li.perceptron_epoch, {"eta": eta0}, max_iter, seed=seed, shuffle=shuffle),
    "sgd": lambda seed, alpha=1e-4, loss="hinge", max_iter=50, shuffle=True: li.Sequential(li.sgd_epoch, {"alpha": alpha, "loss": loss}, max_iter, seed=seed, shuffle=shuffle, logistic=loss == "log"),
    "naive_bayes": lambda seed, alpha=1.0: ml.NaiveBayes(modelType="multinomial", smoothing=alpha),
    "decision_tree": lambda seed, max_depth=5, min_samples_leaf=1: ml.DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, seed=seed),
    "random_forest": lambda seed, n_estimators=100, max_depth=5: ml.RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth, seed=seed),
    "adaboost": lambda seed, n_estimators=50, learning_rate=1.0: BoostedTrees(n_estimators, 1, learning_rate, seed),
    "gradient_boosting": lambda seed, n_estimators=50, max_depth=3, learning_rate=0.1: ml.GBTClassifier(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, seed=seed),
    "mlp": lambda seed, layers=(0, 100, 2), max_iter=100: ml.MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=max_iter),
}
#: Names whose fits take class weights.
WEIGHTED = {"logistic", "linear_svm", "svm"}
#: Names whose models give probabilities.
PROBABILISTIC = {"logistic", "svm", "naive_bayes", "decision_tree", "random_forest", "adaboost", "gradient_boosting", "mlp"}
DEFAULT_GRIDS: dict[str, dict[str, list]] = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0]},
    "linear_svm": {"C": [0.01, 0.1, 1.0, 10.0]},
    "naive_bayes": {"alpha": [0.01, 0.1, 1.0]},
    "random_forest": {"n_estimators": [50, 100], "max_depth": [5, 10]},
    "decision_tree": {"max_depth": [3, 5, 10]},
    "adaboost": {"n_estimators": [10, 50]},
    "gradient_boosting": {"n_estimators": [20, 50], "max_depth": [3, 5]},
}


def grid(options: dict[str, list]) -> list[dict]:
    """All combinations, in the order of the options."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def predict(model, df: DataFrame) -> DataFrame:
    """(source, y_pred): probability of class 1, or the class if the model has none."""
    out = model.transform(df)
    if "y_pred" in out.columns:
        return out.select("source", "y_pred")
    if "probability" in out.columns:
        return out.select("source", vector_to_array("probability")[1].alias("y_pred"))
    return out.select("source", F.col("prediction").alias("y_pred"))


def class_weights(df: DataFrame, weights: dict[int, float] | str = "balanced") -> DataFrame:
    if weights == "balanced":
        sizes = df.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_n"))
        sizes = sizes.select("_label", (F.sum("_n").over(Window.partitionBy(F.lit(0))) / (2.0 * F.col("_n"))).alias("weight"))  # one row a class
        return df.drop("weight").join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return df.withColumn("weight", F.coalesce(*(F.when(F.col("label") == k, float(v)) for k, v in weights.items()), F.lit(1.0)))


@dataclass
class Stage:
    """A step of the greedy search: candidate options, the first best of which is kept if no worse than before."""

    name: str
    candidates: list


def greedy_search(stages: list[Stage], score: Callable[[list], float]) -> tuple[list, list[tuple[list, float]]]:
    """Add a stage's best candidate while the score doesn't fall; returns the choice and all results."""
    chosen, best, results = [], float("-inf"), []
    for stage in stages:
        tried = [(c, score([*chosen, c])) for c in stage.candidates]
        results += [([*chosen, c], s) for c, s in tried]
        c, s = max(tried, key=lambda x: x[1])  # the first of equals
        if s >= best:
            chosen, best = [*chosen, c], s
    return chosen, results


def grid_search(train: DataFrame, dev: DataFrame, name: str, options: dict[str, list], score: Callable[[DataFrame], float], seed: int = 42):
    """(best model, results): fits every combination on ``train`` and scores its predictions for ``dev``."""
    results, best = [], None
    for params in grid(options):
        model = classifier(name, seed, **params).fit(train)
        s = score(predict(model, dev).join(dev.select("source", F.col("label").alias("y_true")), "source"))
        results.append((params, s))
        if best is None or s > best[1]:
            best = (model, s)
    return best[0], results


def cross_validate(df: DataFrame, folds: int, fit: Callable[[DataFrame], object], fold_col: str = "fold") -> DataFrame:
    """(fold, source, y_true, y_pred) of each fold predicted by a model of the others."""
    out = None
    for k in range(1, folds + 1):
        dev = df.where(F.col(fold_col) == k)
        p = predict(fit(df.where(F.col(fold_col) != k)), dev).join(dev.select("source", F.col("label").alias("y_true")), "source")
        p = p.select(F.lit(k).alias("fold"), "source", "y_true", "y_pred")
        out = p if out is None else out.union(p)
    return out


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
