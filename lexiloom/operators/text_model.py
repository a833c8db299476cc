"""One object from posts to predictions: vocabulary, selection, features, scaling and classifier.

Whatever is learned lives in small tables: the vocabulary, inverse document frequencies, feature
names and their scales.  ``save`` writes them beside the classifier, ``load`` reads them back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

from pyspark.ml import classification as ml
from pyspark.ml.clustering import LDA, DistributedLDAModel, LocalLDAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stash
from ..sources.store import TableStore, digest, fingerprint
from . import features as fe
from . import models as mo
from .linear import load_calibrated
from .ranking import position
from .selection import Selector
from .vocabulary import Vocabulary

#: Feature families and their options.
FAMILIES = {"bag_of_words": (), "tfidf": (), "liwc": ("norm",), "glove": ("how", "dim"), "lda": ("k", "max_iter", "seed", "doc_prior", "topic_prior")}


@dataclass(frozen=True)
class TextModel:
    """Options; ``fit`` learns a ``FittedTextModel``.

    ``features`` maps families to their options; with ``drop_null`` training rows without a known term are left out.  ``liwc`` needs a lexicon (entry, is_prefix, dim),
    ``glove`` embeddings (key, vector); both are given to ``fit`` and ``load``.
    """

    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    selector: Selector = field(default_factory=Selector)
    features: dict[str, dict] = field(default_factory=lambda: {"bag_of_words": {}})
    standardize: bool = False
    model: str = "logistic"
    model_kwargs: dict = field(default_factory=dict)
    class_weight: str | None = None
    seed: int = 42
    drop_null: bool = False

    def __post_init__(self) -> None:
        for name, options in self.features.items():
            if name not in FAMILIES:
                raise ValueError(f"unknown feature family {name!r}; one of {sorted(FAMILIES)}")
            unknown = set(options) - set(FAMILIES[name])
            if unknown:
                raise ValueError(f"unknown options of {name}: {sorted(unknown)}")
        if not self.features:
            raise ValueError("at least one feature family is needed")
        if self.features.get("liwc", {}).get("norm") not in fe.NORMS:
            raise ValueError(f"norm must be one of {fe.NORMS}")
        if self.model not in mo.CLASSIFIERS:
            raise ValueError(f"unknown classifier {self.model!r}; one of {sorted(mo.CLASSIFIERS)}")

    def prepare(self, corpus: DataFrame, labels: DataFrame, store: TableStore) -> Prepared:
        """Labels, counts and vocabulary of the training rows as tables of ``store`` that several fits can share.

        Only sources with a label of 0 or 1 are read: words of others never enter the vocabulary.
        """
        labels = labels.where("y in (0, 1)").select("source", F.col("y").cast("int").alias("y"))
        given = digest(fingerprint(corpus.select("source", "tokens")), fingerprint(labels))
        labels = store.table("labels", given, lambda: labels)
        key = digest(given, self.vocabulary)
        counts = store.table("counts", key, lambda: self.vocabulary.counts(corpus.join(labels.select("source").distinct(), "source", "left_semi")))
        return Prepared(key, labels, counts, store.table("terms", key, lambda: self.vocabulary.fit_counts(counts)))

    def fit(self, corpus: DataFrame, labels: DataFrame, lexicon: DataFrame | None = None, embeddings: DataFrame | None = None, prepared: Prepared | None = None, store: TableStore | None = None) -> FittedTextModel:
        """Learn from ``corpus(source, tokens)`` and ``labels(source, y)`` of 0 and 1; other labels are ignored.

        Without a ``store`` the tables on the way are deleted at the end, and the few that the model needs
        are copied; with one they stay as long as the store holds them, and the model lives as long.
        ValueError if no training row has a feature.
        """
        if store is None:
            with TableStore(corpus.sparkSession) as own, own.holding():
                return self.fit(corpus, labels, lexicon, embeddings, prepared, own)._kept()
        made = prepared or self.prepare(corpus, labels, store)
        key = digest(made.key, self.selector)
        kept = made.terms
        if self.selector.kind is not None:
            known = store.table("known", made.key, lambda: made.counts.join(made.terms.select("term"), "term", "left_semi").select("source", "term", "n"))
            kept = store.table("selected", key, lambda: self.selector.fit(known, made.labels, made.terms))
        fitted = FittedTextModel(self, kept.select("term", "idx"), lexicon=lexicon, embeddings=embeddings, store=store, key=key)
        return fitted._learn(made.counts, made.labels)


class Prepared(NamedTuple):
    """Tables that fits with the same vocabulary options and training rows share, and their key."""

    key: str
    labels: DataFrame
    counts: DataFrame
    terms: DataFrame


@dataclass
class FittedTextModel:
    options: TextModel
    terms: DataFrame
    lexicon: DataFrame | None = None
    embeddings: DataFrame | None = None
    idf: DataFrame | None = None
    names: DataFrame | None = None
    size: int = 0
    topics: object = None
    model: object = None
    store: TableStore | None = None
    key: str = ""

    def _table(self, tag: str, make: Callable[[], DataFrame], *parts) -> DataFrame:
        """A table of the store under this model's vocabulary and ``parts``."""
        return self.store.table(tag, digest(self.key, self.options.drop_null, *parts), make)

    def _kept(self) -> FittedTextModel:
        """This model with tables of its own, without the store."""
        self.terms, self.names = stash(self.terms, "terms"), stash(self.names, "names")
        self.idf = None if self.idf is None else stash(self.idf, "idf")
        self.store = None
        return self

    def _learn(self, counts: DataFrame, labels: DataFrame) -> FittedTextModel:
        chosen, sources = self.options.features, labels.select("source")
        inside = self._table("inside", lambda: counts.join(self.terms, "term").select("source", "term", "idx", "n"))
        if self.options.drop_null:
            labels = self._table("with_terms", lambda: labels.join(inside.select("source"), "source", "left_semi"))
            sources = labels.select("source")
        if "dim" in chosen.get("glove", {}):
            wrong = self.embeddings.where(F.size("vector") != chosen["glove"]["dim"]).limit(1).count()
            if wrong:
                raise ValueError(f"the embeddings don't have {chosen['glove']['dim']} dimensions")
        if "tfidf" in chosen:
            docs = labels.agg(F.count("*").cast("double").alias("docs"))  # one row
            idf = F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0
            self.idf = self._table("idf", lambda: inside.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs)).select("term", idf.alias("idf")))
        if "lda" in chosen:
            o = {"k": 50, "max_iter": 20, "seed": self.options.seed, "doc_prior": None, "topic_prior": None} | chosen["lda"]
            priors = {name: value for name, value in (("docConcentration", o["doc_prior"] and [float(o["doc_prior"])]), ("topicConcentration", o["topic_prior"])) if value}
            self.topics = self.store.value(digest(self.key, "lda", o), lambda: LDA(k=o["k"], maxIter=o["max_iter"], seed=o["seed"], featuresCol="bag", **priors).fit(self._bag(inside, sources)))
        long = self._table("features", lambda: self._features(inside, sources), chosen)
        self.names = self._table("names", lambda: self._scales(long, labels), chosen)
        self.size = self.names.count()
        if not self.size:
            raise ValueError("no training row has a feature: the vocabulary, or what was selected of it, is empty")
        data = self._table("train", lambda: self._vectors(long, sources).join(labels, "source").withColumnRenamed("y", "label"), chosen, self.options.standardize)
        kw = dict(self.options.model_kwargs)
        if self.options.model in ("logistic", "linear_svm", "svm"):
            kw["n"] = data.count()
        if self.options.class_weight and self.options.model in mo.WEIGHTED:
            data, kw["weightCol"] = mo.class_weights(data, self.options.class_weight), "weight"
        if self.options.model == "mlp":
            kw["layers"] = (self.size, *tuple(kw.get("layers", (0, 100, 2)))[1:])
        self.model = mo.classifier(self.options.model, self.options.seed, **kw).fit(data)
        return self

    @staticmethod
    def _scales(long: DataFrame, labels: DataFrame) -> DataFrame:
        """(idx, feature_set, name, mean, std) of the features over all training sources."""
        scale = long.groupBy("feature_set", "name").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
        n = float(max(1, labels.count()))
        mean = F.col("s") / n
        scale = scale.select("feature_set", "name", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))).alias("std"))
        return position(scale.withColumn("_key", F.concat_ws("\u0001", "feature_set", "name")), "_key").drop("_key")

    def _bag(self, inside: DataFrame, sources: DataFrame) -> DataFrame:
        size = self.terms.count()
        rows = mo.to_vectors(inside, size)
        return mo.with_empty(sources.join(rows, "source", "left"), size).withColumnRenamed("features", "bag")

    def _features(self, inside: DataFrame, sources: DataFrame) -> DataFrame:
        """(feature_set, source, name, value) of all families, in the order of their names."""
        chosen, sets = self.options.features, {}
        if "bag_of_words" in chosen:
            sets["bag_of_words"] = inside.select("source", F.col("term").alias("name"), F.col("n").alias("value"))
        if "tfidf" in chosen:
            raw = inside.join(self.idf, "term").select("source", "term", (F.col("n") * F.col("idf")).alias("value"))
            sets["tfidf"] = fe.l2_rows(raw, "value", "term").withColumnRenamed("term", "name")
        if "liwc" in chosen:
            sets["liwc"] = fe.lexicon_features(inside.select("source", "term", "n"), self.lexicon, **chosen["liwc"]).withColumnRenamed("dim", "name")
        if "glove" in chosen:
            sets["glove"] = fe.pool_embeddings(inside.select("source", F.col("term").alias("key"), "n"), self.embeddings, **{k: v for k, v in chosen["glove"].items() if k != "dim"}).select("source", F.lpad(F.col("dim").cast("string"), 4, "0").alias("name"), "value")
        if "lda" in chosen:
            topic = self.topics.transform(self._bag(inside, sources)).select("source", F.posexplode(mo.vector_to_array("topicDistribution")).alias("dim", "value"))
            sets["lda"] = topic.select("source", F.lpad(F.col("dim").cast("string"), 4, "0").alias("name"), "value")
        return fe.union_features(**sets)

    def _vectors(self, long: DataFrame, sources: DataFrame) -> DataFrame:
        """(source, features): a vector for each source, an empty one where it has no feature.

        Standardised vectors hold every feature: an absent one is not zero there.
        """
        values = long.join(self.names, ["feature_set", "name"])
        if self.options.standardize:
            zero = -F.col("mean") / F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
            shift = self.names.select("idx", zero.alias("_zero")).orderBy("idx").toArrow()["_zero"].to_pylist()  # one number a feature
            values = values.withColumn("value", F.col("value") / F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))
            return _shifted(mo.with_empty(sources.join(mo.to_vectors(values, self.size, value="value"), "source", "left"), self.size), shift)
        return mo.with_empty(sources.join(mo.to_vectors(values, self.size, value="value"), "source", "left"), self.size)

    def vectors(self, corpus: DataFrame, key: str | None = None) -> DataFrame:
        """(source, features) of ``corpus(source, tokens)``; a source without a known term has an empty vector.

        With a store and a ``key`` of the corpus the tables on the way are shared with other models.
        """
        sources, chosen = corpus.select("source").distinct(), self.options.features
        if self.store is None or key is None:
            inside = stash(self.options.vocabulary.counts(corpus).join(self.terms, "term").select("source", "term", "idx", "n"), "inside")
            return self._vectors(self._features(inside, sources), sources)
        counts = self.store.table("counts", digest(key, self.options.vocabulary), lambda: self.options.vocabulary.counts(corpus))
        inside = self._table("inside", lambda: counts.join(self.terms, "term").select("source", "term", "idx", "n"), key)
        long = self._table("features", lambda: self._features(inside, sources), key, chosen)
        return self._table("vectors", lambda: self._vectors(long, sources), key, chosen, self.options.standardize)

    def predict(self, corpus: DataFrame, key: str | None = None) -> DataFrame:
        """(source, y_pred): probability of class 1, or the class where the classifier has none."""
        return mo.predict(self.model, self.vectors(corpus, key))

    def with_terms(self, corpus: DataFrame) -> DataFrame:
        """(source) of a corpus that has a known term."""
        return self.options.vocabulary.counts(corpus).join(self.terms.select("term"), "term", "left_semi").select("source").distinct()

    def predict_counts(self, counts: DataFrame, sources: DataFrame) -> DataFrame:
        """``predict`` for the distinct ``sources`` of a table (source, term, n)."""
        inside = stash(counts.join(self.terms, "term").select("source", "term", "idx", "n"), "inside")
        return mo.predict(self.model, self._vectors(self._features(inside, sources), sources))

    def feature_names(self) -> DataFrame:
        """(idx, feature_set, name) in the order of the vectors."""
        return self.names.select("idx", "feature_set", "name")

    def coefficients(self) -> DataFrame:
        """(feature_set, name, coef) of a linear classifier, or the importances of trees."""
        values = getattr(self.model, "coefficients", None)
        values = getattr(self.model, "featureImportances", None) if values is None else values
        if values is None:
            raise ValueError(f"{self.options.model} has no coefficients")
        rows = [(i, float(v)) for i, v in enumerate(values.toArray())]  # one a feature
        return self.names.join(self.names.sparkSession.createDataFrame(rows, "idx long, coef double"), "idx").select("feature_set", "name", "coef")

    def interpret(self, k: int = 25) -> DataFrame:
        """(feature_set, name, coef, place): of each family the ``k`` features with the largest and the ``k`` with the smallest coefficients."""
        from pyspark.sql import Window

        c = self.coefficients()
        high, low = (F.row_number().over(Window.partitionBy("feature_set").orderBy(o, "name")) for o in (F.desc("coef"), F.asc("coef")))
        c = c.withColumn("_high", high).withColumn("_low", low).where((F.col("_high") <= k) | (F.col("_low") <= k))
        return c.select("feature_set", "name", "coef", F.when(F.col("_high") <= k, F.col("_high")).otherwise(-F.col("_low")).alias("place"))

    def topic_words(self, k: int = 10) -> DataFrame:
        """(topic, place, term, weight): the words of each topic."""
        rows = self.topics.describeTopics(k).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
        rows = rows.select("topic", "place", F.col("t.termIndices").cast("long").alias("idx"), F.col("t.termWeights").alias("weight"))
        return rows.join(self.terms, "idx").select("topic", "place", "term", "weight")

    def with_vocabulary(self, terms: DataFrame) -> FittedTextModel:
        """The same options over a given vocabulary (term, idx); has to learn anew."""
        return FittedTextModel(self.options, terms, self.lexicon, self.embeddings)

    def save(self, path: str) -> None:
        """Options, tables and classifier below ``path``, a folder all executors share."""
        spark = self.terms.sparkSession
        o = asdict(self.options)
        spark.createDataFrame([(json.dumps(o), self.size)], "options string, size long").coalesce(1).write.mode("overwrite").parquet(f"{path}/options")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.names.write.mode("overwrite").parquet(f"{path}/names")
        if self.idf is not None:
            self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        if self.topics is not None:
            self.topics.write().overwrite().save(f"{path}/topics")
        if isinstance(self.model, mo.BoostedModel):
            spark.createDataFrame([(i, float(a)) for i, (a, _) in enumerate(self.model.trees)], "i int, alpha double").write.mode("overwrite").parquet(f"{path}/alphas")
            for i, (_, tree) in enumerate(self.model.trees):
                tree.write().overwrite().save(f"{path}/classifier-{i}")
        elif self.options.model == "svm":
            self.model.save(f"{path}/classifier")
        else:
            self.model.write().overwrite().save(f"{path}/classifier")


#: Classes of fitted classifiers by name.
_FITTED = {
    "logistic": ml.LogisticRegressionModel, "linear_svm": ml.LinearSVCModel, "perceptron": ml.LinearSVCModel, "sgd": ml.LinearSVCModel, "naive_bayes": ml.NaiveBayesModel,
    "decision_tree": ml.DecisionTreeClassificationModel, "random_forest": ml.RandomForestClassificationModel, "gradient_boosting": ml.GBTClassificationModel, "mlp": ml.MultilayerPerceptronClassificationModel,
}


def _shifted(df: DataFrame, shift: list[float]) -> DataFrame:
    """Dense vectors: each of ``features`` plus ``shift``."""
    from pyspark.ml.linalg import DenseVector, VectorUDT

    sent = df.sparkSession.sparkContext.broadcast(shift)
    add = F.udf(lambda v: DenseVector(v.toArray() + sent.value), VectorUDT())
    return df.withColumn("features", add("features"))


def load(spark: SparkSession, path: str, lexicon: DataFrame | None = None, embeddings: DataFrame | None = None) -> FittedTextModel:
    """What ``FittedTextModel.save`` wrote."""
    row = spark.read.parquet(f"{path}/options").first()
    o = json.loads(row["options"])
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    options = replace(TextModel(), **(o | {"vocabulary": Vocabulary(**tuples(o["vocabulary"])), "selector": Selector(**tuples(o["selector"])), "model_kwargs": tuples(o["model_kwargs"])}))
    out = FittedTextModel(options, spark.read.parquet(f"{path}/terms"), lexicon, embeddings, names=spark.read.parquet(f"{path}/names"), size=row["size"])
    if "tfidf" in options.features:
        out.idf = spark.read.parquet(f"{path}/idf")
    if "lda" in options.features:
        out.topics = LocalLDAModel.load(f"{path}/topics") if options.features["lda"].get("optimizer") != "em" else DistributedLDAModel.load(f"{path}/topics")
    if options.model == "adaboost":
        alphas = sorted(spark.read.parquet(f"{path}/alphas").collect())
        out.model = mo.BoostedModel([(a["alpha"], ml.DecisionTreeClassificationModel.load(f"{path}/classifier-{a['i']}")) for a in alphas])
    elif options.model == "svm":
        kw = {k: v for k, v in options.model_kwargs.items() if k in ("kernel", "gamma", "tolerance")}
        out.model = load_calibrated(spark, f"{path}/classifier", mo.kernel_features(options.seed, **kw))
    else:
        of = ml.LogisticRegressionModel if options.model == "sgd" and options.model_kwargs.get("loss") == "log" else _FITTED[options.model]
        out.model = of.load(f"{path}/classifier")
    return out
