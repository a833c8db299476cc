"""Models of a temporal experiment: one for each training period, control period and fold, each fitted once.

Posts are (bin, source, tokens): a user's posts of a period.  Splits are those of ``temporal_splits``.  A
model learns from the targets of one period and the controls of the same or another one, and
predicts the development and test users of every period in one job.  Terms are counted once for all.

Models, predictions and the tables that models share live below a folder that outlives the run, under
hashes of what made them (options, posts, training users), each with a mark that is written last.  A run
that was killed goes on where it stopped: nothing that has its mark is made again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import TableStore, digest, fingerprint
from .text_model import FittedTextModel, Prepared, TextModel, load


class ModelStore:
    """Fitted models below a folder all executors share; the manifest lists those that are whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._tables = TableStore(spark, f"{self.root}/manifest")

    def get(self, key: str, fit: Callable[[TableStore], FittedTextModel], about: dict, **resources) -> FittedTextModel:
        """The model under ``key``, fitted and saved if it isn't in the manifest; ``about`` is what the manifest says of it.

        ``fit`` gets a store for the tables on the way, which go when the model is saved.
        """
        path = f"{self.root}/model-{key}"
        if not self._tables.exists(self._tables.path("entry", key)):
            with TableStore(self.spark) as own, own.holding():
                fit(own).save(path)
            self._tables.table("entry", key, lambda: self.spark.createDataFrame([(key, path, json.dumps(about, default=str))], "key string, path string, about string").coalesce(1))
        return load(self.spark, path, **resources)

    def manifest(self) -> DataFrame:
        """(key, path, about) of the whole models; about is a JSON object."""
        kind = "key string, path string, about string"
        done = self._tables.finished("entry")
        return self.spark.read.schema(kind).parquet(*done) if done else self.spark.createDataFrame([], kind)


def training_sets(splits: DataFrame, mixed: bool = False) -> DataFrame:
    """(train_bin, control_bin, fold, source, y, bin): each model's training users and the period their posts are from.

    Without ``mixed`` targets and controls are of one period; with it all pairs of periods make a model.
    """
    train = splits.where("role = 'train'").select("bin", "fold", "source", F.col("label").cast("int").alias("y"))
    if not mixed:
        return train.select(F.col("bin").alias("train_bin"), F.col("bin").alias("control_bin"), "fold", "source", "y", "bin")
    bins = F.broadcast(train.select("bin").distinct())  # as many as there are periods
    targets = train.where("y = 1").crossJoin(bins.withColumnRenamed("bin", "control_bin")).withColumn("train_bin", F.col("bin"))
    controls = train.where("y = 0").crossJoin(bins.withColumnRenamed("bin", "train_bin")).withColumn("control_bin", F.col("bin"))
    columns = ["train_bin", "control_bin", "fold", "source", "y", "bin"]
    return targets.select(columns).unionByName(controls.select(columns))


def score_periods(posts: DataFrame, splits: DataFrame, options: TextModel, root: str, mixed: bool = False, **resources) -> DataFrame:
    """(train_bin, control_bin, fold, test_bin, source, y_pred) of every model for the users that it may be tested on.

    ``root`` holds models, shared tables and predictions and isn't deleted.  A model predicts the development
    users of its fold and the test users of each period.  A model without users of both classes is left out;
    users without a post in a period have no row.  Rows that repeat in ``splits`` count once; null bins,
    sources and tokens are ignored.
    """
    spark = posts.sparkSession
    shared, models = TableStore(spark, f"{root.rstrip('/')}/tables"), ModelStore(spark, f"{root.rstrip('/')}/models")
    posts = posts.select("bin", "source", "tokens").where("bin is not null and source is not null and tokens is not null")
    splits = splits.where("source is not null").select("bin", "fold", "role", "source", "label").distinct()
    given = digest(fingerprint(posts), fingerprint(splits), options.vocabulary, mixed)
    who = F.struct("bin", "source")
    counts = shared.table("counts", given, lambda: options.vocabulary.counts(posts.select(who.alias("source"), "tokens")).select("source.bin", "source.source", "term", "n"))
    seats = shared.table("training", given, lambda: training_sets(splits, mixed))
    held = shared.table("held", given, lambda: posts.select("bin", "source").distinct().join(splits.where("role <> 'train'"), ["bin", "source"]).select("bin", "source", "fold", "role").distinct())
    marks = seats.groupBy("train_bin", "control_bin", "fold").agg(F.count_if(F.col("y") == 1).alias("targets"), F.count_if(F.col("y") == 0).alias("controls")).where("targets > 0 and controls > 0")
    scored = []
    for m in marks.orderBy("train_bin", "control_bin", "fold").collect():  # one row a model
        key = digest(given, options, m["train_bin"], m["control_bin"], m["fold"])

        def fit(own: TableStore, m=m, key=key) -> FittedTextModel:
            mine = seats.where((F.col("train_bin") == m["train_bin"]) & (F.col("control_bin") == m["control_bin"]) & (F.col("fold") == m["fold"])).select("bin", "source", "y")
            own_counts = own.table("counts", key, lambda: counts.join(mine.select("bin", "source"), ["bin", "source"], "left_semi").select("source", "term", "n"))
            prepared = Prepared(key, mine.select("source", "y"), own_counts, own.table("terms", key, lambda: options.vocabulary.fit_counts(own_counts)))
            return options.fit(posts, prepared.labels, prepared=prepared, store=own, **resources)

        def predict(m=m, key=key, fit=fit) -> DataFrame:
            model = models.get(key, fit, m.asDict() | {"model": options.model, "options": asdict(options)}, **resources)
            tested = held.where((F.col("role") == "test") | (F.col("fold") == m["fold"])).select("bin", "source").distinct()
            name = F.concat_ws(":", "bin", "source")  # a user of a period is a source of its own
            rows = counts.join(tested, ["bin", "source"], "left_semi").select(name.alias("source"), "term", "n")
            names = tested.select(name.alias("name"), F.col("bin").alias("test_bin"), "source")
            p = model.predict_counts(rows, names.select(F.col("name").alias("source"))).withColumnRenamed("source", "name")
            about = [F.lit(m[c]).alias(c) for c in ("train_bin", "control_bin", "fold")]
            return names.join(p, "name").select(*about, "test_bin", "source", "y_pred")

        kind = shared.table("predictions", key, predict).schema
        scored.append(shared.path("predictions", key))
    if not scored:
        kind = splits.schema["source"].dataType.simpleString()
        return spark.createDataFrame([], f"train_bin int, control_bin int, fold int, test_bin int, source {kind}, y_pred double")
    return spark.read.schema(kind).parquet(*scored)
