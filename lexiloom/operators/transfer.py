"""How lexicon models carry over from one data set to another, for all pairs of data sets at once.

A model is fitted to each domain.  On another domain its features may be made with the training domain's
vocabulary or the other's own, and scaled by the training domain's statistics or the other's own.  All four
ways and all pairs are one plan: features are a long table with a row for each vocabulary, and each setting is a
small table of weights and offsets.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import TableStore
from . import evaluation as ev
from .features import NORMS, match_lexicon
from .stability import dense_table, names_of, newton

#: Weights are as many as the square of it, times four and the features (256 at most): 262,144 rows.
MOST_DOMAINS = 16
SETTING = ["train", "test", "fix_vocabulary", "scale_independent"]


def domain_vocabularies(counts: DataFrame, least: int = 1) -> DataFrame:
    """(domain, term): terms that ``least`` sources of a domain use, of ``counts(domain, source, term, n)``."""
    return counts.groupBy("domain", "term").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("domain", "term")


def transfer_features(counts: DataFrame, vocabularies: DataFrame, lexicon: DataFrame, norm: str | None = None) -> DataFrame:
    """(vocabulary, domain, source, name, value): lexicon features of every source under every domain's vocabulary.

    Terms outside a vocabulary don't exist for it, nor in the totals that ``norm`` divides by.  A term carries the few
    vocabularies that hold it and the lexicon's names for it, so the counts are read once; only terms that count are
    shuffled.
    """
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")
    holders = vocabularies.groupBy("term").agg(F.collect_set("domain").alias("_v"))  # MOST_DOMAINS names a term
    dims = match_lexicon(holders.select("term"), lexicon).groupBy("term").agg(F.collect_set("dim").alias("_dims"))
    # Tables that grow with the data meet by hash, never at the driver: packed files and shuffles look too small to Spark.
    holders = holders.join(dims.hint("shuffle_hash"), "term", "left" if norm == "unmatched" else "inner")  # only that norm counts terms outside the lexicon
    names = F.concat(F.coalesce("_dims", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))  # null: the total
    long = counts.join(holders.hint("shuffle_hash"), "term").select("domain", "source", "n", F.explode("_v").alias("vocabulary"), names.alias("_names"))
    sums = long.select("vocabulary", "domain", "source", F.explode("_names").alias("name"), "n").groupBy("vocabulary", "domain", "source", "name").agg(F.sum("n").cast("double").alias("value"))
    if norm is None:
        return sums.where("name is not null")
    each, v, named = Window.partitionBy("vocabulary", "domain", "source"), F.col("value"), F.col("name").isNotNull()
    total = F.max(F.when(~named, v))
    if norm not in ("matched", "unmatched"):
        total = {"max": F.max(F.when(named, v)), "l1": F.sum(F.when(named, v)), "l2": F.sum(F.when(named, v * v))}[norm]
    total = total.over(each)
    total = F.sqrt(total) if norm == "l2" else total
    return sums.withColumn("value", v / F.nullif(total, F.lit(0.0))).where("name is not null")


def _statistics(features: DataFrame, sizes: dict, domains: list, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation by vocabulary, domain and name; sources without a row count as zeros."""
    mean, spread = np.zeros((2, len(domains), len(domains), len(names)))
    at, col = {d: i for i, d in enumerate(domains)}, {n: i for i, n in enumerate(names)}
    rows = features.groupBy("vocabulary", "domain", "name").agg(F.count("*").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect()
    for r in rows:
        n, k = sizes[r["domain"]], r["k"]
        i = at[r["vocabulary"]], at[r["domain"]], col[r["name"]]
        mean[i] = r["m"] * k / n
        spread[i] = np.sqrt(k / n * (r["v"] + (n - k) / n * r["m"] ** 2))
    return mean, spread


def transfer_predictions(counts: DataFrame, labels: DataFrame, vocabularies: DataFrame, lexicon: DataFrame, norm: str | None = None, C: float = 1.0, store: TableStore | None = None) -> DataFrame:
    """(train, test, fix_vocabulary, scale_independent, source, y_true, y_pred): each domain's model on every domain.

    ``counts(domain, source, term, n)``; ``labels(domain, source, y)`` has a row of 0 or 1 for each source, others are
    ignored, and so are counts without a label; a labelled source without counts has zeros.  With ``fix_vocabulary``
    the training vocabulary makes the test features, else the test domain's own; with ``scale_independent`` the test
    features have their own mean and deviation, else the training set's.  Rows with ``train`` = ``test`` are a model on
    its own training set.  A domain of one class trains no model; no label or no feature: no row.  More than
    ``MOST_DOMAINS`` domains raise ValueError.  The result reads a table of the features, which lies in ``store`` until
    its owner closes it (without one, in the session's scratch folder).
    """
    spark = counts.sparkSession
    labels = labels.where("y in (0, 1) and domain is not null and source is not null").select("domain", "source", F.col("y").cast("int").alias("y"))
    kind = labels.select(F.col("domain").alias("train"), F.col("domain").alias("test"), F.lit(True).alias("fix_vocabulary"), F.lit(True).alias("scale_independent"), "source", F.col("y").alias("y_true"), F.lit(0.0).alias("y_pred"))
    found = labels.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(MOST_DOMAINS + 1).collect()
    if len(found) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    sizes = {r["domain"]: r["n"] for r in found}
    domains = list(sizes)
    counts = counts.select("domain", "source", "term", "n")
    vocabularies = vocabularies.select("domain", "term").where(F.col("domain").isin(domains)) if domains else vocabularies.limit(0)
    features = (store or TableStore(spark)).table("transfer", uuid.uuid4().hex, lambda: transfer_features(counts, vocabularies, lexicon, norm).join(labels.select("domain", "source").hint("shuffle_hash"), ["domain", "source"], "left_semi"))
    names = names_of(features)
    if not names:
        return kind.limit(0)
    with TableStore(spark) as own_store:
        own = features.where(F.col("vocabulary") == F.col("domain")).select(F.struct("domain", "source").alias("source"), "name", "value")
        keyed = labels.select(F.struct("domain", "source").alias("source"), "y")
        drawn = [F.col("source.domain") == F.lit(d) for d in domains]
        fits = newton(own_store.table("rows", "own", lambda: dense_table(own, keyed, names, drawn)), len(domains), len(names), C)
    mean, spread = _statistics(features, sizes, domains, names)
    scale = np.where(spread <= 1e-12 * np.maximum(1, np.abs(mean)), 1.0, spread)
    weights, bases = [], []
    for i in np.flatnonzero(fits.able):
        for j in range(len(domains)):
            for fixed in (True, False):
                for independent in (True, False):
                    v = i if fixed else j
                    by = (v, j) if independent else (i, i)
                    w = fits.coef[i, :-1] / scale[by]
                    setting = (domains[i], domains[j], fixed, independent)
                    bases.append((*setting, float(fits.coef[i, -1] - w @ mean[by])))
                    weights += [(*setting, domains[v], name, float(x)) for name, x in zip(names, w, strict=True)]
    if not bases:
        return kind.limit(0)
    type_of = labels.schema["domain"].dataType.simpleString()
    base = F.broadcast(spark.createDataFrame(bases, f"train {type_of}, test {type_of}, fix_vocabulary boolean, scale_independent boolean, part double"))
    weight = F.broadcast(spark.createDataFrame(weights, f"train {type_of}, test {type_of}, fix_vocabulary boolean, scale_independent boolean, vocabulary {type_of}, name string, w double"))
    start = labels.join(base, labels["domain"] == base["test"]).select(*SETTING, "source", "y", "part")
    test = (features["domain"] == weight["test"]) & (features["vocabulary"] == weight["vocabulary"]) & (features["name"] == weight["name"])
    parts = features.join(weight, test).select(*SETTING, "source", F.lit(None).cast("int").alias("y"), (F.col("value") * F.col("w")).alias("part"))
    odds = start.unionByName(parts).groupBy(*SETTING, "source").agg(F.max("y").alias("y_true"), F.sum("part").alias("_odds"))
    return odds.select(*SETTING, "source", "y_true", (0.5 * (1 + F.tanh(F.col("_odds") / 2))).alias("y_pred"))


def transfer_scores(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, the scores of class 1 and the weighted means of both classes for every pair of domains and setting."""
    return ev.report(predictions, SETTING, threshold)
