"""TF-IDF and logistic regression over the folds of a long count table: which categories or words tell two classes apart.

Filters come first (categories by name, terms by their use in a fold's training side), so a source can lose all its
counts; such sources stay, as rows of zeros, and are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import TableStore
from . import wide
from .evaluation import counts as confusion_counts
from .features import l2_rows


def _sizes(counts: DataFrame, vocabularies: DataFrame, folds: DataFrame) -> DataFrame:
    known = counts.join(vocabularies.select("held", "term"), "term").select("held", "source").distinct()
    ids = folds.select("fold").distinct().select(F.col("fold").alias("held"))
    sides = folds.select("source", "fold").crossJoin(F.broadcast(ids))  # one row a fold
    met = sides.join(known.withColumn("_k", F.lit(1)), ["held", "source"], "left")
    group = F.when(F.col("fold") == F.col("held"), "test").otherwise("train").alias("group")
    return met.groupBy(F.col("held").alias("fold"), group).agg(F.count("*").alias("users"), F.count_if(F.col("_k").isNull()).alias("null_users"))


@dataclass(frozen=True)
class FoldModels:
    """``least``: sources of a fold's training side that must use a term; ``excluded``: names left out, in any case."""

    least: int = 1
    excluded: tuple[str, ...] = ()
    C: float = 1.0
    max_iter: int = 1000

    def filtered(self, counts: DataFrame) -> DataFrame:
        """(source, term, n) without the names left out and without counts of zero."""
        kept = counts.where("term is not null and n > 0").select("source", "term", "n")
        return kept.where(~F.lower("term").isin(*(e.lower() for e in self.excluded))) if self.excluded else kept

    def vocabularies(self, counts: DataFrame, folds: DataFrame) -> DataFrame:
        """(held, term, df, docs) of every fold: the sources that use the term and all sources, on the side that trains while ``held`` is held out.

        A term's sources are counted once by fold; each held-out fold takes its own off the whole.
        """
        ids = folds.select("fold").distinct().select(F.col("fold").alias("held"))
        sizes = folds.groupBy("fold").agg(F.count("*").alias("k"))
        whole = sizes.agg(F.sum("k").alias("all"))
        per = counts.join(folds.select("source", "fold"), "source").groupBy("term", "fold").agg(F.count("*").alias("d"))
        total = per.groupBy("term").agg(F.sum("d").alias("t"), F.map_from_entries(F.collect_list(F.struct("fold", "d"))).alias("m"))  # a few folds
        sides = ids.join(sizes, ids["held"] == sizes["fold"]).crossJoin(F.broadcast(whole)).select("held", (F.col("all") - F.col("k")).alias("docs"))
        df = F.col("t") - F.coalesce(F.try_element_at("m", F.col("held")), F.lit(0))
        rows = total.crossJoin(F.broadcast(sides)).select("held", "term", df.alias("df"), "docs")  # one row a fold
        return rows.where(F.col("df") >= max(self.least, 1))

    def sizes(self, counts: DataFrame, folds: DataFrame) -> DataFrame:
        """(fold, group, users, null_users): sources of each side, and those without a term of the fold's vocabulary."""
        counts = self.filtered(counts).join(folds.select("source"), "source", "left_semi")
        return _sizes(counts, self.vocabularies(counts, folds), folds)

    def run(self, counts: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scores (fold, group, precision, recall, fscore, accuracy, null_users) and coefficients (fold, term, coef).

        ``counts(source, term, n)`` has a row a source and term, ``folds(source, y, fold)`` a row with 0 or 1 for each
        source; counts of others are ignored.  Inverse document frequencies come from a fold's training side, rows have
        unit length.  A fold whose training side has one class or no term, or an empty table, gives no rows.
        """
        spark = counts.sparkSession
        folds = folds.where("y in (0, 1) and source is not null and fold is not null").select("source", F.col("y").cast("int").alias("y"), "fold")
        scores, coefs = [], []
        with TableStore(spark) as store:
            folds = store.table("folds", "all", lambda: folds)
            kept = store.table("counts", "kept", lambda: self.filtered(counts).join(folds.select("source"), "source", "left_semi"))
            vocabularies = store.table("vocabularies", "all", lambda: self.vocabularies(kept, folds))
            nulls = {(r["fold"], r["group"]): r["null_users"] for r in _sizes(kept, vocabularies, folds).collect()}
            for k in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
                mine = vocabularies.where(F.col("held") == k)
                terms = store.table("terms", str(k), lambda mine=mine: mine.select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf")))
                classes = folds.where(F.col("fold") != k).select("y").distinct().count()
                if not terms.limit(1).count() or classes < 2:
                    continue
                weighed = l2_rows(kept.join(terms.hint("shuffle_hash"), "term").select("source", "term", (F.col("n") * F.col("idf")).alias("v")), "v", "term")
                data = store.table("data", str(k), lambda weighed=weighed: weighed)
                model = wide.logistic(data, folds.where(F.col("fold") != k), C=self.C, max_iter=self.max_iter, tol=1e-7)
                group = F.when(F.col("fold") == k, "test").otherwise("train").alias("group")
                hits = model.margins(data, folds).join(folds.hint("shuffle_hash"), "source").select(group, F.col("y").alias("y_true"), F.when(F.col("margin") > 0, 1.0).otherwise(0.0).alias("y_pred"))
                for r in confusion_counts(hits, ["group"]).collect():
                    tp, fp, fn, tn = r["tp"], r["fp"], r["fn"], r["tn"]
                    p, rc, f = tp / max(tp + fp, 1), tp / max(tp + fn, 1), 2 * tp / max(2 * tp + fp + fn, 1)
                    scores.append((int(k), r["group"], p, rc, f, (tp + tn) / (tp + fp + fn + tn), nulls[k, r["group"]]))
                coefs.append(model.coefs.select(F.lit(int(k)).alias("fold"), "term", "coef"))
            out = spark.createDataFrame([], "fold int, term string, coef double")
            for c in coefs:
                out = out.union(c)
            # The coefficients outlive the store's tables.
            out = TableStore(spark).table("coefs", "all", lambda: out)
        return spark.createDataFrame(scores, "fold int, `group` string, precision double, recall double, fscore double, accuracy double, null_users long"), out


def summary(scores: DataFrame) -> DataFrame:
    """(group, score, mean, std): mean and sample deviation of each score over the folds."""
    names = ["precision", "recall", "fscore", "accuracy", "null_users"]
    long = scores.select("group", F.explode(F.array(*(F.struct(F.lit(n).alias("score"), F.col(n).cast("double").alias("v")) for n in names))).alias("s"))
    return long.groupBy("group", F.col("s.score").alias("score")).agg(F.avg("s.v").alias("mean"), F.stddev_samp("s.v").alias("std"))
