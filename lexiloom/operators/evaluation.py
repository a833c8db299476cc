"""Scores of predictions as grouped aggregates: ``(y_true, y_pred)`` and any group columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running, with_average_rank


def align(truth: DataFrame, predictions: DataFrame, fill: float = 0.5) -> DataFrame:
    """Outer alignment by ``source``; a missing prediction is ``fill``."""
    return truth.join(predictions, "source", "full_outer").withColumn("y_pred", F.coalesce("y_pred", F.lit(fill)))


def counts(df: DataFrame, by: list[str], threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    hit = (F.col("y_pred") >= threshold) if inclusive else (F.col("y_pred") > threshold)
    yes = F.col("y_true") == 1
    return df.groupBy(*by).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))


def scores(df: DataFrame, by: list[str], threshold: float = 0.5, inclusive: bool = False, degenerate_zero: bool = True) -> DataFrame:
    """Precision, recall, f1 and accuracy of each group.

    With ``degenerate_zero`` precision and f1 are 0 where all predictions are of one class.
    """
    c = counts(df, by, threshold, inclusive)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    if degenerate_zero:
        flat = (tp + fp == 0) | (fn + tn == 0)
        p, f1 = (F.when(flat, 0.0).otherwise(x) for x in (p, f1))
    return c.select(*by, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f1.alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve; equal scores count half.  Null where a class is absent.

    Scores are counted first, so the window orders distinct scores, not rows.
    """
    d = df.groupBy(*by, "y_pred").agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("n"))
    d = running(d, by, ["y_pred"], ["n"]).withColumn("won", F.col("p") * (F.col("before_n") + F.col("n") / 2.0))
    return d.groupBy(*by).agg((F.sum("won") / F.nullif((F.sum("p") * F.sum("n")).cast("double"), F.lit(0.0))).alias("auc"))


def roc_curve(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, tpr, fpr) at each distinct score, highest first."""
    d = df.groupBy(*by, F.col("y_pred").alias("threshold")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("n"))
    d = running(d, by, [F.desc("threshold")], ["p", "n"])
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.nullif(F.col(f"all_{c}"), F.lit(0))
    return d.select(*by, "threshold", share("p").alias("tpr"), share("n").alias("fpr"))


def best_f1(df: DataFrame, by: list[str], decimals: int = 2) -> DataFrame:
    """Threshold of the highest F1 among scores rounded to ``decimals``; the smallest of equals."""
    d = df.groupBy(*by, F.round("y_pred", decimals).alias("threshold")).agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count("*").alias("m"))
    above = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    f1 = 2.0 * F.sum("p").over(above) / F.nullif(F.sum("m").over(above) + F.sum("p").over(whole), F.lit(0))
    d = d.select(*by, "threshold", F.round(f1, 9).alias("f1"))
    return d.groupBy(*by).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(y_true, predicted, n, share of the true class), predictions at or above the threshold being 1."""
    c = df.groupBy("y_true", (F.col("y_pred") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y_true")))


def histogram(df: DataFrame, value: Column, by: list[str], lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n, density): equal bins, the last one closed."""
    at = F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))
    h = df.where((value >= lo) & (value <= hi)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return h.withColumn("density", F.col("n") / total / F.lit((hi - lo) / bins))


def mean_error(df: DataFrame, by: list[str], value: str, population: bool = True) -> DataFrame:
    """Mean, deviation and standard error: population deviation over root n, or sample over root n - 1."""
    s = F.stddev_pop(value) if population else F.stddev_samp(value)
    n = F.count(value) if population else F.nullif(F.count(value) - 1, F.lit(0))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), s.alias("std"), (s / F.sqrt(n)).alias("stderr"))


def against_baseline(df: DataFrame, keys: list[str], is_baseline: Column, value: str) -> DataFrame:
    """Each score's difference from, and share of, the baseline with the same keys."""
    base = df.where(is_baseline).groupBy(*keys).agg(F.avg(value).alias("baseline"))
    return df.join(base, keys, "left").withColumn("difference", F.col(value) - F.col("baseline")).withColumn("percent", 100.0 * F.col("difference") / F.nullif(F.col("baseline"), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    d = with_average_rank(df.select(*by, F.col(x).alias("x"), F.col(y).alias("y")), "x", by, "rx")
    return with_average_rank(d, "y", by, "ry").groupBy(*by).agg(F.corr("rx", "ry").alias("spearman"))


def with_subsets(df: DataFrame, seen: str) -> DataFrame:
    """Each row once for ``overall`` and once for ``seen`` or ``unseen``."""
    return df.withColumn("subset", F.explode(F.array(F.lit("overall"), F.when(F.col(seen), "seen").otherwise("unseen"))))


def report(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, the scores of class 1, and the means of both classes' scores weighted by their size."""
    c = counts(df, by, threshold)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    one = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    zero = {"precision": ratio(tn, tn + fn), "recall": ratio(tn, tn + fp), "f1": ratio(2 * tn, 2 * tn + fp + fn)}
    weighted = (ratio((tp + fn) * one[k] + (tn + fp) * zero[k], tp + fp + fn + tn).alias(f"weighted_{k}") for k in one)
    return c.select(*by, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), *(v.alias(k) for k, v in one.items()), *weighted)


def roc_lists(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, fpr, tpr, thresholds, auc, n_target, n_control): a whole curve a row, from (0, 0) at an infinite threshold.

    Points on a straight line between their neighbours are left out.  Scores are counted before they are put in
    order, and only what is kept of a curve is in its row.  Groups without both classes have no row.
    """
    d = df.groupBy(*by, "y_pred").agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("n"))
    d = running(d, by, [F.desc("y_pred")], ["p", "n"]).where("all_p > 0 and all_n > 0")
    point = F.struct((-F.col("y_pred")).alias("s"), "p", "n", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_n") + F.col("n")).alias("fp"))
    won = F.sum(F.col("n") * (F.col("before_p") + F.col("p") / 2.0))
    rows = d.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("c"), F.max("all_p").alias("n_target"), F.max("all_n").alias("n_control"), won.alias("won"))
    last = F.size("c") - 1
    bends = lambda x, i: (i == 0) | (i == last) | (F.get("c", i + 1)["p"] != x["p"]) | (F.get("c", i + 1)["n"] != x["n"])
    rows = rows.withColumn("c", F.filter("c", bends))
    curve = lambda name, total: F.concat(F.array(F.lit(0.0)), F.transform("c", lambda x: x[name] / F.col(total)))
    levels = F.concat(F.array(F.lit(float("inf"))), F.transform("c", lambda x: (-x["s"]).cast("double")))
    return rows.select(*by, curve("fp", "n_control").alias("fpr"), curve("tp", "n_target").alias("tpr"), levels.alias("thresholds"), (F.col("won") / (F.col("n_target") * F.col("n_control"))).alias("auc"), "n_target", "n_control")


def combination_scores(predictions: DataFrame, mixed: bool = False, threshold: float = 0.5) -> DataFrame:
    """Scores and curves of every training period, control period, test periods, fold and subset (overall, seen, unseen).

    ``predictions(group, train_bin, control_bin, test_bin, fold, y_true, y_pred, user_in_training)``.  With ``mixed``
    the targets of each test period meet the controls of each, else those of the same one.  Combinations without both
    classes have no row.
    """
    target = F.col("y_true") == 1
    if mixed:
        bins = F.broadcast(predictions.select(F.col("test_bin").alias("_other")).distinct())  # as many as there are periods
        rows = predictions.crossJoin(bins).withColumn("target_test", F.when(target, F.col("test_bin")).otherwise(F.col("_other"))).withColumn("control_test", F.when(target, F.col("_other")).otherwise(F.col("test_bin")))
    else:
        rows = predictions.withColumn("target_test", F.col("test_bin")).withColumn("control_test", F.col("test_bin"))
    by = ["group", "train_bin", "control_bin", "target_test", "control_test", "fold", "subset"]
    rows = with_subsets(rows, "user_in_training").select(*by, "y_true", "y_pred")
    return scores(rows, by, threshold, degenerate_zero=False).drop("tp", "fp", "fn", "tn").join(roc_lists(rows, by), by).withColumn("support", F.col("n_target") + F.col("n_control"))


def domain_summary(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """A row a group with the scores of class 1 and of each class that occurs, and its ROC curve.

    ``precision``, ``recall``, ``fscore`` and ``class_size`` are lists over the classes 0 and 1, without one that is
    neither true nor predicted anywhere in the group.  With two distinct scores or fewer there is no curve: ``auc`` is
    null and the lists are empty, as they are where a class is absent.  Rows without label or score are left out.
    """
    df = df.where("y_true is not null and y_pred is not null").select(*by, "y_true", F.col("y_pred").cast("double").alias("y_pred"))
    c = counts(df, by, threshold)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    of = lambda hit, wrong, missed: F.struct(ratio(hit, hit + wrong).alias("p"), ratio(hit, hit + missed).alias("r"), ratio(2 * hit, 2 * hit + wrong + missed).alias("f"), (hit + missed).cast("long").alias("n"), (hit + wrong + missed > 0).alias("here"))
    c = c.select(*by, F.filter(F.array(of(tn, fn, fp), of(tp, fp, fn)), lambda x: x["here"]).alias("_k"), of(tp, fp, fn).alias("_one"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))
    of_each = lambda part, name: F.transform("_k", lambda x: x[part]).alias(name)
    names = (("precision", "p"), ("recall", "r"), ("fscore", "f"))
    c = c.select(*by, *(of_each(part, name) for name, part in names), of_each("n", "class_size"), *(F.col("_one")[part].alias(f"binary_{name}") for name, part in names), "accuracy")
    several = df.groupBy(*by, "y_pred").count().groupBy(*by).agg(F.count("*").alias("_scores")).where("_scores > 2")
    curves = roc_lists(df, by).select(*by, "fpr", "tpr", "thresholds", "auc")
    curves = curves.alias("a").join(several.alias("b"), _same(by), "left_semi")
    empty = F.array().cast("array<double>")
    out = c.alias("a").join(curves.alias("b"), _same(by), "left")
    return out.select(*(F.col(f"a.{g}").alias(g) for g in by), *(F.col(f"a.{x}") for x in c.columns if x not in by), *(F.coalesce(F.col(f"b.{x}"), empty).alias(x) for x in ("fpr", "tpr", "thresholds")), F.col("b.auc").alias("auc"))


def _same(by: list[str]) -> Column:
    """Equal groups of the aliases ``a`` and ``b``, null ones too."""
    same = F.lit(True)
    for g in by:
        same &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return same
