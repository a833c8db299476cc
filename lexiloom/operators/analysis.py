"""Comparisons of vocabularies, classes and experiments."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uniform
from ..sources.scratch import stash
from .ranking import with_average_rank


def bootstrap_difference(df: DataFrame, value: str, group: str, key: str, draws: int = 100, share: float = 0.7, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Percentiles 2.5, 50 and 97.5 of the difference of class means over resamples with replacement.

    A row's number of copies in a draw is Poisson with mean ``share``, from a hash of its key and the
    draw, so rows are never gathered and partial sums suffice.
    """
    by = by or []
    p, below = math.exp(-share), [math.exp(-share)]
    while below[-1] < 1.0 - 1e-12:  # the whole inverse distribution, as far as numbers of 32 bits reach
        p *= share / len(below)
        below.append(below[-1] + p)

    def copies(draw: int) -> Column:
        u = uniform(F.concat_ws("_", F.lit(draw), "k"), seed)
        return F.size(F.filter(F.array(*map(F.lit, below)), lambda b: b <= u))

    d = df.select(*by, group, F.col(value).cast("double").alias("v"), F.col(key).alias("k"))
    d = d.withColumns({f"n{i}": copies(i) for i in range(1, draws + 1)})
    sums = d.groupBy(*by, group).agg(*(F.sum(F.col("v") * F.col(f"n{i}")).alias(f"s{i}") for i in range(1, draws + 1)), *(F.sum(f"n{i}").alias(f"c{i}") for i in range(1, draws + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("draw"), (F.col(f"s{i}") / F.nullif(F.col(f"c{i}"), F.lit(0))).alias("m")) for i in range(1, draws + 1))))
    sums = sums.select(*by, group, each.alias("e")).select(*by, group, "e.draw", "e.m")
    diff = sums.groupBy(*by, "draw").agg((F.max(F.when(F.col(group) == 1, F.col("m"))) - F.max(F.when(F.col(group) == 0, F.col("m")))).alias("d"))
    cut = F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return diff.groupBy(*by).agg(cut.alias("p")).select(*by, *(F.get("p", i).alias(n) for i, n in enumerate(("low", "median", "high"))))


def representatives(scores: DataFrame, by: str, least: int, k: int) -> DataFrame:
    """The ``k`` best-ranked terms of each dataset that enough users use."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "term")
    return scores.where(F.col("df") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def one_sided_kl(counts: DataFrame, smoothing: float = 0.01) -> DataFrame:
    """(dataset, term, df, score, rank): contribution of each term to the divergence of class 1 from class 0.

    ``counts(dataset, term, c0, c1)``; null is a dataset of its own.  Totals are of whole numbers, smoothed after, so that no
    order of rows changes a bit of a score, and the scores become a table: ranking joins them on their values.
    """
    lam = F.lit(float(smoothing))
    total = counts.groupBy(F.col("dataset").alias("_d")).agg(*((F.sum(c) + lam * F.count(c)).alias(f"_s{c[1]}") for c in ("c0", "c1")))
    c = counts.join(total, F.col("dataset").eqNullSafe(F.col("_d")))
    p0, p1 = (F.col("c0") + lam) / F.col("_s0"), (F.col("c1") + lam) / F.col("_s1")
    s = stash(c.select("dataset", "term", (F.col("c0") + F.col("c1")).alias("df"), (p1 * F.log(p1 / p0)).alias("score")), "kl")
    return with_average_rank(s, "score", ["dataset"], "rank")


def pairwise_correlation(ratios: DataFrame) -> DataFrame:
    """(a, b, pearson) of datasets' values over their common terms: ``ratios(dataset, term, value)``."""
    a, b = ratios.alias("a"), ratios.alias("b")
    j = a.join(b, F.col("a.term") == F.col("b.term"))
    return j.groupBy(F.col("a.dataset").alias("a"), F.col("b.dataset").alias("b")).agg(F.corr("a.value", "b.value").alias("pearson"))


def combined_counts(*tables: DataFrame) -> DataFrame:
    """Sum of several (term, n) tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def pivot_scores(df: DataFrame, rows: list[str], col: str, value: str, how: str = "avg", values: list | None = None) -> DataFrame:
    """Means, deviations or maxima as a matrix; naming the columns spares a pass."""
    agg = {"avg": F.avg, "std": F.stddev_pop, "max": F.max, "sum": F.sum, "count": F.count}[how]
    return df.groupBy(*rows).pivot(col, values).agg(agg(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))))


def top_and_bottom(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The ``k`` largest and ``k`` smallest rows, each once."""
    return df.orderBy(F.desc(value), key).limit(k).union(df.orderBy(value, key).limit(k)).dropDuplicates([key])


def experiment_matrix(trains: list[str], tests: list[str], **options: list) -> list[dict]:
    """All runs: training set, test set and options."""
    names = ["train", "test", *options]
    return [dict(zip(names, row, strict=True)) for row in product(trains, tests, *options.values())]


def median_support(df: DataFrame, by: list[str], support: str) -> DataFrame:
    """Rows of the group's median support or more."""
    return df.withColumn("_m", F.percentile(support, F.lit(0.5)).over(Window.partitionBy(*by))).where(F.col(support) >= F.col("_m")).drop("_m")


def lag_periods(df: DataFrame, train: str, test: str) -> DataFrame:
    """``aligned`` and ``lag`` of each score's periods."""
    return df.withColumn("lag", F.col(test) - F.col(train)).withColumn("aligned", F.col(test) == F.col(train))


def within_between(similarity: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean similarity (a, b, cosine) within and between the sources' groups."""
    g = groups
    j = similarity.where("a <> b").join(g.select(F.col("source").alias("a"), F.col("grp").alias("ga")), "a").join(g.select(F.col("source").alias("b"), F.col("grp").alias("gb")), "b")
    return j.groupBy((F.col("ga") == F.col("gb")).alias("within")).agg(F.avg("cosine").alias("cosine"), F.count("*").alias("n"))


def class_ids(df: DataFrame, cols: list[str]) -> DataFrame:
    """A number for each combination of classes, in order; combinations are few."""
    combos = df.select(*cols).distinct().withColumn("class_id", F.row_number().over(Window.orderBy(*cols)) - 1)
    return df.join(combos, cols)


def hit_rate(counts: DataFrame, known: DataFrame) -> DataFrame:
    """(source, rate): share of a source's tokens whose term is known."""
    j = counts.join(known.select("term").distinct().withColumn("_k", F.lit(1)), "term", "left")
    return j.groupBy("source").agg((F.sum(F.when(F.col("_k") == 1, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("rate"))


def value_bins(value: Column, lo: float, hi: float, bins: int) -> Column:
    return F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))


def category_counts(posts: DataFrame, user: str, category: str, at: str, lo: str, hi: str) -> DataFrame:
    """(user, category, n) of a user's posts in the closed date range."""
    day = F.to_date(at)
    return posts.where(day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) & F.col(category).isNotNull()).groupBy(user, category).agg(F.count("*").alias("n"))


def language_counts(posts: DataFrame, loader, tokenizer, vocabulary, min_date: str | None = None, max_date: str | None = None) -> DataFrame:
    """(source, term, n) of raw posts: the loader's post filters first, then tokens are made anew and counted."""
    kept = loader.select(posts, min_date, max_date).where(F.col("text").isNotNull())
    rows = loader.filter(kept.withColumn("tokens", tokenizer(F.col("text"))))
    return vocabulary.counts(rows.select(F.col("user").alias("source"), "tokens"))


def frequent_in_fold(counts: DataFrame, folds: DataFrame, least: int) -> DataFrame:
    """(fold, term): terms that ``least`` sources of a fold's training side use."""
    return counts.join(folds, "source").groupBy("fold", "term").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("fold", "term")


def mean_coefficients(coefficients: DataFrame, by: list[str]) -> DataFrame:
    """Mean and deviation of each coefficient over the folds."""
    return coefficients.groupBy(*by).agg(F.avg("coef").alias("coef"), F.stddev_pop("coef").alias("std"), F.count("*").alias("folds"))


def group_means(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, grp, mean, n) of ``values(source, name, value)``: absent values count as zeros."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    return values.join(groups, "source").groupBy("name", "grp").agg(F.sum("value").alias("s")).join(F.broadcast(sizes), "grp").select("name", "grp", (F.col("s") / F.col("n")).alias("mean"), "n")  # one row a group


def concat(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` items, the last one shorter."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i * size + 1, size))).otherwise(F.array(items))


def name_emoji(term: Column) -> Column:
    """A term with each emoji written as ``EMOJI=name``, by the names the Unicode standard gives."""
    from ..functions.tokenizer import EMOJI

    @F.pandas_udf("string")
    def spell(terms):  # the terms of a report, a few hundred
        import unicodedata

        import regex

        pattern = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), EMOJI))
        name = lambda c: unicodedata.name(c, f"U+{ord(c):04X}").lower()
        return terms.map(lambda t: t if t is None else pattern.sub(lambda m: "EMOJI=" + " ".join(name(c) for c in m[0] if ord(c) not in (0x200D, 0xFE0F)), t))

    return spell(term)
