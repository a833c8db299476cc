"""Feature selection by pointwise mutual information and by divergence from stopwords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import CONTRACTIONS, PRONOUNS, STOPWORDS
from ..sources.scratch import stash
from .ranking import position, rank_of


def class_counts(dtm: DataFrame, labels: DataFrame, binarize: bool = True) -> DataFrame:
    """(term, y, n) with zeros where a class lacks a term."""
    n = F.count("*") if binarize else F.sum("n")
    seen = stash(dtm.join(labels, "source").groupBy("term", "y").agg(n.alias("n")), "class_counts")  # read several times
    classes = F.broadcast(labels.select("y").distinct())
    grid = seen.select("term").distinct().crossJoin(classes)
    return grid.join(seen, ["term", "y"], "left").na.fill(0, ["n"])


def pmi(dtm: DataFrame, labels: DataFrame, smoothing: float = 1.0, binarize: bool = True) -> DataFrame:
    """(term, y, n, pmi): log2 of a term's smoothed share in a class over its overall share."""
    counts = class_counts(dtm, labels, binarize)
    size = counts.agg(F.countDistinct("term").cast("double").alias("v"), F.sum("n").cast("double").alias("total"))
    by_class = counts.groupBy("y").agg(F.sum("n").cast("double").alias("in_class"))
    by_term = Window.partitionBy("term")
    c = counts.withColumn("all", F.sum("n").over(by_term)).join(F.broadcast(by_class), "y").crossJoin(F.broadcast(size))
    lam = F.lit(float(smoothing))
    inside = (F.col("n") + lam) / (F.col("in_class") + lam * F.col("v"))
    overall = (F.col("all") + lam) / (F.col("total") + lam * F.col("v"))
    return c.select("term", "y", "n", F.log2(inside / overall).alias("pmi"))


def pmi_top_k(scores: DataFrame, k: int, y: int = 1, min_support: int = 1) -> DataFrame:
    return scores.where((F.col("y") == y) & (F.col("n") >= min_support)).orderBy(F.desc("pmi"), "term").limit(k)


def kl_scores(dtm: DataFrame, labels: DataFrame, stopwords: list[str], smoothing: float = 0.01, symmetric: bool = True) -> DataFrame:
    """(term, divergence, df): divergence of a term's class profile from the stopwords'.

    Each stopword weighs by its smoothed share of users.
    """
    if not stopwords:
        raise ValueError("no stopword to compare with")
    lam = F.lit(float(smoothing))
    counts = class_counts(dtm, labels)
    total = F.sum(F.col("n") + lam).over(Window.partitionBy("term"))
    p = counts.select("term", "y", "n", ((F.col("n") + lam) / total).alias("p"))
    stop = p.where(F.col("term").isin(*stopwords)).withColumn("df", F.sum("n").over(Window.partitionBy("term")))
    weight = (F.col("df") + lam) / F.sum((F.col("df") + lam)).over(Window.partitionBy("y"))
    stop = F.broadcast(stop.select(F.col("term").alias("s"), F.col("y"), F.col("p").alias("q"), weight.alias("w")))
    one = F.col("p") * F.log(F.col("p") / F.col("q"))
    both = one + F.col("q") * F.log(F.col("q") / F.col("p")) if symmetric else one
    return p.join(stop, "y").groupBy("term").agg(F.sum(F.col("w") * both).alias("divergence")).join(p.groupBy("term").agg(F.sum("n").alias("df")), "term")


def mixed_rank(scores: DataFrame, beta: float = 0.5) -> DataFrame:
    """``scores`` with ``rank``, the ranks of divergence and of frequency mixed by ``beta``.

    0 is best and ties go to the smaller term.  The scores become a table first: ranking reads them
    several times.
    """
    out = rank_of(stash(scores, "scores"), F.round("divergence", 9), "term", "_by_divergence")
    out = rank_of(stash(out, "ranks"), F.col("df"), "term", "_by_df")
    return out.withColumn("rank", F.lit(1.0 - beta) * F.col("_by_divergence") + F.lit(float(beta)) * F.col("_by_df")).drop("_by_divergence", "_by_df")


def select_top(scores: DataFrame, k: int, min_support: int = 0) -> DataFrame:
    return scores.where(F.col("df") >= min_support).orderBy("rank", "term").limit(k)


def class_log_ratio(dtm: DataFrame, labels: DataFrame, alpha: float = 1e-10) -> DataFrame:
    """(term, p0, p1, log_ratio, weighted, pmi) from shares of users of the two classes."""
    sizes = labels.groupBy("y").agg(F.count("*").cast("double").alias("users"))
    n = F.broadcast(sizes.agg(F.max(F.when(F.col("y") == 0, F.col("users"))).alias("n0"), F.max(F.when(F.col("y") == 1, F.col("users"))).alias("n1")))
    users = dtm.join(labels, "source").groupBy("term").agg(F.count_if(F.col("y") == 0).alias("c0"), F.count_if(F.col("y") == 1).alias("c1")).crossJoin(n)
    a = F.lit(alpha)
    p0, p1 = F.col("c0") / F.col("n0"), F.col("c1") / F.col("n1")
    ratio = F.log((p1 + a) / (p0 + a))
    overall = (F.col("c0") + F.col("c1")) / (F.col("n0") + F.col("n1"))
    return users.select("term", "c0", "c1", p0.alias("p0"), p1.alias("p1"), ratio.alias("log_ratio"), (ratio * overall).alias("weighted_log_ratio"), F.log((p1 + a) / (overall + a)).alias("pmi"))


def expanded(words: list[str]) -> set[str]:
    """The words and those that their contractions stand for."""
    return set(words) | {x for w in words for x in CONTRACTIONS.get(w, w).split()}


def stopword_groups(vocabulary: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(term, stopword): single words of the vocabulary that are stopwords once in lower case and without ``not_``.

    Raises ValueError if there is none.
    """
    words = sorted(expanded(list(STOPWORDS if stopwords is None else stopwords)))
    plain = F.replace(F.lower("term"), F.lit("not_"), F.lit(""))
    found = vocabulary.where(~F.contains("term", F.lit(" "))).select("term", plain.alias("stopword")).where(F.col("stopword").isin(*words))
    if not found.limit(1).count():
        raise ValueError("no term of the vocabulary is a stopword")
    return found


def kl_scores_by_group(dtm: DataFrame, labels: DataFrame, groups: DataFrame, smoothing: float = 0.01, symmetric: bool = True) -> DataFrame:
    """``kl_scores`` against groups of terms: a stopword's profile is that of all its forms together."""
    forms = dtm.join(groups, "term").select("source", F.concat(F.lit("\u0002"), F.col("stopword")).alias("term")).distinct().withColumn("n", F.lit(1).cast("long"))
    names = [r["term"] for r in forms.select("term").distinct().collect()]  # at most the word list
    both = dtm.select("source", "term", "n").unionByName(forms.select("source", "term", "n"))
    return kl_scores(both, labels, names, smoothing, symmetric).where(~F.col("term").startswith("\u0002"))


@dataclass(frozen=True)
class Selector:
    """Selection of a vocabulary's terms: ``kind`` is None (all), ``kldivergence`` or ``pmi``.

    ``protected`` terms stay whatever their score, as do pronouns with ``keep_pronouns``; with
    ``filter_stopwords`` stopwords go first, but for those pronouns.
    """

    kind: str | None = None
    top_k: int = 1000
    min_support: int = 0
    smoothing: float = 0.01
    beta: float = 0.5
    symmetric: bool = True
    stopwords: tuple[str, ...] | None = None
    filter_stopwords: bool = False
    keep_pronouns: bool = False
    protected: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in (None, "kldivergence", "pmi"):
            raise ValueError("kind must be None, 'kldivergence' or 'pmi'")

    def best(self, dtm: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(term) of the best-ranked terms of ``dtm(source, term, n)``; labels are ``(source, y)``."""
        if self.kind == "pmi":
            scores = pmi(dtm, labels, self.smoothing)
            top = scores.groupBy("term").agg(F.max("pmi").alias("pmi"), F.sum("n").alias("n")).where(F.col("n") >= self.min_support)
            return top.orderBy(F.desc(F.round("pmi", 9)), "term").limit(self.top_k).select("term")
        groups = stopword_groups(vocabulary, list(self.stopwords) if self.stopwords is not None else None)
        scores = kl_scores_by_group(dtm, labels, groups, self.smoothing, self.symmetric)
        return select_top(mixed_rank(scores, self.beta), self.top_k, self.min_support).select("term")

    def fit(self, dtm: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(term, n, idx): what stays of the vocabulary, indexed anew in the order of the terms."""
        if self.kind is None:
            return vocabulary
        return self.reindex(vocabulary, self.best(dtm, labels, vocabulary))

    def reindex(self, vocabulary: DataFrame, best: DataFrame) -> DataFrame:
        removed = (expanded(list(STOPWORDS)) - (set(PRONOUNS) if self.keep_pronouns else set())) if self.filter_stopwords else set()
        kept = sorted((set(self.protected) - removed) | (set(PRONOUNS) if self.keep_pronouns else set()))
        chosen = best.select("term", F.lit(True).alias("_best"))
        stays = F.coalesce("_best", F.lit(False))
        if removed:
            stays &= ~F.col("term").isin(*sorted(removed))
        if kept:
            stays |= F.col("term").isin(*kept)
        return position(vocabulary.select("term", "n").join(chosen, "term", "left").where(stays).drop("_best"), "term")


def reduce_columns(dtm: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, idx, n) under the new index: the columns of terms that stayed."""
    moved = before.select("term", F.col("idx").alias("_old")).join(after.select("term", F.col("idx").alias("_new")), "term").drop("term")
    return dtm.join(moved, dtm["idx"] == F.col("_old")).select("source", F.col("_new").alias("idx"), "n")
