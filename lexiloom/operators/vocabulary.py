"""Term counts, vocabularies and long sparse document-term tables.

A corpus is ``(source, tokens)``, one row per post.  Tables stay long, ``(source, term, n)``, so
that partial aggregation happens before any shuffle and no row grows with the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, ngrams_with_flags
from .ranking import position


@dataclass(frozen=True)
class Vocabulary:
    """Options of vocabulary learning; None: no bound."""

    ngram_range: tuple[int, int] = (1, 1)
    min_freq: int | None = None
    max_freq: int | None = None
    max_size: int | None = None
    binarize: bool = True
    flags: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        ngrams(F.lit(None), *self.ngram_range)

    def terms(self, tokens: Column) -> Column:
        if self.ngram_range == (1, 1):  # flags come after the other tokens, which counts don't see
            return tokens
        grams = ngrams_with_flags(tokens, list(self.flags), *self.ngram_range) if self.flags else ngrams(tokens, *self.ngram_range)
        return F.transform(grams, lambda g: F.array_join(g, " "))

    def occurrences(self, corpus: DataFrame) -> DataFrame:
        """(source, term) of all that ``terms`` names; n-grams are put together behind the explosion, from their first token's place."""
        if self.ngram_range == (1, 1):
            return corpus.select("source", F.explode("tokens").alias("term"))
        low, high = self.ngram_range
        marks = F.array(*map(F.lit, self.flags)).cast("array<string>")
        plain = F.filter("tokens", lambda t: ~F.array_contains(marks, t)) if self.flags else F.col("tokens")
        kept = F.filter("tokens", lambda t: F.array_contains(marks, t)) if self.flags else F.array().cast("array<string>")
        rows = corpus.select("source", plain.alias("_p"), kept.alias("_k"))
        size, i = F.size("_p"), F.col("_i")
        places = F.when(size + F.size("_k") > 0, F.sequence(F.lit(0), size + F.size("_k") - 1))
        rows = rows.select("source", "_p", "_k", F.explode(places).alias("_i"))
        grams = [F.when(i + n <= size, F.concat_ws(" ", *(F.get("_p", i + j) for j in range(n)))) for n in range(low, high + 1)]
        if self.flags:
            grams.append(F.when(i >= size, F.get("_k", i - size)))
        return rows.select("source", (grams[0] if len(grams) == 1 else F.explode(F.array(*grams))).alias("term"))

    def counts(self, corpus: DataFrame, binarize: bool = False) -> DataFrame:
        """(source, term, n) of a corpus."""
        long = self.occurrences(corpus).where("term is not null")
        out = long.groupBy("source", "term").agg(F.count("*").alias("n"))
        return out.withColumn("n", F.lit(1).cast("long")) if binarize else out

    def fit(self, corpus: DataFrame) -> DataFrame:
        """(term, n, idx): terms within the bounds, the most frequent first choice, indexed in order.

        Counts are of sources if ``binarize``, else of occurrences.  Terms whose first word is
        protected always stay, and protected words the corpus lacks join with count 1.
        """
        return self.fit_counts(self.counts(corpus, self.binarize))

    def fit_counts(self, counts: DataFrame) -> DataFrame:
        """``fit`` from a table (source, term, n), which is read as it is."""
        total = counts.groupBy("term").agg((F.count("*") if self.binarize else F.sum("n")).alias("n"))
        safe = F.substring_index("term", " ", 1).isin(*self.protected) if self.protected else F.lit(False)
        keep = F.lit(True)
        if self.min_freq is not None:
            keep &= F.col("n") >= self.min_freq
        if self.max_freq is not None:
            keep &= F.col("n") <= self.max_freq
        if self.excluded:
            keep &= ~F.col("term").isin(*self.excluded)
        kept = total.where(safe | keep)
        if self.max_size is not None:
            kept = kept.orderBy(F.desc("n"), "term").limit(self.max_size)
        if self.protected:
            extra = counts.sparkSession.createDataFrame([(p,) for p in self.protected], "term string")
            kept = kept.unionByName(extra.join(kept, "term", "left_anti").withColumn("n", F.lit(1).cast("long")))
        return position(kept, "term")


def assign(terms: DataFrame) -> DataFrame:
    """A vocabulary of given distinct terms: (term, idx)."""
    return position(terms.select("term").distinct(), "term")


def vectorize(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(source, idx, n): counts of terms the vocabulary holds; it is joined by hash, or sent out if small."""
    return counts.join(vocabulary.select("term", "idx"), "term").select("source", "idx", "n")


def without_terms(users: DataFrame, dtm: DataFrame) -> DataFrame:
    """Users with an empty row in the table."""
    return users.select("source").distinct().join(dtm.select("source").distinct(), "source", "left_anti")


def label_vector(users: DataFrame, label: str, positive: str, negative: str = "control") -> DataFrame:
    """1 for the positive label, 0 for the negative, -1 for others and nulls."""
    y = F.when(F.col(label) == positive, 1).when(F.col(label) == negative, 0).otherwise(-1)
    return users.withColumn("y", y)


def external_terms(words: DataFrame, lexicon: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(term): words of ``words(term, n)`` in lower case that occur ``least`` times and that the lexicon, if given, matches."""
    from .features import match_lexicon

    terms = words.groupBy(F.lower("term").alias("term")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("term")
    return terms if lexicon is None else match_lexicon(terms, lexicon).select("term").distinct()


def protect(vocabulary: DataFrame, external: DataFrame) -> DataFrame:
    """(term, n, idx): a learned vocabulary with external terms that it lacks, each with count 1, indexed anew."""
    missing = external.select("term").distinct().join(vocabulary, "term", "left_anti").withColumn("n", F.lit(1).cast("long"))
    return position(vocabulary.select("term", "n").unionByName(missing), "term")
