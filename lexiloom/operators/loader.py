"""Filters of processed posts, in the fixed order of the loader.

A post is (user, created_utc, text, tokens, subreddit, ordinal).  First come the user's most
recent posts, then the date range, then a sample, then the post and token filters: caps count
posts that later filters remove.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, let
from ..functions.tokenizer import EMOJI, PUNCT_ONLY
from ..functions.wordlists import CONTRACTIONS, PRONOUNS, STOPWORDS
from .sampling import random_posts, recent_posts


def expand_patterns(patterns: list[str], fillers: dict[str, list[str]]) -> list[str]:
    """Fill the first slot (a word with a leading ``_``) of each pattern; a comma behind it stays."""
    out = []
    for p in patterns:
        words = p.split()
        at = next((i for i, w in enumerate(words) if w.startswith("_")), None)
        if at is None:
            out.append(p)
            continue
        slot = words[at]
        comma = "," if slot.endswith(",") else ""
        out += [" ".join([*words[:at], f + comma, *words[at + 1 :]]) for f in fillers[slot.rstrip(",")]]
    return out


@dataclass(frozen=True)
class PostLoader:
    filter_negate: bool = False
    filter_upper: bool = False
    filter_punctuation: bool = False
    filter_numeric: bool = False
    filter_user_mentions: bool = False
    filter_url: bool = False
    filter_retweet: bool = False
    filter_stopwords: bool = False
    keep_pronouns: bool = True
    preserve_case: bool = True
    filter_empty: bool = False
    filter_hashtag: bool = False
    strip_hashtag: bool = False
    emoji_handling: str | None = None
    max_tokens_per_document: int | None = None
    max_documents_per_user: int | None = None
    ignore_subreddits: tuple[str, ...] = ()
    ignore_terms: tuple[str, ...] = ()
    keep_retweets: bool = True
    random_state: int = 42

    def __post_init__(self) -> None:
        if self.emoji_handling not in (None, "replace", "strip"):
            raise ValueError("emoji_handling should be 'replace', 'strip', or None.")

    def filter_set(self) -> list[str]:
        marks = (("<NEGATE_FLAG>", self.filter_negate), ("<UPPER_FLAG>", self.filter_upper), ("<NUMERIC>", self.filter_numeric), ("<USER_MENTION>", self.filter_user_mentions), ("<URL_TOKEN>", self.filter_url), ("''", self.filter_empty), ('""', self.filter_empty))
        return [m for m, on in marks if on]

    def stopword_set(self) -> list[str]:
        words = set(STOPWORDS) | {x for w in STOPWORDS for x in CONTRACTIONS.get(w, w).split()}
        return sorted(words - (set(PRONOUNS) if self.keep_pronouns else set()))

    def select(self, posts: DataFrame, min_date: str | None = None, max_date: str | None = None, n_samples: int | float | None = None, randomized: bool = False) -> DataFrame:
        if n_samples is not None and n_samples <= 0:
            raise ValueError("n_samples must be positive")
        if self.max_documents_per_user is not None:
            posts = recent_posts(posts, "user", "created_utc", "ordinal", self.max_documents_per_user)
        at = F.timestamp_seconds("created_utc")
        if min_date is not None:
            posts = posts.where(at >= F.lit(min_date).cast("timestamp"))
        if max_date is not None:
            posts = posts.where(at <= F.lit(max_date).cast("timestamp"))
        if n_samples is not None:
            posts = random_posts(posts, "user", "ordinal", n_samples, self.random_state) if randomized else recent_posts(posts, "user", "created_utc", "ordinal", n_samples)
        return posts

    def tokens(self, tokens: Column) -> Column:
        """Token stages; a post that the flag filter empties keeps its empty list, null means dropped."""
        marks = F.array(*map(F.lit, self.filter_set())).cast("array<string>")
        stages = []
        if self.filter_retweet:
            skip = lambda a: F.when(F.get(a, 0).isin("<USER_MENTION>", ":"), F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))).otherwise(a)
            head = lambda a: F.when(F.get(a, 0) == "<RETWEET>", let(F.slice(a, 2, F.size(a)), lambda b: let(skip(b), skip))).otherwise(a)
            stages += [lambda a: F.when((F.size(a) == 1) & (F.get(a, 0) == "<RETWEET>"), None).otherwise(head(a)), lambda a: F.array_remove(a, "<RETWEET>")]
        tag = lambda t: t.startswith("<HASHTAG=")
        if self.filter_hashtag:
            stages.append(lambda a: F.filter(a, lambda t: ~tag(t)))
        elif self.strip_hashtag:
            stages.append(lambda a: F.transform(a, lambda t: F.when(tag(t), F.regexp_replace(t, "^<HASHTAG=(.*).$", "$1")).otherwise(t)))
        if self.max_tokens_per_document is not None:
            stages.append(lambda a: F.slice(a, 1, self.max_tokens_per_document))
        if self.filter_stopwords:
            words = F.array(*map(F.lit, self.stopword_set()))
            stages.append(lambda a: F.filter(a, lambda t: ~F.array_contains(words, F.replace(F.lower(t), F.lit("not_"), F.lit("")))))
        if self.filter_punctuation:
            stages.append(lambda a: F.filter(a, lambda t: ~t.rlike(PUNCT_ONLY)))
        if not self.preserve_case:
            low = lambda t: F.when(tag(t), F.concat(F.lit("<HASHTAG="), F.lower(F.replace(t, F.lit("<HASHTAG="), F.lit(""))))).when(F.array_contains(marks, t), t).otherwise(F.lower(t))
            stages.append(lambda a: F.transform(a, low))
        only = f"^(?:{EMOJI})$"
        if self.emoji_handling == "replace":
            stages.append(lambda a: F.transform(a, lambda t: F.when(t.rlike(only), "<EMOJI>").otherwise(t)))
        elif self.emoji_handling == "strip":
            stages.append(lambda a: F.filter(a, lambda t: ~t.rlike(only) & (t != "<EMOJI>")))

        def rest(a: Column) -> Column:
            out = a
            for stage in stages:
                out = let(out, stage)
            return out

        return let(F.filter(tokens, lambda t: ~F.array_contains(marks, t)), lambda a: F.when(F.size(a) == 0, a).otherwise(rest(a)))

    def filter(self, posts: DataFrame) -> DataFrame:
        if not self.keep_retweets:
            posts = posts.where(~F.array_contains("tokens", "<RETWEET>"))
        if self.ignore_subreddits and "subreddit" in posts.columns:
            out = F.broadcast(posts.sparkSession.createDataFrame([(s.lower(),) for s in self.ignore_subreddits], "_s string"))  # a configured list
            posts = posts.join(out, F.lower("subreddit") == F.col("_s"), "left_anti")
        if self.ignore_terms:
            text = F.col("text") if "text" in posts.columns else F.array_join("tokens", " ")
            posts = posts.where(~contains_any(text, list(self.ignore_terms)))
        # Through a generator: a filter on the column would have Spark make the tokens twice.
        return posts.withColumn("tokens", F.explode(F.filter(F.array(self.tokens(F.col("tokens"))), lambda t: t.isNotNull())))

    def load(self, posts: DataFrame, **kw) -> DataFrame:
        return self.filter(self.select(posts, **kw))
