"""Golden pairs: one option at a time."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import ngrams
from lexiloom.functions.tokenizer import Tokenizer, modelling_tokenizer
from lexiloom.operators.loader import PostLoader, expand_patterns


def run(spark, tok, text):
    return spark.createDataFrame([(text,)], "t string").select(tok(F.col("t")).alias("x")).first()["x"]


CASES = [
    ({}, None, []),
    ({}, "", []),
    (dict(stopwords=None), "I love the Red bike", ["i", "love", "the", "red", "bike"]),
    (dict(stopwords=("the",)), "I love the bike", ["i", "love", "bike"]),
    (dict(stopwords=None, keep_case=True), "Red Bike", ["Red", "Bike"]),
    (dict(stopwords=None), "I can not wait", ["i", "can", "not_wait"]),
    (dict(stopwords=None, negate_handling=False), "I can not wait", ["i", "can", "not", "wait"]),
    (dict(stopwords=None), "can not not wait", ["can", "not_not_wait"]),
    (dict(stopwords=None, negate_token=True), "I can't wait, not", ["i", "can", "not_wait", "<NEGATE_FLAG>", "<NEGATE_FLAG>"]),
    (dict(stopwords=None, expand_contractions=False), "i can't wait", ["i", "can", "not_wait"]),
    (dict(stopwords=None, expand_contractions=False, negate_handling=False), "i can't wait", ["i", "can't", "wait"]),
    (dict(stopwords=None, upper_flag=True), "GO HOME!", ["go", "home", "<UPPER_FLAG>"]),
    (dict(stopwords=None, keep_punctuation=True), "Stop, now!", ["stop", ",", "now", "!"]),
    (dict(stopwords=None, keep_numbers=True), "paid 5.50 or 1,200 at 10:30", ["paid", "<NUMERIC>", "or", "<NUMERIC>", "at", "<NUMERIC>"]),
    (dict(stopwords=None), "paid 5.50 now", ["paid", "now"]),
    (dict(stopwords=None), "hi @friend and u/other", ["hi", "<USER_MENTION>", "and", "<USER_MENTION>"]),
    (dict(stopwords=None, keep_user_mentions=False), "hi @friend", ["hi"]),
    (dict(stopwords=None), "see https://t.co/abc now", ["see", "<URL_TOKEN>", "now"]),
    (dict(stopwords=None, keep_url=False), "see www.example.com/x now", ["see", "now"]),
    (dict(stopwords=None), "#Great day", ["great", "day"]),
    (dict(stopwords=None, strip_hashtag=False), "#Great day", ["<HASHTAG=great>", "day"]),
    (dict(stopwords=None, keep_hashtags=False), "#Great day", ["day"]),
    (dict(stopwords=None), "RT : hello", ["hello"]),
    (dict(stopwords=None, keep_retweets=True), "RT hello", ["<RETWEET>", "hello"]),
    (dict(stopwords=None), "so 😂😍 fun", ["so", "😂", "😍", "fun"]),
    (dict(stopwords=None, emoji_handling="replace"), "so 😂😍", ["so", "<EMOJI>", "<EMOJI>"]),
    (dict(stopwords=None, emoji_handling="strip"), "so 😂 fun", ["so", "fun"]),
    (dict(stopwords=None, keep_punctuation=True), "wait :-) ^_^ <3", ["wait", ":-)", "^_^"]),
    (dict(stopwords=None), "x " + "y" * 30 + " z", ["x", "z"]),
    (dict(stopwords=None, keep_punctuation=True), "a &amp;lt; b", ["a", "<", "b"]),
]


@pytest.mark.parametrize("options,text,want", CASES)
def test_golden(spark, options, text, want):
    assert run(spark, Tokenizer(**options), text) == want


def test_modelling_preset(spark):
    assert run(spark, modelling_tokenizer(), "RT @me I can't see #Fun 12") == ["<RETWEET>", "<USER_MENTION>", "I", "can", "not_see", "<HASHTAG=Fun>", "<NUMERIC>", "<NEGATE_FLAG>"]


def test_invalid_options():
    with pytest.raises(ValueError):
        Tokenizer(emoji_handling="other")
    with pytest.raises(ValueError):
        ngrams(F.lit(None), 2, 1)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("t"), 1, 2)).collect()] == [[["a"], ["b"], ["c"], ["a", "b"], ["b", "c"]], []]


def test_loader(spark):
    rows = [("u", 30, "RT x", ["<RETWEET>", "<USER_MENTION>", ":", "Hello", "the", "!"], "A", 0), ("u", 20, "plain add", ["x", "<NUMERIC>"], "B", 1), ("u", 10, "old", ["old"], "b", 2), ("u", 5, "rt", ["<RETWEET>"], "A", 3)]
    posts = spark.createDataFrame(rows, "user string, created_utc long, text string, tokens array<string>, subreddit string, ordinal int")
    got = lambda loader, **kw: {r["ordinal"]: r["tokens"] for r in loader.load(posts, **kw).collect()}
    assert got(PostLoader(filter_retweet=True, filter_stopwords=True, filter_punctuation=True, preserve_case=False)) == {0: ["hello"], 1: ["x", "<numeric>"], 2: ["old"]}
    assert set(got(PostLoader(ignore_subreddits=("B",)))) == {0, 3}
    assert set(got(PostLoader(ignore_terms=("add",)))) == {0, 2, 3}
    assert set(got(PostLoader(keep_retweets=False))) == {1, 2}
    assert set(got(PostLoader(max_documents_per_user=2), max_date="1970-01-01 00:00:20")) == {1}
    assert got(PostLoader(filter_numeric=True, max_tokens_per_document=1))[1] == ["x"]


def test_patterns():
    assert expand_patterns(["i have _cond, now", "plain"], {"_cond": ["x", "y z"]}) == ["i have x, now", "i have y z, now", "plain"]
