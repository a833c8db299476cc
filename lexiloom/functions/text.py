"""Column functions on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "[^a-zà-ÿ]+"


def words(text: Column) -> Column:
    """Lower-case runs of Latin letters; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), LETTERS), lambda t: t != "")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def ngrams(tokens: Column, min_n: int = 1, max_n: int = 1) -> Column:
    """All n-grams as arrays of tokens, shorter ones first.

    Raises ValueError if ``min_n`` exceeds ``max_n`` or is below one.
    """
    if min_n > max_n:
        raise ValueError("min_n must not exceed max_n")
    if min_n < 1:
        raise ValueError("min_n must be at least 1")

    def of(t: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - n + 1)
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, lambda t: F.concat(*(of(t, n) for n in range(min_n, max_n + 1))))


def ngrams_with_flags(tokens: Column, flags: list[str], min_n: int = 1, max_n: int = 1) -> Column:
    """n-grams of the tokens that are no flags, then each flag as a unigram."""
    marks = F.array(*map(F.lit, flags))
    plain = F.filter(tokens, lambda t: ~F.array_contains(marks, t))
    kept = F.transform(F.filter(tokens, lambda t: F.array_contains(marks, t)), lambda t: F.array(t))
    return F.concat(ngrams(plain, min_n, max_n), kept)


def contains_any(text: Column, patterns: list[str]) -> Column:
    """Does the lower-cased text hold any pattern as a substring?"""
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(low, p)), F.lit(False)) if patterns else F.lit(False)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key's text and the seed alone, the same in every engine."""
    text = F.concat(F.lit(f"{seed}_"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def order_key(key: Column, seed: int) -> Column:
    """A pseudo-random text to sort by."""
    return F.md5(F.concat(F.lit(f"{seed}_"), key.cast("string")).cast("binary"))
