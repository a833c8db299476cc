"""URL filters from dated lists: validity intervals and an as-of join.

List entries say on which date a key was added to or removed from a list.  The entries of a
(list, key) in date order become intervals in which the key is listed; they never overlap.  A
capture is evaluated against the intervals that hold its fetch date: on the keys it can match (its
host's suffixes, and the host with each folder of its path), a month of the calendar and the
interval's bounds.  The month spreads a frequent host; adaptive execution splits what is left.
Distinct (url, date) pairs are evaluated once.

Schemes and hosts are compared in lower case, hosts without user information, port and closing dots;
paths as they are.

Defined cases: a null or unparsable URL, or one whose host has over ``LONGEST_HOST`` characters (none
has in the domain name system), matches nothing; of a long path as many folders count as the longest
listed key has; columns of the captures named as a result (n_active, lists, matched_key, blocked) give
way to it; a null fetch date is in no interval; of
entries of one day a removal holds; repeated entries count once; a re-addition continues the
listing; null keys, lists, actions or dates of entries are ignored; repeated captures get the same
result; an empty list lets all through; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Host (behind user information, before a port) and path of a URL.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"
LONGEST_HOST = 253


def host_of(url: F.Column) -> F.Column:
    """Host of a URL, empty where there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", "")
    return F.when(F.length(host) <= LONGEST_HOST, host).otherwise(F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): [from, to) of each listing; to is null while it lasts."""
    e = entries.where("list is not null and key is not null and on_date is not null and action in ('add', 'remove')")
    day = e.groupBy("list", "key", "on_date").agg(F.max("action").alias("action"))  # remove > add
    w = Window.partitionBy("list", "key").orderBy("on_date")
    return day.withColumn("valid_to", F.lead("on_date").over(w)).where("action = 'add'").select("list", "key", F.col("on_date").alias("valid_from"), "valid_to")


def keys_of(url: F.Column, depth: F.Column) -> F.Column:
    """Keys a URL can match: suffixes of its host, and host with folders down to ``depth``."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    folders = F.slice(F.split(F.regexp_extract(url, PATH, 1), "/"), 2, depth + 1)
    folders = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(folders, 1, i), "/"), F.when(i > 0, F.lit("/")).otherwise(F.lit(""))))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes)))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with ``url``, ``fetched_on``) and n_active, lists, matched_key, blocked.

    ``lists`` names the lists that hold the capture at its date, in order; ``matched_key`` is the
    longest listed key, the smallest of equals.
    """
    valid = intervals(entries)
    last = captures.agg(F.max("fetched_on").alias("last"))
    depth = valid.agg(F.coalesce(F.max(F.size(F.split("key", "/")) - 2), F.lit(0)).alias("depth"))
    month = lambda c: F.trunc(c, "month")
    until = F.least(F.col("valid_to"), F.col("last"))
    spread = valid.crossJoin(F.broadcast(last)).where("valid_from <= last").withColumn("month", F.explode(F.sequence(month("valid_from"), F.greatest(month(until), month("valid_from")), F.expr("interval 1 month")))).drop("last")
    seen = captures.select("url", "fetched_on").where("url is not null and fetched_on is not null").distinct()
    asked = seen.crossJoin(F.broadcast(depth)).select("url", "fetched_on", month("fetched_on").alias("month"), F.explode(keys_of(F.col("url"), F.col("depth"))).alias("key"))
    hit = asked.join(spread, ["key", "month"]).where("fetched_on >= valid_from and (valid_to is null or fetched_on < valid_to)")
    best = F.min(F.struct((-F.length("key")).alias("n"), "key"))["key"]
    found = hit.groupBy("url", "fetched_on").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), best.alias("matched_key"))
    found = found.select(F.col("url").alias("_url"), F.col("fetched_on").alias("_on"), "n_active", "lists", "matched_key")
    out = captures.join(found, (F.col("url") == F.col("_url")) & (F.col("fetched_on") == F.col("_on")), "left")
    names = [c for c in captures.columns if c not in ("n_active", "lists", "matched_key", "blocked")]
    return out.select(*(captures[c] for c in names), F.coalesce(found["n_active"], F.lit(0).cast("long")).alias("n_active"), found["lists"], found["matched_key"], found["n_active"].isNotNull().alias("blocked"))
