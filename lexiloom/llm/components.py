"""Connected components of an edge table, wholly in DataFrames.

Alternates two contractions until the edges are stars around each component's smallest node:
first every node links its larger neighbours to its smallest one, then its smaller ones.  Each
round's edges are a table in the shared folder.  No node's neighbours are gathered in one place:
the minimum is pre-aggregated and joined back, with the edges of hubs cut up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .grouping import join_hubs


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without an edge have no row.

    Self-links, repeats and nulls are ignored; an empty table gives no row.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, before = stash(e, "edges"), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if not state["n"] or state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = join_hubs(both.where("v > u"), least, "u", "n", 2 * state["n"]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stash(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = join_hubs(large, least, "u", "n", 2 * state["n"])
        least = least.drop("n")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u > v").distinct()
        e = stash(small, "edges")
