"""Quality of the operators on a folder of tables: ``python -m lexiloom.llm.measure DIR [name ...]``.

``python -m lexiloom.llm.measure 50000,200000 op9_made`` makes its own tables.

Prints a JSON line for each: held-out accuracy, recall against brute force, padding, held-out scores.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ann, packing, queries
from .vectors import matrix


def op3_lm_scores(spark: SparkSession, sf: str) -> dict:
    """Held-out log10 probabilities, of all documents and of those all of whose tokens are known."""
    d = queries.op3_lm_scores(spark, sf).where("held_out")
    sums = lambda x: [round(v or 0) for v in x.agg(F.sum("n_tokens"), F.sum("n_tokens") - F.sum("n_known"), F.sum("base_score"), F.sum("score")).first()]
    names = ("tokens", "unknown", "base", "score")
    d = d.cache()
    return {"all": dict(zip(names, sums(d), strict=True)), "all_known": dict(zip(names, sums(d.where("n_known = n_tokens")), strict=True))}


def op4_toxicity(spark: SparkSession, sf: str) -> dict:
    y = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    c = queries.op4_toxicity(spark, sf).where("held_out").join(y, "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("flagged"), F.count("*").alias("n")).collect()
    return {("toxic" if r["toxic"] else "clean"): {"flagged": r["flagged"], "of": r["n"]} for r in c}


def op5_packing(spark: SparkSession, sf: str) -> dict:
    """Share of the windows that is padding, by partitions; sequences of a power of two aren't padded."""
    out = {}
    for n in (1, 8, 211):
        pieces = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet").repartition(n), public_tokenizers.path("word_bpe_49k.json"))
        held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
        padded = F.when(F.col("n").isin([1 << k for k in range(12)]), F.col("n")).otherwise(F.lit(packing.WINDOW))
        r = held.agg(F.count("*").alias("windows"), (1 - F.sum("n") / F.sum(padded)).alias("padding")).first()
        out[f"partitions_{n}"] = {"windows": r["windows"], "padding": round(r["padding"], 4)}
    return out


def op8_language(spark: SparkSession, sf: str) -> dict:
    d = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    r = queries.op8_language(spark, sf).where("held_out and lang_pred <> 'und'").join(d, "doc_id").agg(F.count_if(F.col("lang") != F.col("lang_pred")).alias("wrong"), F.count("*").alias("n")).first()
    return {"wrong": r["wrong"], "of": r["n"]}


def op9_nearest(spark: SparkSession, sf: str, queries_at_most: int = 200) -> dict:
    """Recall of the 20 nearest against brute force, and the share of the rows that a query reads."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toArrow()
    ids, x = rows["vec_id"].to_numpy(), matrix(rows["embedding"].combine_chunks(), "<f8")
    read: dict = {}
    got: dict[int, set] = {}
    for r in ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id % 20 = 0", report=read).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [q for q in np.flatnonzero(ids % 20 == 0).tolist()][:queries_at_most]
    hit = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got.get(int(ids[q]), set()) & {int(i) for i in ids[np.lexsort((ids, -s))[:20]]})
    return {"recall": round(hit / (20 * len(asked)), 4), "rows": len(ids), **read}


def made_vectors(spark: SparkSession, n: int, clusters: int = 0, dim: int = 64, seed: int = 3):
    """(vec_id, embedding): unit vectors in random directions, or about as many centres as ``clusters`` says."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = 0.7 * x + rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": values})), x


def op9_made(spark: SparkSession, sizes: str) -> dict:
    """Recall and share read of 200 queries on made tables of so many rows (``50000,200000``), isotropic and clustered."""
    out = {}
    for n in map(int, sizes.split(",")):
        for name, clusters in (("isotropic", 0), ("clustered", max(20, n // 500))):
            df, x = made_vectors(spark, n, clusters)
            step, read, got = n // 200, {}, {}
            for r in ann.nearest(df, f"vec_id % {step} = 0", report=read).collect():
                got.setdefault(r["query_id"], set()).add(r["vec_id"])
            hit = 0
            for q in got:
                s = x.astype(float) @ x[q].astype(float)
                s[q] = -np.inf
                hit += len(got[q] & {int(i) for i in np.argpartition(-s, 20)[:20]})
            out[f"{n}_{name}"] = {"recall": round(hit / (20 * len(got)), 4), **read}
    return out


MEASURES = {f.__name__: f for f in (op3_lm_scores, op4_toxicity, op5_packing, op8_language, op9_nearest)}
#: Those that make their own tables and take their sizes instead of a folder.
MADE = {f.__name__: f for f in (op9_made,)}


def main() -> None:
    sf, *names = sys.argv[1:]
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or MEASURES:
        print(json.dumps({"name": name, "tables": sf, **(MEASURES | MADE)[name](spark, sf)}), flush=True)


if __name__ == "__main__":
    main()
