"""The corpus pipeline: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; a stage's result
is written as Parquet and read again.  All but the last return the columns of ``documents``.

Defined cases: a null or empty text has the toxicity score of the bias alone and no language, so the
language stage drops it; rows with null ids are kept like others, repeated rows (equal id and text)
leave the near-duplicate stage once, other columns pass through under their names, whatever these
are; of near-duplicates with equal smallest ids one row stays; an empty table gives no row; very
long texts are read whole; without a label or language to learn from, the toxicity stage drops
nothing and the language stage everything.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import langid, minhash, packing, toxicity
from lexiloom.llm.common import stash

#: Documents at or above this toxicity score go.
TOXIC_FROM = 0.5
#: Documents whose language is undetermined, or found with a lower score, go.
LANGUAGE_FROM = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its text: no column of ``docs`` can clash with a result's."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents among ``docs`` and keep those that score below ``TOXIC_FROM``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(_rows(docs), model, keep=("row",))
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language."""
    found = langid.identify(_rows(docs), langid.fit(docs), keep=("row",))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_FROM)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that similarities of 0.8 or more connect."""
    found = minhash.near_duplicates(docs, percent=80)
    one = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key")).alias("d"))
    empty = found.where("component is null").select("doc_id", "row_key")
    kept = one.select("d.doc_id", "d.row_key").union(empty).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into token windows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and packing have no SQL.
ORACLE_SQL = None
