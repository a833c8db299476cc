"""Registration of queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tokens as the SQL engine makes them.
TOK = """tok AS (SELECT doc_id, source, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zà-ÿ]+'), lambda x: x <> '') AS tokens FROM documents),
w AS (SELECT doc_id, source, lang, unnest(tokens) AS term FROM tok)"""
#: Document terms and labels of the toxic class.
DTM = TOK + """,
dtm AS (SELECT doc_id AS source, term, count(*) AS n FROM w GROUP BY ALL),
lab AS (SELECT doc_id AS source, toxic AS y FROM labels WHERE toxic IS NOT NULL)"""
#: Scores to evaluate: a hash of the document and a hint of its label.
PRED = """pred AS (SELECT l.doc_id, d.lang AS grp, toxic AS y_true,
  round(0.6 * (('0x' || substr(md5('7_' || l.doc_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE) + 0.4 * toxic, 3) AS y_pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, source: str = "source") -> DataFrame:
    """(source, tokens) of documents.

    By document, texts are dealt by their key before they become tokens: counts by document and windows over documents
    need no further shuffle, whose rows would be several times the text.
    """
    rows = table(spark, sf_dir, "documents").select(F.col(source).alias("source"), "text")
    if source == "doc_id":
        rows = rows.repartition("source")
    return rows.select("source", tx.words(F.col("text")).alias("tokens"))


#: Characters of text whose n-grams one task counts: a task's table holds a row for nearly each of them.
MOST_CHARS = 32_000_000


def dealt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, tokens) of documents as ``corpus`` has them; where splits of the files are large, texts are dealt to more tasks first.

    Nearly all n-grams of a text are distinct, so that a task's table of counts is many times its text, and once it exceeds
    the task's memory all of it is sorted and spilled.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    parts = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // MOST_CHARS)
    if parts > rows.rdd.getNumPartitions():
        rows = rows.repartition(parts, "doc_id")
    return rows.select("source", tx.words(F.col("text")).alias("tokens"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic is not null").select(F.col("doc_id").alias("source"), F.col("toxic").alias("y"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    score = F.round(F.lit(0.6) * tx.uniform(F.col("doc_id"), 7) + F.lit(0.4) * F.col("toxic"), 3)
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.col("lang").alias("grp"), F.col("toxic").alias("y_true"), score.alias("y_pred"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
