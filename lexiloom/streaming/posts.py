"""Incremental counts of posts: the streaming form of the time-bin operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, ddl: str, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", max_files).parquet(folder)


def windowed_counts(posts: DataFrame, at: str, by: list[str], window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(by, start, n) of each tumbling window; posts later than ``late`` behind the newest are dropped."""
    kept = posts.withWatermark(at, late)
    out = kept.groupBy(*by, F.window(at, window).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), "n")


def tokenized(posts: DataFrame, tokenizer, text: str = "text") -> DataFrame:
    """Posts with their tokens; stateless."""
    return posts.withColumn("tokens", tokenizer(F.col(text)))
