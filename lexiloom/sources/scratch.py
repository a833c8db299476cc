"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def root_of(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of its own where unset, on a local master only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stash(df: DataFrame, tag: str, schema: StructType | None = None) -> DataFrame:
    """Write to the scratch folder and read back, under ``schema`` if given."""
    spark = df.sparkSession
    path = f"{root_of(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
