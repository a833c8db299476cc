"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ASCII_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and the master is local (tests, one machine) a temporary folder
    is made and set; on a cluster without the setting this raises.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return stash_at(df, tag)[0]


def stash_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As ``stash``, with the table's path, for ``discard`` when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case."""
    return text.translate(_UPPER).split()


def segments(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Cut at white space into pieces of about ``size`` bytes, so that long texts need little memory."""
    at, n = 0, len(data)
    while n - at > size:
        end = at + size
        while end < n and data[end] not in ASCII_SPACE:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public constants of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fraction_hash(column: str, mod: int) -> str:
    """SQL for ``crc32(column as text) mod n``; null ids count as the text 'null'."""
    return f"pmod(crc32(cast(coalesce(cast({column} as string), 'null') as binary)), {mod})"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def quiet_threads() -> None:
    """One thread for each Python worker: the scheduler counts cores, not libraries."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


quiet_threads()
