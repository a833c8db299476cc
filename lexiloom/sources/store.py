"""A store of tables that say what made them: made once, shared while anyone holds them, deleted after.

A table's key is a hash of the parts that determine it: options, the keys of the tables it is made of,
fingerprints of given ones.  Who asks for a key that has a finished table gets that table.  ``holding``
counts the tables that are used inside it; when the last one that holds a table ends, the table goes.
A folder that outlives the session makes the store resumable: a table without the writer's success mark
was left by a killed run and is made anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import root_of


def digest(*parts) -> str:
    """A hash of options, names and keys; dataclasses count by their fields, mappings whatever their order."""
    plain = [asdict(p) if is_dataclass(p) else p for p in parts]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:32]


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order and partitions; repeated rows count.  One pass, two numbers a task."""
    names = sorted(df.columns)
    parts = [F.xxhash64(F.lit(seed), *(F.struct(F.lit(n), F.col(f"`{n}`")) for n in names)).cast("decimal(38,0)") for seed in (1, 2)]
    row = df.select(parts[0].alias("a"), parts[1].alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return digest(names, [str(v) for v in row])


class TableStore:
    """``root``: a folder that all executors share; without one the tables go below the scratch folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{root_of(spark)}/store-{uuid.uuid4().hex}").rstrip("/")
        #: How often each table was made, by its tag: what sharing saved.
        self.made: Counter = Counter()
        self._held: Counter = Counter()
        self._open: list[set[str]] = []
        self._values: dict[str, object] = {}

    def path(self, tag: str, key: str) -> str:
        return f"{self.root}/{tag}-{key}"

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        """Whether a table was written to its end."""
        files, where = self._files(f"{path}/_SUCCESS")
        return files.exists(where)

    def finished(self, tag: str) -> list[str]:
        """Paths of the whole tables with a tag."""
        files, where = self._files(self.root)
        found = [str(s.getPath()) for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(p for p in found if p.rpartition("/")[2].startswith(f"{tag}-") and self.exists(p))

    def delete(self, path: str) -> None:
        files, where = self._files(path)
        files.delete(where, True)

    def table(self, tag: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table under a key, made by ``make`` if it isn't there; a scope that is open holds it."""
        path = self.path(tag, key)
        if not self.exists(path):
            df = make()
            df.write.mode("overwrite").parquet(path)
            self.made[tag] += 1
        if self._open and path not in self._open[-1]:
            self._open[-1].add(path)
            self._held[path] += 1
        return self.spark.read.parquet(path)

    def value(self, key: str, make: Callable[[], object]) -> object:
        """A small thing of the driver (a fitted model) under a key, kept until the store closes."""
        if key not in self._values:
            self._values[key] = make()
        return self._values[key]

    @contextmanager
    def holding(self) -> Iterator[TableStore]:
        """Tables asked for inside are held until its end; what no other scope holds is deleted then."""
        mine: set[str] = set()
        self._open.append(mine)
        try:
            yield self
        finally:
            self._open.remove(mine)
            for path in mine:
                self._held[path] -= 1
                if not self._held[path]:
                    del self._held[path]
                    self.delete(path)

    def close(self) -> None:
        """Delete all that is left, tables of killed runs too."""
        self._values.clear()
        self._held.clear()
        self.delete(self.root)

    def __enter__(self) -> TableStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
