"""Histories as files: gzip JSON lists of one user's posts, written and read as a Python data source.

``spark.read.format("user_files")`` reads a folder.  The options ``sources`` (a JSON list), ``min_date`` and
``max_date`` (seconds, both included) reach the reader: a file that can hold no wanted post isn't opened, and
no other post leaves the reader.  They are options and not filters that Spark pushes down, because Spark
keeps a Python source's pushed filters for later plans of the same DataFrame, which would then lack rows.
What a file holds (user, first and last post) stands in a manifest that the task that wrote it left; tasks
of the reader prune their own manifests, so the driver sees a name a task, never a name a file.  Folders
without manifests (written by others) are listed, and a file's name before ``.json.gz`` is its user.

Writing is all or nothing: a manifest counts when a commit names it, and the commit is one file, written
last.  Files of failed or repeated tasks are named by none and are never read.  A user's history is cut
into files of at most ``POSTS_A_FILE`` posts, and a frequent user's posts are dealt to many tasks.

Defined cases: posts with a null source are written under the empty name and read as null; a null date is in
no range but is read where no date is asked for; fields that a post lacks are null; fields that the schema
doesn't name are ignored; an empty list gives no row; an empty table is committed and read as no rows.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "source string, created_utc long, text string"
SUFFIX = ".json.gz"
POSTS_A_FILE = 10_000
#: Files of folders without manifests are dealt to tasks by so many bytes.
TASK_BYTES = 32 << 20
_MANIFESTS, _COMMITS = "_manifests", "_commits"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _names(files, folder: str, suffix: str) -> list:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((i for i in found if i.is_file and i.base_name.endswith(suffix)), key=lambda i: i.path)


@dataclass
class Wanted:
    """Users (None: all) and the closed range of dates (None: open)."""

    sources: frozenset | None = None
    least: int | None = None
    most: int | None = None

    @classmethod
    def of(cls, options: dict) -> Wanted:
        whole = lambda name: int(options[name]) if options.get(name) else None
        return cls(frozenset(json.loads(options["sources"])) if options.get("sources") else None, whole("min_date"), whole("max_date"))

    def post(self, at: int | None) -> bool:
        if self.least is None and self.most is None:
            return True
        return at is not None and (self.least is None or at >= self.least) and (self.most is None or at <= self.most)

    def file(self, entry: dict) -> bool:
        """Whether a file may hold a wanted post."""
        if self.sources is not None and entry["source"] not in self.sources:
            return False
        if (self.least is None and self.most is None) or "first" not in entry:
            return True
        if entry["first"] is None:
            return False  # no post of it has a date
        return (self.least is None or entry["last"] >= self.least) and (self.most is None or entry["first"] <= self.most)


@dataclass
class Files(InputPartition):
    """A manifest, or the files of a folder without one."""

    manifest: str | None
    entries: tuple = ()


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, wanted: Wanted):
        self.path, self.schema, self.wanted = path, schema, wanted

    def partitions(self) -> list[InputPartition]:
        files, root = _fs(self.path)
        commits = _names(files, f"{root}/{_COMMITS}", ".json")
        if commits:
            made: list[str] = []
            for c in commits:
                with files.open_input_stream(c.path) as f:
                    made += json.loads(f.read())["manifests"]
            return [Files(f"{root}/{_MANIFESTS}/{m}") for m in made] or [Files(None)]
        out, held, size = [], [], 0
        for i in _names(files, root, SUFFIX):
            entry = {"file": i.base_name, "source": i.base_name[: -len(SUFFIX)]}
            if not self.wanted.file(entry):
                continue
            held.append(entry)
            size += i.size
            if size >= TASK_BYTES:
                out, held, size = [*out, Files(None, tuple(held))], [], 0
        return [*out, Files(None, tuple(held))]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, root = _fs(self.path)
        entries = partition.entries
        if partition.manifest:
            with files.open_input_stream(partition.manifest) as f:
                entries = [json.loads(line) for line in f.read().decode().splitlines()]
        names = [f.name for f in self.schema]
        for e in entries:
            if self.wanted.file(e):
                with files.open_input_stream(f"{root}/{e['file']}", compression=None) as f:
                    posts = json.loads(gzip.decompress(f.read()))
                for p in posts:
                    if self.wanted.post(p.get("created_utc")):
                        p["source"] = e["source"]
                        yield tuple(p.get(n) for n in names)


@dataclass
class Written(WriterCommitMessage):
    manifest: str


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = _fs(self.path)
        files.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
        attempt, entries, held, user = uuid.uuid4().hex, [], [], None

        def flush() -> None:
            if not held:
                return
            name = f"{quote(user or '', safe='')[:100]}-{attempt[:12]}-{len(entries)}{SUFFIX}"
            with files.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(gzip.compress(json.dumps(held).encode(), mtime=0))
            dates = [p["created_utc"] for p in held if p.get("created_utc") is not None]
            entries.append({"file": name, "source": user, "posts": len(held), "first": min(dates, default=None), "last": max(dates, default=None)})
            held.clear()

        for row in rows:
            post = row.asDict(recursive=True)
            source = post.pop("source", None)
            if source != user or len(held) >= POSTS_A_FILE:
                flush()
                user = source
            held.append(post)
        flush()
        with files.open_output_stream(f"{root}/{_MANIFESTS}/{attempt}.jsonl") as f:
            f.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        return Written(f"{attempt}.jsonl")

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _fs(self.path)
        files.create_dir(f"{root}/{_COMMITS}", recursive=True)
        before = _names(files, f"{root}/{_COMMITS}", ".json") if self.overwrite else []
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{root}/{_COMMITS}/{name}.tmp") as f:
            f.write(json.dumps({"manifests": [m.manifest for m in messages if m]}).encode())
        files.move(f"{root}/{_COMMITS}/{name}.tmp", f"{root}/{_COMMITS}/{name}.json")
        for c in before:
            files.delete_file(c.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing names what the tasks wrote, so nothing reads it."""


class UserFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "user_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, Wanted.of(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(UserFiles)


def read_user_files(spark: SparkSession, path: str, schema: str = SCHEMA, sources: list[str] | None = None, min_date: int | None = None, max_date: int | None = None) -> DataFrame:
    """Posts of a folder of user files, of the given users and seconds only; ``source`` is the user."""
    register(spark)
    options = {"sources": None if sources is None else json.dumps(sources), "min_date": min_date, "max_date": max_date}
    return spark.read.format("user_files").schema(schema).options(**{k: v for k, v in options.items() if v is not None}).load(path)


def write_user_files(posts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``posts(source, created_utc, ...)``: users in ranges, so that a frequent user's posts go to many tasks."""
    register(posts.sparkSession)
    rows = posts.withColumn("source", F.col("source").cast("string"))
    rows = rows.repartitionByRange("source", "created_utc").sortWithinPartitions("source", F.desc("created_utc"))
    rows.write.format("user_files").mode(mode).save(path)
