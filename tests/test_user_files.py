"""User files: round trips, what filters keep from being read, and writes that fail."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import user_files as uf

KIND = "source string, created_utc long, text string, tokens array<string>"


@pytest.fixture
def posts(spark):
    rows = [(f"u/{u}", 100 * u + k, f"t{u}.{k}", ["a", None] if k % 2 else None) for u in range(8) for k in range(5)]
    return spark.createDataFrame([*rows, ("u/0", None, None, []), (None, 7, "nobody", None)], KIND)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("source", "created_utc", "text", "tokens").collect()), key=repr)


def files_of(path):
    """Of each manifest's entries the path and the range of dates."""
    return [json.loads(line) for p in glob.glob(f"{path}/_manifests/*.jsonl") for line in open(p)]


def test_round_trip_and_cuts(spark, posts, tmp_path, monkeypatch):
    path = f"{tmp_path}/out"
    uf.write_user_files(posts, f"file://{path}")
    assert rows_of(uf.read_user_files(spark, f"file://{path}", KIND)) == rows_of(posts)
    narrow = uf.read_user_files(spark, f"file://{path}", "text string, absent double")
    assert narrow.count() == 42 and narrow.where("absent is not null").count() == 0
    uf.write_user_files(posts.limit(0), f"file://{path}")
    assert uf.read_user_files(spark, f"file://{path}").count() == 0
    uf.write_user_files(posts, f"file://{path}", "append")
    uf.write_user_files(posts, f"file://{path}", "append")
    assert uf.read_user_files(spark, f"file://{path}").count() == 84


def test_filters_keep_files_closed(spark, posts, tmp_path):
    """Files that can hold no wanted post are spoilt: reading one would fail."""
    path = f"{tmp_path}/out"
    uf.write_user_files(posts, f"file://{path}")
    entries = files_of(path)
    spoil = lambda keep: [open(f"{path}/{e['file']}", "wb").write(b"spoilt") for e in entries if not keep(e)]
    kept = lambda e: e["first"] is not None and e["last"] >= 300 and e["first"] <= 502
    assert 0 < sum(map(kept, entries)) < len(entries) / 2
    spoil(kept)
    back = lambda **kw: uf.read_user_files(spark, f"file://{path}", KIND, **kw)
    want = posts.where("created_utc >= 300 and created_utc <= 502")
    assert rows_of(back(min_date=300, max_date=502)) == rows_of(want)
    assert rows_of(back(min_date=300, max_date=502, sources=["u/4", "u/5"])) == rows_of(want.where("source in ('u/4', 'u/5')"))
    assert rows_of(back(sources=["u/4"])) == rows_of(posts.where("source = 'u/4'")) and back(sources=[]).count() == 0
    with pytest.raises(Exception, match="gzip|Gzip"):
        back().collect()


def test_a_failed_write_leaves_no_row(spark, posts, tmp_path):
    path = f"file://{tmp_path}/out"
    uf.write_user_files(posts.limit(3), path)
    broken = posts.withColumn("text", F.when(F.col("created_utc") == 502, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    uf.register(spark)
    with pytest.raises(Exception, match="lost"):
        broken.coalesce(2).write.format("user_files").mode("append").save(path)
    assert uf.read_user_files(spark, path).count() == 3
    open(f"{tmp_path}/out/stray{uf.SUFFIX}", "wb").write(gzip.compress(b'[{"text": "stray"}]'))  # of a task that died
    assert uf.read_user_files(spark, path).count() == 3


def test_folders_of_others(spark, tmp_path):
    for name, value in (("ann", [{"created_utc": 1, "text": "x", "extra": 3}, {"created_utc": 2}]), ("bob", []), ("cay", [{"text": "y"}])):
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(json.dumps(value).encode()))
    (tmp_path / "note.txt").write_text("no post")
    back = uf.read_user_files(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("ann", 1, "x"), ("ann", 2, None), ("cay", None, "y")], key=repr)
    (tmp_path / "cay.json.gz").write_bytes(b"spoilt")
    assert uf.read_user_files(spark, f"file://{tmp_path}", sources=["ann"]).count() == 2
    assert os.path.exists(tmp_path / "note.txt") and uf.read_user_files(spark, f"file://{tmp_path}/none").count() == 0


def test_long_histories_are_cut(tmp_path, monkeypatch):
    from pyspark.sql import Row

    monkeypatch.setattr(uf, "POSTS_A_FILE", 4)
    writer = uf.Writer(f"file://{tmp_path}/out", False)
    done = writer.write(iter([Row(source="hot", created_utc=i) for i in range(10)]))
    writer.commit([done])
    assert [(e["posts"], e["first"], e["last"]) for e in files_of(f"{tmp_path}/out")] == [(4, 0, 3), (4, 4, 7), (2, 8, 9)]
