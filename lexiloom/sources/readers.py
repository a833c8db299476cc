"""Sources and sinks of posts, user metadata, word lists and predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a post and what they are called in raw tweets and comments.
TWEET = {"user_id_str": "user_id_str", "created_utc": "created_utc", "text": "text", "id_str": "tweet_id"}
COMMENT = {"author": "user_id_str", "created_utc": "created_utc", "body": "text", "id": "comment_id", "subreddit": "subreddit"}
SUBMISSION = {"author": "user_id_str", "created_utc": "created_utc", "selftext": "text", "title": "title", "id": "submission_id", "subreddit": "subreddit"}

USER_JSON = "id string, label array<string>, posts array<array<string>>"
METADATA = "user_id_str string, depression string, gender string, age double, datasets array<string>, split string, num_posts long, num_words long"


def rename(df: DataFrame, schema: dict[str, str], tolerant: bool = False) -> DataFrame:
    """Subset and rename by a schema map; ``tolerant`` makes absent columns null."""
    pick = lambda raw, name: F.col(raw).alias(name) if raw in df.columns or not tolerant else F.lit(None).cast("string").alias(name)
    return df.select(*(pick(raw, name) for raw, name in schema.items()))


def read_posts(spark: SparkSession, path: str, schema: dict[str, str], lines: bool = True, tolerant: bool = False, ddl: str | None = None) -> DataFrame:
    """Raw posts as JSON lines or arrays, plain or gzip; a schema spares the pass that infers one."""
    reader = spark.read.schema(ddl) if ddl else spark.read
    return rename(reader.option("multiLine", str(not lines).lower()).json(path), schema, tolerant)


def flatten_tweets(df: DataFrame) -> DataFrame:
    """The longest text there is, and ``user_*`` columns of the nested user."""
    fields = {f.name: f.dataType for f in df.schema}
    texts = [F.col(c) for c in ("full_text", "text") if c in fields]
    if "extended_tweet" in fields:
        texts.insert(0, F.col("extended_tweet.full_text"))
    user = [F.col(f"user.{f.name}").alias(f"user_{f.name}") for f in fields["user"].fields] if "user" in fields else []
    rest = [F.col(c) for c in fields if c not in ("user", "text", "full_text", "extended_tweet")]
    return df.select(*rest, F.coalesce(*texts).alias("text"), *user)


def clean_surrogates(text: Column) -> Column:
    """Replace code points that no valid text holds."""
    return F.regexp_replace(text, r"[\x{D800}-\x{DFFF}]", "�")


def read_users(spark: SparkSession, path: str, splits: dict[str, str]) -> DataFrame:
    """JSON lines, a user each, with ``posts`` as [time, text] pairs: (user_id_str, label, split, created_utc, text).

    ``splits`` maps a part of the file's name to the split.
    """
    raw = spark.read.schema(USER_JSON).json(path).withColumn("_file", F.input_file_name())
    split = F.coalesce(*(F.when(F.contains("_file", F.lit(part)), name) for part, name in splits.items()), F.lit(None).cast("string"))
    rows = raw.select(F.col("id").alias("user_id_str"), "label", split.alias("split"), F.explode("posts").alias("p"))
    return rows.select("user_id_str", "label", "split", F.get("p", 0).cast("long").alias("created_utc"), F.get("p", 1).alias("text"))


def read_metadata(spark: SparkSession, path: str, dataset: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """User metadata objects, of one dataset, and only of users whose data are there."""
    df = spark.read.schema(METADATA).option("multiLine", "true").json(path)
    if dataset:
        df = df.where(F.array_contains("datasets", dataset.split("-")[0]))
    return df.join(present.select("user_id_str").distinct(), "user_id_str", "left_semi") if present is not None else df


def unify_metadata(df: DataFrame, dataset: str) -> DataFrame:
    """One post count, a default split and the dataset's name."""
    counts = [F.col(c) for c in ("num_tweets", "num_comments", "num_posts") if c in df.columns]
    split = F.coalesce(F.col("split"), F.lit("train")) if "split" in df.columns else F.lit("train")
    return df.withColumn("num_posts", F.coalesce(*counts, F.lit(None).cast("long"))).withColumn("split", split).withColumn("dataset", F.lit(dataset))


def read_table(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """A text table without a header."""
    return spark.read.option("sep", sep).option("header", "false").csv(path).toDF(*names)


def read_embeddings(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, strip_hashtags: bool = True) -> DataFrame:
    """(key, vector) of lines ``token v1 … vd``, of tokens the vocabulary's ``term`` holds; entries in angle brackets are skipped."""
    parts = F.split("value", " ")
    df = spark.read.text(path).select(F.get(parts, 0).alias("key"), F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("double")).alias("vector")).where(~F.col("key").startswith("<"))
    if strip_hashtags:
        df = df.withColumn("key", F.regexp_replace("key", "^#(.+)$", "$1"))
    return df.join(vocabulary.select(F.col("term").alias("key")), "key", "left_semi") if vocabulary is not None else df


def read_embedding_vocabulary(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Terms of the first ``size`` lines of an embedding file; hashtags take the sentinel form."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    # Within a task lines come in order; a block's first line follows the block before it.
    first = lines.orderBy("_file", "_start", "_id").limit(size).select(F.get(F.split("value", " "), 0).alias("term"))
    return first.where(~F.col("term").startswith("<")).select(F.regexp_replace("term", "^#(.+)$", "<HASHTAG=$1>").alias("term")).distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(entry, is_prefix, dim) of a dictionary: ``id name`` lines between two ``%`` lines, then ``word id …`` lines.

    A word with a final ``*`` is a prefix.  The file is a dictionary, a few thousand lines.
    """
    raw = spark.read.text(path, wholetext=True).select(F.split("value", "(?m)^%\\s*$").alias("p"))
    lines = lambda i: F.explode(F.split(F.get("p", i), r"\r?\n"))
    fields = F.split(F.trim("line"), r"\s+")
    dims = raw.select(lines(1).alias("line")).where("trim(line) <> ''").select(F.get(fields, 0).alias("id"), F.get(fields, 1).alias("dim"))
    words = raw.select(lines(2).alias("line")).where("trim(line) <> ''").select(F.get(fields, 0).alias("w"), F.explode(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))).alias("id"))
    return words.join(dims, "id").select(F.regexp_replace("w", r"\*$", "").alias("entry"), F.col("w").endswith("*").alias("is_prefix"), "dim")


def split_link(df: DataFrame, col: str = "link_id") -> DataFrame:
    """The id behind the kind prefix of a link."""
    return df.withColumn(col, F.coalesce(F.get(F.split(col, "_"), 1), F.col(col)))


def without_deleted(df: DataFrame, author: str = "author") -> DataFrame:
    return df.where(~F.col(author).isin("[deleted]", "[removed]"))


def min_words(comments: DataFrame, submissions: DataFrame, least: int) -> DataFrame:
    """(author, n_words) of authors with enough words over comment bodies, titles and texts."""
    n = lambda c: F.coalesce(F.size(F.split(F.trim(c), r"\s+")), F.lit(0)).cast("long")
    both = comments.select("author", n("body").alias("n")).unionByName(submissions.select("author", (n("title") + n("selftext")).alias("n")))
    return both.groupBy("author").agg(F.sum("n").alias("n_words")).where(F.col("n_words") >= least)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """(sample_group, fold, role, source, label), a folder for each role."""
    df.write.mode("overwrite").partitionBy("role").parquet(path)


def read_results(spark: SparkSession, path: str, metadata: DataFrame | None = None, on: str = "experiment") -> DataFrame:
    """All predictions or scores below a path with each experiment's settings."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return df.join(metadata, on, "left") if metadata is not None else df


def scan_results(spark: SparkSession, path: str, config: str, prefix: str = "", schema: str = "source string, fold int, `group` string, y_true int, y_pred double") -> DataFrame:
    """Predictions of all runs below ``path`` whose folder's name holds ``prefix``, each row with its run and its run's settings.

    A run is a folder with one JSON configuration (``splits.json`` is none) and ``cross_validation/predictions.csv``;
    ``config`` is the schema of the settings wanted, absent ones are null.  A run without predictions has no row, one
    without a configuration has null settings.
    """
    name = lambda up: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - up)
    files = spark.read.text(f"{path.rstrip('/')}/*{prefix}*/*.json", wholetext=True)
    settings = files.where(name(0) != "splits.json").select(name(1).alias("run"), F.from_json("value", config).alias("_c")).groupBy("run").agg(F.first("_c").alias("_c"))
    rows = spark.read.schema(schema).option("header", "true").csv(f"{path.rstrip('/')}/*{prefix}*/cross_validation/predictions.csv")
    rows = rows.select("*", name(2).alias("run"))
    return rows.join(settings, "run", "left").select("run", *(c for c in rows.columns if c != "run"), "_c.*")


def user_histories(posts: DataFrame, by: str = "user_id_str", transform: Callable | None = None) -> DataFrame:
    """Posts with their place in the user's history, newest first; never one row or file a user."""
    from pyspark.sql import Window

    out = posts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_utc"))))
    return transform(out) if transform else out


def discover(path: str, suffix: str = ".gz", spark: SparkSession | None = None) -> dict[str, str]:
    """Options for a reader: a file is read alone, of a folder the files with the suffix.

    With a session the path is looked up, so that a file without the suffix is read too.
    """
    if path.endswith(suffix):
        return {}
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(where) and files.getFileStatus(where).isFile():
            return {}
    return {"pathGlobFilter": f"*{suffix}"}


def write_metadata(df: DataFrame, path: str) -> None:
    """User metadata as CSV with a header, lists as JSON; a folder, a file a task."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    df.withColumns({c: F.to_json(c) for c in lists}).write.mode("overwrite").option("header", "true").csv(path)


def read_metadata_csv(spark: SparkSession, path: str, schema: str, isolate: Callable[[DataFrame], DataFrame] | None = None, root: str | None = None) -> DataFrame:
    """Metadata that ``write_metadata`` wrote; ``isolate`` chooses controls, relative sources get ``root`` before them."""
    want = spark.createDataFrame([], schema).schema
    text = ", ".join(f"`{f.name}` {'string' if f.dataType.typeName() == 'array' else f.dataType.simpleString()}" for f in want)
    df = spark.read.option("header", "true").schema(text).csv(path)
    df = df.withColumns({f.name: F.from_json(f.name, f.dataType.simpleString()) for f in want if f.dataType.typeName() == "array"})
    df = isolate(df) if isolate else df
    if root is not None:
        absolute = F.col("source").startswith("/") | F.contains("source", F.lit("://"))
        df = df.withColumn("source", F.when(absolute, F.col("source")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("source", r"^\./", ""))))
    return df
