"""Training, development and test splits as long tables: (part, fold, role, source, label).

``part`` is ``train`` (folds 1 to k with the roles train and dev) or ``test`` (fold 1 with the role
test).  Draws follow a hash of the source and the seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling as sm
from .temporal import time_bins, valid_bins

COLUMNS = ("part", "fold", "role", "source", "label")


@dataclass(frozen=True)
class SplitConfig:
    """``class_ratio`` is (target, control); a size bounds a set after any rebalancing; None: no change."""

    kfolds: int = 5
    test_size: float = 0.2
    stratified: bool = True
    seed: int = 42
    class_ratio: tuple[int, int] | None = None
    downsample: int | None = None
    class_ratio_test: tuple[int, int] | None = None
    downsample_test: int | None = None

    def __post_init__(self) -> None:
        if self.kfolds < 2:
            raise ValueError("kfolds must be at least 2")
        if not 0 <= self.test_size < 1:
            raise ValueError("test_size must be 0 or lie between 0 and 1")


def _cut(df: DataFrame, ratio: tuple[int, int] | None, size: int | None, seed: int) -> DataFrame:
    if ratio:
        df = sm.rebalance(df, "label", "source", ratio, seed)
    return sm.downsample(df, size, "source", seed) if size is not None else df


def _folds(df: DataFrame, config: SplitConfig) -> DataFrame:
    if config.stratified:
        return sm.stratified_folds(df, "label", "source", config.kfolds, config.seed)
    return sm.stratified_folds(df.withColumn("_all", F.lit(0)), "_all", "source", config.kfolds, config.seed).drop("_all")


def _roles(train: DataFrame, dev: DataFrame, config: SplitConfig) -> DataFrame:
    """Each fold trains on the others' sources and is tried on its own."""
    every = train.withColumn("held", F.col("fold")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(config.kfolds)))).where("fold <> held")
    train = every.select(F.lit("train").alias("part"), F.col("fold").cast("int").alias("fold"), F.lit("train").alias("role"), "source", "label")
    return train.union(dev.select(F.lit("train"), F.col("fold").cast("int"), F.lit("dev"), "source", "label"))


def split_data(metadata: DataFrame, config: SplitConfig) -> DataFrame:
    """Splits of ``metadata(source, label[, split])``.

    A ``split`` column without nulls decides; without one, a test set of ``test_size`` of each class
    is held out.  Where there are predefined dev rows, folds try those, else the training rows.
    """
    predefined = "split" in metadata.columns and not metadata.where("split is null").limit(1).count()
    if predefined:
        test, train = metadata.where("split = 'test'"), metadata.where("split = 'train'")
        dev = metadata.where("split = 'dev'") if metadata.where("split = 'dev'").limit(1).count() else train
    else:
        role = sm.held_out_split(metadata, "label", "source", config.test_size, config.seed)
        test, train = role.where("role = 'test'"), role.where("role = 'train'")
        dev = train
    test, train, dev = (d.select("source", "label") for d in (test, train, dev))
    train, dev = (_folds(_cut(d, config.class_ratio, config.downsample, config.seed), config) for d in (train, dev))
    test = _cut(test, config.class_ratio_test, config.downsample_test, config.seed)
    return _roles(train, dev, config).union(test.select(F.lit("test"), F.lit(1), F.lit("test"), "source", "label"))


def recombine(splits: DataFrame) -> DataFrame:
    """(role, source, label): the dev sets of all folds are the whole training set."""
    return splits.where("role in ('dev', 'test')").select(F.when(F.col("role") == "dev", "train").otherwise("test").alias("role"), "source", "label").distinct()


def pair_across(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training sets of one domain with the dev and test sets of another, fold by fold."""
    return train.where("role = 'train'").select(*COLUMNS).union(test.where("role <> 'train'").select(*COLUMNS))


def split_sizes(splits: DataFrame, by: list[str], folds: list[int]) -> DataFrame:
    """Number of sources of each role as a matrix, a column for each fold; 0 where there is none."""
    wide = splits.groupBy(*by, "role").pivot("fold", folds).agg(F.count("source"))
    return wide.na.fill(0, [str(f) for f in folds])


#: How controls are chosen for each kind of data set.
CONTROLS = {"clpsych": "age_gender", "clpsych_deduped": "age_gender", "multitask": "pairs", "merged": "both", "smhd": "not_relaxed"}


def isolate_controls(metadata: DataFrame, dataset: str, n: int | None = None, target: str = "target", control: str = "control", lo: float | None = None, hi: float | None = None, bins: int = 100, seed: int = 42, genders: tuple[str, ...] | None = None) -> DataFrame:
    """The targets and the controls that the data set's rule chooses; other data sets keep all.

    ``metadata(source, label, split, gender, age, matches, datasets)``; rows with a null label go.  Controls by age and
    gender: as many as there are targets of a split and gender (or ``n``), drawn by the targets' ages in ``bins``
    between their least and largest age (or ``lo`` and ``hi``); ``genders`` leaves out all others, targets too.
    """
    df = metadata.where("label is not null")
    rule = CONTROLS.get(dataset)

    def by_age(d: DataFrame) -> DataFrame:
        d = d.where(F.col("gender").isin(*genders)) if genders else d
        targets = d.where(F.col("label") == target)
        return targets.unionByName(sm.histogram_matched(d.where(F.col("label") == control), targets, "age", "source", n, lo, hi, bins, ["split", "gender"], seed))

    def pairs(d: DataFrame) -> DataFrame:
        wanted = sm.matched_pairs(d.where(F.col("label") == target), d.where(F.col("label") == control), "matches", "source")
        return d.join(wanted.select("source"), "source", "left_semi").select(d.columns)

    if rule == "age_gender":
        return by_age(df)
    if rule == "pairs":
        return pairs(df)
    if rule == "both":
        holds = lambda name: F.exists("datasets", lambda x: x.contains(name))
        return by_age(df.where(holds("clpsych"))).unionByName(pairs(df.where(holds("multitask"))))
    return df.where("split <> 'relaxed'") if rule == "not_relaxed" else df


def one_hot(df: DataFrame, labels: str, mapping: dict[str, str]) -> DataFrame:
    """A 0/1 column for each condition: raw names in the list are mapped first, unknown ones ignored."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    mapped = F.array_distinct(F.transform(F.coalesce(F.col(labels), F.array().cast("array<string>")), lambda x: F.try_element_at(table, F.lower(x))))
    return df.withColumn("_mapped", mapped).select(*df.columns, *(F.coalesce(F.array_contains("_mapped", c), F.lit(False)).cast("int").alias(c) for c in dict.fromkeys(mapping.values())))


def without_anomalies(df: DataFrame, key: str, match: str, anomalies: DataFrame, flags: list[str]) -> DataFrame:
    """Rows that are no anomaly, have any flag, and whose match is such a row too."""
    def matched(d: DataFrame) -> DataFrame:
        present = d.select(F.col(key).alias("_k")).distinct()
        return d.join(present, d[match] == present["_k"], "left_semi")

    left = matched(df.join(anomalies.select(key).distinct(), key, "left_anti").select(df.columns))
    return matched(left.where(F.greatest(*flags, F.lit(0)) > 0))


def overlap_flags(df: DataFrame, key: str, **others: DataFrame) -> DataFrame:
    """``in_<name>``: whether each other table holds the row's key."""
    out = df
    for name, other in others.items():
        have = other.select(F.col(key)).distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(have, key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return out


def temporal_splits(posts: DataFrame, labels: DataFrame, bounds: list[str], config: SplitConfig, min_posts: int = 1, min_users: int = 2, balance: bool = False, user: str = "source", at: str = "at") -> DataFrame:
    """(bin, part, fold, role, source, label) of each period [b_i, b_i+1) in which every class has enough users.

    ``labels(source, y)`` is 1 for targets.  A period's test set is ``test_size`` of its targets and as
    many controls; the rest is rebalanced and bounded.  ``balance`` bounds the classes of all periods
    by the smallest.  Each period draws by a seed of its own.
    """
    counts = time_bins(posts.select(F.col(user).alias("source"), F.col(at).alias("at")), "source", "at", bounds)
    valid = valid_bins(counts, labels, "source", min_posts, min_users).where(F.col("bin") < len(bounds) - 1)
    users = counts.where(F.col("n") >= min_posts).join(labels, "source").join(F.broadcast(valid), "bin")  # one row a period
    out = None
    sizes = {r["bin"]: r["users"] for r in valid.collect()}
    least = min(sizes.values(), default=0)
    for k, b in enumerate(sorted(sizes)):
        seed = config.seed + k
        rows = users.where(F.col("bin") == b).select("source", F.col("y").alias("label"))
        n_test = F.floor(F.count_if(F.col("label") == 1) * config.test_size + 0.5)
        most = F.broadcast(rows.agg(n_test.alias("_n")))
        placed = sm._placed(rows, ["label"], "source", seed).crossJoin(most)
        test = placed.where("_p <= _n").select("source", "label")
        rest = placed.where("_p > _n").select("source", "label")
        if config.class_ratio:
            rest = sm.rebalance(rest, "label", "source", config.class_ratio, seed)
        bound = [x for x in (config.downsample, int(least * (1 - config.test_size)) if balance else None) if x is not None]
        if bound:
            rest = sm._placed(rest, ["label"], "source", seed + 1).where(F.col("_p") <= min(bound)).drop("_p")
        folds = _folds(rest, config)
        part = _roles(folds, folds, config).union(test.select(F.lit("test"), F.lit(1), F.lit("test"), "source", "label"))
        part = part.select(F.lit(b).alias("bin"), *COLUMNS)
        out = part if out is None else out.union(part)
    if out is None:
        kind = labels.schema["source"].dataType.simpleString()
        return labels.sparkSession.createDataFrame([], f"bin int, part string, fold int, role string, source {kind}, label int")
    return out


def assemble_predictions(predictions: DataFrame, splits: DataFrame, periods: DataFrame) -> DataFrame:
    """Predictions of every training period for every test period with their dates and ``user_in_training``.

    ``predictions(train_bin, test_bin, fold, source, y_pred)``, ``splits`` of ``temporal_splits``,
    ``periods(bin, lo, hi)``.
    """
    seen = splits.where("role = 'train'").select(F.col("bin").alias("train_bin"), "fold", "source").distinct().withColumn("_seen", F.lit(True))
    truth = splits.where("role <> 'train'").select(F.col("bin").alias("test_bin"), F.col("part"), F.col("fold").alias("_fold"), F.col("role").alias("group"), "source", F.col("label").alias("y_true"))
    on_fold = (F.col("group") == "test") | (F.col("fold") == F.col("_fold"))
    rows = predictions.join(truth, ["test_bin", "source"]).where(on_fold).drop("_fold", "part").join(seen, ["train_bin", "fold", "source"], "left")
    dates = lambda side: periods.select(F.col("bin").alias(f"{side}_bin"), F.col("lo").alias(f"{side}_min_date"), F.col("hi").alias(f"{side}_max_date"))
    rows = rows.join(dates("train"), "train_bin").join(dates("test"), "test_bin")
    return rows.withColumn("user_in_training", F.coalesce("_seen", F.lit(False))).drop("_seen")


def combination_sizes(predictions: DataFrame) -> DataFrame:
    """(group, train_bin, test_bin, fold, y_true, n, n_unseen) of every combination of the values there are."""
    keys = ["group", "train_bin", "test_bin", "fold", "y_true"]
    grid = None
    for k in keys:  # a few values each: groups, periods, folds, classes
        values = predictions.select(k).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    n = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("user_in_training")).alias("n_unseen"))
    return grid.join(n, keys, "left").na.fill(0, ["n", "n_unseen"])

