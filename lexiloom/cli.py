"""Command line: ``python -m lexiloom.cli train | infer | evaluate``.

Posts are Parquet tables (source, tokens) or (source, text), with created_utc, subreddit and ordinal where a
configuration's options need them; labels are (source, y).
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokenizer import modelling_tokenizer
from .operators import config as cf
from .operators import evaluation as ev
from .operators import search as se
from .operators import splits as sp
from .operators import text_model as tm
from .operators.loader import PostLoader
from .sources import readers


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts with a source and tokens, tokenised where the table has only texts."""
    df = spark.read.parquet(path)
    return df if "tokens" in df.columns else df.withColumn("tokens", modelling_tokenizer()(F.col("text")))


def filtered(posts: DataFrame, loader: PostLoader, **chosen) -> DataFrame:
    """(source, tokens) of the posts that a loader leaves.

    Dates, caps and samples need the posts' ``created_utc``; ValueError where they are asked for without it.
    """
    timed = loader.max_documents_per_user is not None or any(chosen.values())
    if timed and "created_utc" not in posts.columns:
        raise ValueError("the posts have no created_utc, which dates, caps and samples need")
    posts = posts.withColumn("user", F.col("source"))
    if "ordinal" not in posts.columns:
        posts = posts.withColumn("ordinal", F.xxhash64(*sorted(posts.columns)))
    return (loader.load(posts, **chosen) if timed else loader.filter(posts)).select("source", "tokens")


def resources(spark: SparkSession, lexicon: str | None = None, embeddings: str | None = None) -> dict[str, DataFrame]:
    """Tables that some feature families need: a ``.dic`` file or Parquet (entry, is_prefix, dim); a ``.txt`` file or Parquet (key, vector)."""
    out = {}
    if lexicon:
        out["lexicon"] = readers.read_lexicon(spark, lexicon) if lexicon.endswith(".dic") else spark.read.parquet(lexicon)
    if embeddings:
        out["embeddings"] = readers.read_embeddings(spark, embeddings) if embeddings.endswith(".txt") else spark.read.parquet(embeddings)
    return out


def train(spark: SparkSession, config: str, posts: str, labels: str, out: str, lexicon: str | None = None, embeddings: str | None = None, excluded: str | None = None) -> str:
    """Cross-validate, fit and score the test set; the output folder holds the configuration, splits, predictions, scores and model."""
    c = cf.load_config(spark, config, out)
    lists = json.loads("\n".join(r["value"] for r in spark.read.text(excluded, wholetext=True).collect())) if excluded else None
    options, given, raw = cf.text_model(c), resources(spark, lexicon, embeddings), read_posts(spark, posts)
    y = spark.read.parquet(labels).where("y in (0, 1)").select("source", F.col("y").cast("int").alias("label"))
    splits = sp.split_data(y, cf.split_config(c))
    readers.write_splits(splits, f"{c['outdir']}/splits")
    splits = spark.read.parquet(f"{c['outdir']}/splits")
    texts = {side: filtered(raw, cf.post_loader(c, lists), **cf.post_selection(c, side)) for side in ("train", "test")}
    if c["grid_search"]:
        whole = sp.recombine(splits).where("role = 'train'").select("source", F.col("label").alias("y"))
        best, tried = se.search(options, c["grid_search_specification"], texts["train"], whole, share=c["grid_search_kwargs"]["test_size"], refit=False, **given)
        tried.write.parquet(f"{c['outdir']}/search")
        options = best.options

    def scored(fitted: tm.FittedTextModel, held: DataFrame, side: str, fold: int) -> None:
        """Aligned predictions of the users of one fold; users without a known term go where the side drops them."""
        mine = texts[side].join(held.select("source"), "source", "left_semi")
        rows, truth = fitted.predict(mine), held.withColumnRenamed("y", "y_true")
        if cf._side(c.get("drop_null"), side, False):
            known = fitted.with_terms(mine)
            rows, truth = rows.join(known, "source", "left_semi"), truth.join(known, "source", "left_semi")
        ev.align(truth, rows).select("source", "y_true", "y_pred", F.lit(fold).alias("fold"), F.lit("dev" if side == "train" else "test").alias("group")).write.mode("append").parquet(f"{c['outdir']}/predictions")

    for fold in range(1, c["kfolds"] + 1):
        side = {r: splits.where((F.col("part") == "train") & (F.col("fold") == fold) & (F.col("role") == r)).select("source", F.col("label").alias("y")) for r in ("train", "dev")}
        scored(options.fit(texts["train"], side["train"], **given), side["dev"], "train", fold)
    whole = sp.recombine(splits)
    final = options.fit(texts["train"], whole.where("role = 'train'").select("source", F.col("label").alias("y")), **given)
    final.save(f"{c['outdir']}/model")
    spark.createDataFrame([(json.dumps(asdict(cf.post_loader(c, lists))),)], "loader string").coalesce(1).write.parquet(f"{c['outdir']}/model/loader")
    held = whole.where("role = 'test'").select("source", F.col("label").alias("y"))
    if held.limit(1).count():
        scored(final, held, "test", 0)
    rows = spark.read.parquet(f"{c['outdir']}/predictions")
    ev.scores(rows, ["group", "fold"]).write.parquet(f"{c['outdir']}/scores")
    return c["outdir"]


def infer(spark: SparkSession, model: str, posts: str, out: str, lexicon: str | None = None, embeddings: str | None = None) -> None:
    """Predictions of a trained model, whose post and token filters the posts go through first."""
    kept = json.loads(spark.read.parquet(f"{model}/loader").first()["loader"])
    loader = PostLoader(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items()})
    mine = filtered(read_posts(spark, posts), loader)
    readers.write_predictions(tm.load(spark, model, **resources(spark, lexicon, embeddings)).predict(mine), out)


def evaluate(spark: SparkSession, predictions: str, labels: str, out: str) -> None:
    truth = spark.read.parquet(labels).select("source", F.col("y").alias("y_true"))
    rows = ev.align(truth, spark.read.json(predictions).select(F.col("source").cast(truth.schema["source"].dataType), "y_pred")).withColumn("group", F.lit("all"))
    ev.report(rows, ["group"]).join(ev.auc(rows, ["group"]), "group").write.mode("overwrite").parquet(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexiloom")
    commands = p.add_subparsers(dest="command", required=True)
    for fn, names, extra in ((train, "config posts labels out", "lexicon embeddings excluded"), (infer, "model posts out", "lexicon embeddings"), (evaluate, "predictions labels out", "")):
        c = commands.add_parser(fn.__name__, help=fn.__doc__)
        for n in names.split():
            c.add_argument(n)
        for n in extra.split():
            c.add_argument(f"--{n}")
        c.set_defaults(run=fn)
    args = vars(p.parse_args(argv))
    args.pop("command")
    run = args.pop("run")
    print(run(SparkSession.builder.getOrCreate(), **args) or "")


if __name__ == "__main__":
    main()
