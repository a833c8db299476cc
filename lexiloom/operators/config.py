"""Experiment configurations: JSON objects, checked key by key and kept beside an experiment's output."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import fields
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from . import options as op
from .loader import PostLoader
from .selection import Selector
from .splits import SplitConfig
from .text_model import TextModel
from .vocabulary import Vocabulary

# Names of the options that existing configurations have.
# fmt: off
PRIMARY = [
    "experiment_name", "train_data", "target_disorder", "random_seed", "kfolds", "test_size", "downsample", "downsample_size", "rebalance",
    "class_ratio", "model", "model_kwargs", "vocab_kwargs", "grid_search", "grid_search_kwargs", "preprocessing_kwargs", "feature_selector",
    "feature_selection_kwargs",
]
EXTRA = {
    "model": [],
    "domain_transfer": ["test_data", "run_on_test", "date_boundaries"],
    "temporal_effects": ["test_data", "date_boundaries", "mixed_time_windows", "balance_date_splits", "run_on_test", "min_users_per_split", "min_posts"],
}
NESTED = {
    "preprocessing_kwargs": [
        "feature_flags", "feature_kwargs", "standardize",
    ],
    "vocab_kwargs": [
        "filter_negate", "filter_upper", "filter_punctuation", "filter_numeric", "filter_user_mentions", "filter_url", "filter_retweet",
        "filter_stopwords", "keep_pronouns", "preserve_case", "emoji_handling", "filter_mh_subreddits", "filter_mh_terms", "max_tokens_per_document",
        "max_documents_per_user", "max_vocab_size", "min_token_freq", "max_token_freq", "ngrams", "binarize_counter",
    ],
    "grid_search_kwargs": [
        "config", "test_size", "dev_frac", "dev_in_vocab", "score_func", "use_multiprocessing",
    ],
}
# fmt: on


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _optional(check: Callable) -> Callable:
    return lambda x: x is None or check(x)


#: What a value must be, by key; ``vocab_kwargs`` has checks of its own.
CHECKS: dict[str, Callable] = {
    "random_seed": _whole,
    "kfolds": lambda x: _whole(x) and x >= 2,
    "test_size": lambda x: isinstance(x, (int, float)) and 0 <= x < 1,
    "grid_search": lambda x: isinstance(x, bool),
    "model_kwargs": lambda x: isinstance(x, dict),
    "feature_selector": lambda x: x in (None, "kldivergence", "pmi"),
    "feature_selection_kwargs": lambda x: isinstance(x, dict),
    "max_tokens_per_document": _optional(_whole),
    "max_documents_per_user": _optional(_whole),
    "max_vocab_size": _optional(_whole),
    "min_token_freq": _optional(_whole),
    "max_token_freq": _optional(_whole),
    "emoji_handling": lambda x: x in (None, "replace", "strip"),
    "ngrams": lambda x: isinstance(x, (list, tuple)) and len(x) == 2 and all(map(_whole, x)) and 1 <= x[0] <= x[1],
    "standardize": lambda x: isinstance(x, bool),
}
CHECKS |= {k: lambda x: isinstance(x, bool) for k in NESTED["vocab_kwargs"] if k.startswith(("filter_", "keep_", "preserve_", "binarize_")) and "mh" not in k}


def validate(config: dict, kind: str = "model") -> dict:
    """The configuration itself; KeyError names a missing key, ValueError one with a wrong value."""
    if kind not in EXTRA:
        raise ValueError(f"kind must be one of {sorted(EXTRA)}")
    groups = [(config, PRIMARY + EXTRA[kind], "config")] + [(config.get(name) or {}, keys, name) for name, keys in NESTED.items()]
    for values, keys, where in groups:
        for key in keys:
            if key not in values:
                raise KeyError(f"{key} not found in {where}")
            if key in CHECKS and not CHECKS[key](values[key]):
                raise ValueError(f"{where}: {key} is wrongly specified: {values[key]!r}")
    return config


def load_config(spark: SparkSession, path: str, out_dir: str | None = None, kind: str = "model") -> dict:
    """Read and check a configuration.

    With ``out_dir`` a copy goes to a new folder ``<time>-<experiment>`` below it, named by ``outdir``;
    the search configuration that it names is copied into it.
    """
    text = lambda p: "\n".join(r["value"] for r in spark.read.text(p, wholetext=True).collect())  # noqa: E731  one small file
    config = validate(json.loads(text(path)), kind)
    if out_dir is None:
        return config
    config = copy.deepcopy(config)
    if config["grid_search"]:
        config["grid_search_specification"] = json.loads(text(config["grid_search_kwargs"]["config"]))
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")
    config["outdir"] = f"{out_dir.rstrip('/')}/{stamp}-{config['experiment_name']}"
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{config['outdir']}/config")
    return config


def split_config(config: dict, side: str = "train") -> SplitConfig:
    pick = lambda key: config[key][side] if isinstance(config[key], dict) else config[key]
    ratio = tuple(pick("class_ratio")) if pick("rebalance") and pick("class_ratio") else None
    return SplitConfig(config["kfolds"], config["test_size"], config.get("stratified", True), config["random_seed"], ratio, pick("downsample_size") if pick("downsample") else None)


def text_model(config: dict) -> TextModel:
    """Options of the model that a configuration describes."""
    v, p = config["vocab_kwargs"], config["preprocessing_kwargs"]
    vocabulary = Vocabulary(tuple(v["ngrams"]), v["min_token_freq"], v["max_token_freq"], v["max_vocab_size"], v["binarize_counter"])
    chosen = op.selector_options(config["feature_selection_kwargs"])
    selector = Selector(config["feature_selector"], **chosen)
    features = {name: op.feature_options(name, p["feature_kwargs"].get(name) or {}) for name, on in p["feature_flags"].items() if on}
    kwargs, weight = op.model_options(config["model"], config["model_kwargs"])
    drop_null = _side(config.get("drop_null"), "train", False)
    return TextModel(vocabulary, selector, features, p["standardize"], config["model"], kwargs, weight, config["random_seed"], drop_null)


def _side(value, side: str, default=None):
    """An option that may be given for each side."""
    value = value.get(side, default) if isinstance(value, dict) else value
    return default if value is None else value


def post_loader(config: dict, excluded: dict | None = None) -> PostLoader:
    """Post and token filters of a configuration.

    ``excluded`` holds the named lists that ``filter_mh_subreddits`` and ``filter_mh_terms`` ask for, below
    ``subreddits`` and ``terms``; ValueError if one is asked for and isn't there.
    """
    v = config["vocab_kwargs"]
    for key in ("external_vocab", "external_only"):
        if v.get(key):
            raise ValueError(f"vocab_kwargs: {key}={v[key]!r} can't be honoured")

    def listed(kind: str, name: str | None) -> tuple[str, ...]:
        if not name:
            return ()
        if name not in (excluded or {}).get(kind, {}):
            raise ValueError(f"vocab_kwargs: the list {name!r} of {kind} isn't given")
        return tuple(excluded[kind][name])

    same = {f.name for f in fields(PostLoader)} & set(v)
    return PostLoader(**{k: v[k] for k in same}, ignore_subreddits=listed("subreddits", v.get("filter_mh_subreddits")), ignore_terms=listed("terms", v.get("filter_mh_terms")), random_state=config["random_seed"])


def post_selection(config: dict, side: str) -> dict:
    """Dates and sampling of a side's posts, as ``PostLoader.select`` takes them; empty dates are no bound."""
    dates = _side(config.get("date_boundaries"), side, {})
    if isinstance(dates, list):  # periods of a temporal experiment
        dates = {"min_date": dates[0], "max_date": dates[-1]} if dates else {}
    sampling = _side(config.get("post_sampling"), side, {})
    return {"min_date": dates.get("min_date") or None, "max_date": dates.get("max_date") or None, "n_samples": sampling.get("n_samples"), "randomized": bool(sampling.get("randomized"))}
