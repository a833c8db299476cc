"""Search over selectors, feature families, scaling and classifiers.

A configuration lists searches.  Each expands to selectors, to stages of feature sets, each of which
adds a family to those before, and to classifiers.  A stage's best candidate stays if its score on
the development set is no lower than the best so far.  Counts and vocabulary are made once and shared.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import TableStore, digest, fingerprint
from . import evaluation as ev
from . import options as op
from . import sampling as sm
from .models import grid
from .selection import Selector
from .text_model import FittedTextModel, TextModel

#: The order in which families join.
STAGES = ("bag_of_words", "tfidf", "liwc", "lda", "glove")


@dataclass(frozen=True)
class Space:
    """One search: selectors, for each choice of scaling the stages of feature sets, and (name, options) of classifiers."""

    selectors: tuple[Selector, ...]
    feature_sets: tuple[tuple[bool, tuple[tuple[dict, ...], ...]], ...]
    models: tuple[tuple[str, dict], ...]

    def __len__(self) -> int:
        """Fits of the search, if every stage is tried."""
        return len(self.selectors) * len(self.models) * sum(len(stage) for _, stages in self.feature_sets for stage in stages)


def feature_stages(families: dict[str, dict[str, list]], ablation: bool) -> tuple[tuple[dict, ...], ...]:
    """Stages of feature sets.  TF-IDF takes the place of the plain counts; later families join those before.

    Without ablation there is one set of all families, whose options must be single values.
    """
    if not ablation:
        for name, options in families.items():
            if any(len(v) != 1 for v in options.values()):
                raise ValueError(f"without ablation the options of {name} must be single values")
        whole = {n: {k: v[0] for k, v in o.items()} for n, o in families.items()}
        if "tfidf" in whole:
            whole.pop("bag_of_words", None)
        return ((whole,),)
    stages, base = [], {}
    for name in (n for n in STAGES if n in families):
        options = grid(families[name])
        if name == "bag_of_words" or (name == "tfidf" and "bag_of_words" in families):
            sets, base = [{name: o} for o in options], {name: {}}
        else:
            sets, base = [{**base, name: o} for o in options], {**base, name: {}}
        stages.append(tuple(sets))
    return tuple(stages)


def search_space(config: str | list[dict]) -> list[Space]:
    """Spaces of a configuration: a list, or the path of a JSON file with one."""
    if isinstance(config, str):
        with open(config, encoding="utf-8") as f:
            config = json.load(f)
    spaces = []
    for c in config:
        selectors = [Selector()] if c["feature_selector_ablation"] or not c["feature_selector"] else []
        selectors += [Selector(kind, **op.selector_options(o)) for kind, options in c["feature_selector"].items() for o in grid(options)]
        stages = tuple(tuple({n: op.feature_options(n, o) for n, o in s.items()} for s in stage) for stage in feature_stages(c["features"], c["feature_set_ablation"]))
        models = []
        for m in c["model"]:
            for o in grid({k: v for k, v in m.items() if k != "name"}):
                kw, weight = op.model_options(m["name"], o)
                models.append((m["name"], kw | ({"class_weight": weight} if weight else {})))
        spaces.append(Space(tuple(selectors), tuple((s, stages) for s in c["standardize"]), tuple(models)))
    return spaces


@dataclass
class Result:
    options: TextModel
    score: float
    fitted: FittedTextModel


def _with_chosen(candidate: dict, chosen: dict) -> dict:
    """A candidate whose earlier families have the options chosen before."""
    return {n: (chosen[n] if n in chosen and not o else o) for n, o in candidate.items()}


def f1_score(predictions: DataFrame) -> float:
    return float(ev.scores(predictions.withColumn("_all", F.lit(0)), ["_all"]).first()["f1"])


def run(base: TextModel, space: Space, corpus: DataFrame, train: DataFrame, dev: DataFrame, score: Callable[[DataFrame], float] = f1_score, store: TableStore | None = None, **resources) -> Iterator[Result]:
    """Results of all fits on ``train(source, y)``, scored by their predictions (y_true, y_pred) for ``dev``.

    Counts are made once, what a selector leaves once for it, and the features of a set and their vectors
    once for all classifiers; a selector's tables go before the next one's are made.  A result's model
    lives until the next result.
    """
    if store is None:
        with TableStore(corpus.sparkSession) as own:
            yield from run(base, space, corpus, train, dev, score, own, **resources)
        return
    truth = dev.select("source", F.col("y").alias("y_true"))
    with store.holding():
        prepared = base.prepare(corpus, train, store)
        held_key = digest("dev", prepared.key, fingerprint(dev.select("source")))
        held = store.table("dev", held_key, lambda: corpus.join(dev.select("source").distinct(), "source", "left_semi").select("source", "tokens"))
        for selector in space.selectors:
            with store.holding():
                for name, kw in space.models:
                    for standardize, stages in space.feature_sets:
                        chosen, best = {}, float("-inf")
                        for stage in stages:
                            tried = []
                            for candidate in stage:
                                options = replace(base, selector=selector, features=_with_chosen(candidate, chosen), standardize=standardize, model=name, model_kwargs={k: v for k, v in kw.items() if k != "class_weight"}, class_weight=kw.get("class_weight"))
                                fitted = options.fit(corpus, train, prepared=prepared, store=store, **resources)
                                tried.append(Result(options, score(fitted.predict(held, held_key).join(truth, "source")), fitted))
                                yield tried[-1]
                            top = max(tried, key=lambda r: r.score)  # the first of equals
                            if top.score >= best:
                                chosen, best = top.options.features, top.score


def search(base: TextModel, config: str | list[dict], corpus: DataFrame, labels: DataFrame, dev: DataFrame | None = None, score: Callable[[DataFrame], float] = f1_score, share: float = 0.2, refit: bool = True, store: TableStore | None = None, **resources) -> tuple[FittedTextModel, DataFrame]:
    """(best model, results): without ``dev`` labels a ``share`` of each class is held out.

    The best options are fitted once more: with ``refit`` to all labels, else to the training part.  Results are
    (selector, features, standardize, model, options, score) in the order of the fits.  All tables on
    the way are deleted.
    """
    if store is None:
        with TableStore(corpus.sparkSession) as own:
            return search(base, config, corpus, labels, dev, score, share, refit, own, **resources)
    with store.holding():
        if dev is None:
            role = store.table("roles", digest("roles", fingerprint(labels), share, base.seed), lambda: sm.held_out_split(labels.select("source", "y"), "y", "source", share, base.seed))
            train, held = (role.where(F.col("role") == r).drop("role") for r in ("train", "test"))
        else:
            train, held = labels, dev
        results, best = [], None
        for space in search_space(config):
            for r in run(base, space, corpus, train, held, score, store, **resources):
                results.append((len(results), str(r.options.selector.kind), json.dumps(r.options.features), r.options.standardize, r.options.model, json.dumps(r.options.model_kwargs), r.score))
                best = (r.options, r.score) if best is None or r.score > best[1] else best
        if best is None:
            raise ValueError("the configuration has no candidate")
        fitted = best[0].fit(corpus, labels if refit else train, **resources)
    schema = "place int, selector string, features string, standardize boolean, model string, options string, score double"
    return fitted, corpus.sparkSession.createDataFrame(results, schema)
