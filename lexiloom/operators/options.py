"""Options as configurations name them, in the names of this library: one table for configurations and searches.

An option that means nothing here or has the only value that this library knows is left out; one that
can't be honoured raises ValueError.
"""

from __future__ import annotations

from .models import WEIGHTED

# Dimensions of the published vectors and names that existing configurations use.
GLOVE_DIMENSIONS = (25, 50, 100, 200)
POOLING = {"mean": "mean", "max": "extremum"}
FEATURES = {
    "bag_of_words": {},
    "tfidf": {},
    "liwc": {"norm": "norm"},
    "glove": {"dim": "dim", "pooling": "how", "how": "how"},
    "lda": {"n_components": "k", "doc_topic_prior": "doc_prior", "topic_word_prior": "topic_prior", "random_state": "seed", "max_iter": "max_iter", "k": "k", "seed": "seed"},
}
SELECTION = {"top_k": "top_k", "min_support": "min_support", "add_lambda": "smoothing", "smoothing": "smoothing", "beta": "beta", "symmetric": "symmetric", "stopwords": "stopwords", "keep_pronouns": "keep_pronouns", "filter_stopwords": "filter_stopwords", "preserve_protected": "preserve_protected"}
MODELS = {
    "logistic": {"C": "C", "max_iter": "max_iter"},
    "linear_svm": {"C": "C", "max_iter": "max_iter"},
    "svm": {"C": "C", "kernel": "kernel", "gamma": "gamma", "tolerance": "tolerance"},
    "perceptron": {"eta0": "eta0", "max_iter": "max_iter", "shuffle": "shuffle"},
    "sgd": {"alpha": "alpha", "loss": "loss", "max_iter": "max_iter", "shuffle": "shuffle"},
    "naive_bayes": {"alpha": "alpha"},
    "decision_tree": {"max_depth": "max_depth", "min_samples_leaf": "min_samples_leaf"},
    "random_forest": {"n_estimators": "n_estimators", "max_depth": "max_depth"},
    "adaboost": {"n_estimators": "n_estimators", "learning_rate": "learning_rate"},
    "gradient_boosting": {"n_estimators": "n_estimators", "max_depth": "max_depth", "learning_rate": "learning_rate"},
    "mlp": {"hidden_layer_sizes": "layers", "layers": "layers", "max_iter": "max_iter"},
}
#: Options that change nothing here, or only with these values: others can't be honoured.
WITHOUT_EFFECT = ("random_state", "n_jobs", "verbose", "solver", "shrinking", "probability", "presort", "oob_score", "splitter", "batch_size")
ONLY = {
    "penalty": ("l2",), "dual": (True, False), "fit_intercept": (True,), "fit_prior": (True,), "class_prior": (None,), "criterion": ("gini", "friedman_mse"), "min_samples_split": (2,), "bootstrap": (True,),
    "subsample": (1.0,), "loss": ("hinge", "squared_hinge", "log", "deviance"), "early_stopping": (False, True), "validation_fraction": (0.1,), "activation": ("logistic",), "learning_rate": ("constant", "adaptive"),
}


def _renamed(where: str, names: dict[str, str], given: dict) -> dict:
    out = {}
    for key, value in given.items():
        if key in names:
            out[names[key]] = value
        elif key in ONLY and value in ONLY[key] or key in WITHOUT_EFFECT:
            continue
        else:
            raise ValueError(f"{where}: {key}={value!r} can't be honoured")
    return out


def feature_options(family: str, given: dict) -> dict:
    if family not in FEATURES:
        raise ValueError(f"unknown feature family {family!r}; one of {sorted(FEATURES)}")
    out = _renamed(family, FEATURES[family], given)
    if family == "glove":
        if out.get("dim", GLOVE_DIMENSIONS[0]) not in GLOVE_DIMENSIONS:
            raise ValueError(f"glove: dim must be one of {GLOVE_DIMENSIONS}")
        if "how" in out:
            out["how"] = POOLING.get(out["how"], out["how"])
    return {k: v for k, v in out.items() if v is not None or k == "norm"}


def selector_options(given: dict, protected: tuple[str, ...] = ()) -> dict:
    """Of ``Selector``; protected terms stay only where the options say so."""
    out = _renamed("selector", SELECTION, given)
    if out.pop("preserve_protected", False):
        out["protected"] = protected
    if out.get("stopwords") is not None:
        out["stopwords"] = tuple(out["stopwords"])
    return out


def model_options(name: str, given: dict) -> tuple[dict, str | dict | None]:
    """(options of the classifier, class weight)."""
    if name not in MODELS:
        raise ValueError(f"unknown classifier {name!r}; one of {sorted(MODELS)}")
    rest = {k: v for k, v in given.items() if k != "class_weight"}
    out, weight = _renamed(name, MODELS[name], rest), given.get("class_weight")
    if weight is not None and name not in WEIGHTED:
        raise ValueError(f"{name}: class_weight={weight!r} can't be honoured")
    if "layers" in out and "hidden_layer_sizes" in given:
        out["layers"] = (0, *out["layers"], 2)
    return out, weight
