"""The temporal scoring worker: a killed run goes on, no model is fitted twice."""

import json

import pytest

from lexiloom.operators import scoring as sr
from lexiloom.operators import splits as sp
from lexiloom.operators import text_model as tm

BINS = (0, 1)


@pytest.fixture(scope="module")
def experiment(spark):
    """Users who are targets say *bad*, the others *good*; words of users outside the splits must not matter."""
    posts = [(b, u, ["bad" if u % 2 else "good", f"w{u % 3}"] * (1 + b)) for b in BINS for u in range(16)]
    posts += [(b, 99, ["elsewhere"] * 5) for b in BINS] + [(None, 1, ["bad"]), (0, None, ["bad"]), (0, 1, None)]
    roles = [(b, "train", f, "dev" if (u // 2) % 2 + 1 == f else "train", u, u % 2) for b in BINS for u in range(12) for f in (1, 2)]
    roles += [(b, "test", 1, "test", u, u % 2) for b in BINS for u in range(12, 16)]
    return spark.createDataFrame(posts, "bin int, source int, tokens array<string>"), spark.createDataFrame(roles, "bin int, part string, fold int, role string, source int, label int")


def test_a_killed_run_goes_on(spark, experiment, tmp_path, monkeypatch):
    posts, splits = experiment
    splits = splits.where("fold = 1")
    options, root = tm.TextModel(model="naive_bayes"), f"file://{tmp_path}/run"
    fit, fitted = tm.TextModel.fit, []

    def counted(self, *args, **kw):
        if fitted:
            raise InterruptedError("killed")
        fitted.append(kw["prepared"].key)
        return fit(self, *args, **kw)

    monkeypatch.setattr(tm.TextModel, "fit", counted)
    with pytest.raises(InterruptedError):
        sr.score_periods(posts, splits, options, root)
    done = sr.ModelStore(spark, f"{root}/models").manifest().collect()
    assert len(done) == 1 and {r["key"] for r in done} == set(fitted)
    assert {json.loads(r["about"])["model"] for r in done} == {"naive_bayes"}
    monkeypatch.setattr(tm.TextModel, "fit", lambda self, *a, **kw: (fitted.append(kw["prepared"].key), fit(self, *a, **kw))[1])
    got = sr.score_periods(posts, splits, options, root).collect()
    assert len(fitted) == 2 == len(set(fitted))  # two periods
    again = sr.score_periods(posts, splits, options, root).collect()
    assert len(fitted) == 2 and sorted(map(tuple, again)) == sorted(map(tuple, got))
    tested = {(a, f, b, u) for a in BINS for f in (1,) for b in BINS for u in range(16) if u >= 12 or (u // 2) % 2 + 1 == f}
    assert {(r["train_bin"], r["fold"], r["test_bin"], r["source"]) for r in got} == tested and len(got) == len(tested)
    assert all(r["control_bin"] == r["train_bin"] and (r["y_pred"] > 0.5) == (r["source"] % 2 == 1) for r in got)


def test_training_sets_of_mixed_periods(spark, experiment):
    _, splits = experiment
    rows = sr.training_sets(splits, mixed=True).collect()
    assert {(r["train_bin"], r["control_bin"]) for r in rows} == {(a, b) for a in BINS for b in BINS}
    assert all(r["bin"] == (r["train_bin"] if r["y"] else r["control_bin"]) for r in rows)
    assert len(rows) == 4 * 2 * 6


def test_no_models(spark, experiment, tmp_path):
    posts, splits = experiment
    got = sr.score_periods(posts, splits.where("label = 1"), tm.TextModel(), f"file://{tmp_path}/none")
    assert got.count() == 0 and "control_bin" in got.columns
