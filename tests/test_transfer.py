"""Models across domains and folds against plain numpy, summaries of runs, controls by age."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import evaluation as ev
from lexiloom.operators import features as fe
from lexiloom.operators import fold_models as fm
from lexiloom.operators import splits as sp
from lexiloom.operators import transfer as tr
from lexiloom.sources import readers

LEX = [("good", False, "up"), ("ba", True, "down"), ("we", False, "us"), ("us", False, "us")]
WORDS = ["good", "bad", "bar", "we", "us", "x", "y"]


def logistic(z, y, C=1.0):
    """Coefficients and intercept of one L2-penalised fit by Newton's steps with halving."""
    z = np.concatenate([z, np.ones((len(z), 1))], 1)
    pen, b = np.append(np.ones(z.shape[1] - 1), 0) / C, np.zeros(z.shape[1])
    loss = lambda b: np.logaddexp(0, z @ b).sum() - y @ (z @ b) + 0.5 * pen @ b**2
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.lstsq(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pen), z.T @ (p - y) + pen * b, rcond=None)[0]
        while loss(b - step) > loss(b) + 1e-12 and np.abs(step).max() > 1e-12:
            step /= 2
        b = b - step
    return b


@pytest.fixture(scope="module")
def domains():
    """{domain: (counts of sources x words, labels)}; the first source of each has no word, ``c`` has one class."""
    rng = np.random.default_rng(3)
    made = {}
    for d, size in (("a", 50), ("b", 40), ("c", 20)):
        n = rng.poisson([2, 1, 0.3, 1, 1, 3, 2], (size, 7))
        n[0] = 0
        if d == "b":
            n[:, 4] = 0  # a word that b's vocabulary lacks
        y = (n[:, 0] + rng.normal(size=size) > n[:, 1] + 1).astype(int) if d != "c" else np.ones(size, int)
        made[d] = (n, y)
    return made


def test_all_pairs_of_domains(spark, domains):
    rows = [(d, i, WORDS[j], int(n[i, j])) for d, (n, _) in domains.items() for i in range(len(n)) for j in range(7) if n[i, j]]
    counts = spark.createDataFrame([*rows, ("a", 900, "good", 5), (None, 1, "good", 1)], "domain string, source long, term string, n long").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(d, i, int(v)) for d, (_, y) in domains.items() for i, v in enumerate(y)] + [("a", 901, None), ("zz", 1, 5)], "domain string, source long, y int")
    lexicon = spark.createDataFrame(LEX, "entry string, is_prefix boolean, dim string")
    vocab = tr.domain_vocabularies(counts.where("domain is not null and source < 900"), 2)
    dims = {"good": 2, "bad": 0, "bar": 0, "we": 3, "us": 3}  # order of the names: down, up, us
    names = ["down", "up", "us"]
    at = {"good": 1, "bad": 0, "bar": 0, "we": 2, "us": 2}
    assert set(dims) == set(at) and names == sorted(names)

    def features(v, d):
        known = (domains[v][0] > 0).sum(0) >= 2
        out = np.zeros((len(domains[d][0]), 3))
        for j, w in enumerate(WORDS):
            if w in at and known[j]:
                out[:, at[w]] += domains[d][0][:, j]
        total = out.sum(1, keepdims=True)
        return np.divide(out, total, out=np.zeros_like(out), where=total > 0)

    def scaling(x):
        return x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)

    got = {(r["train"], r["test"], r["fix_vocabulary"], r["scale_independent"], r["source"]): r for r in tr.transfer_predictions(counts, labels, vocab, lexicon, "matched").collect()}
    assert len(got) == 2 * 4 * 110
    for i in ("a", "b"):
        x = features(i, i)
        m, s = scaling(x)
        b = logistic((x - m) / s, domains[i][1])
        for j in domains:
            for fixed in (True, False):
                for independent in (True, False):
                    t = features(i if fixed else j, j)
                    mm, ss = scaling(t) if independent else (m, s)
                    want = 1 / (1 + np.exp(-((t - mm) / ss @ b[:-1] + b[-1])))
                    have = np.array([got[i, j, fixed, independent, k]["y_pred"] for k in range(len(t))])
                    assert np.abs(have - want).max() < 1e-6
    again = tr.transfer_scores(tr.transfer_predictions(counts, labels, vocab, lexicon, "matched")).collect()
    assert len(again) == 24 and all(0 <= r["accuracy"] <= 1 for r in again)
    same = {(r["fix_vocabulary"], r["scale_independent"]): round(r["accuracy"], 9) for r in again if r["train"] == r["test"] == "a"}
    assert len(set(same.values())) == 1


@pytest.mark.parametrize("norm", ["matched", "unmatched", "max", "l1", "l2", None])
def test_features_as_of_each_vocabulary_alone(spark, domains, norm):
    """Under one vocabulary the features are those of the operator for a single corpus."""
    rows = [(d, i, WORDS[j], int(n[i, j])) for d, (n, _) in domains.items() for i in range(len(n)) for j in range(7) if n[i, j]]
    counts = spark.createDataFrame(rows, "domain string, source long, term string, n long")
    lexicon = spark.createDataFrame([*LEX, ("good", False, "us")], "entry string, is_prefix boolean, dim string")
    vocab = tr.domain_vocabularies(counts, 2)
    got = {(r["vocabulary"], r["domain"], r["source"], r["name"]): round(r["value"], 9) for r in tr.transfer_features(counts, vocab, lexicon, norm).collect()}
    mine = counts.join(vocab.where("domain = 'b'").select("term"), "term", "left_semi").select(F.struct("domain", "source").alias("source"), "term", "n")
    want = {("b", r["source"]["domain"], r["source"]["source"], r["dim"]): round(r["value"], 9) for r in fe.lexicon_features(mine, lexicon, norm).collect()}
    assert want and {k: v for k, v in got.items() if k[0] == "b"} == want


def test_transfer_of_nothing(spark):
    counts = spark.createDataFrame([("a", 1, "good", 1)], "domain string, source long, term string, n long")
    labels = spark.createDataFrame([("a", 1, 1), ("b", 2, 0)], "domain string, source long, y int")
    lexicon = spark.createDataFrame(LEX, "entry string, is_prefix boolean, dim string")
    vocab = tr.domain_vocabularies(counts)
    for args in ((counts, labels, vocab, lexicon), (counts, labels.limit(0), vocab, lexicon), (counts, labels, vocab, lexicon.limit(0)), (counts.limit(0), labels, vocab.limit(0), lexicon)):
        found = tr.transfer_predictions(*args)
        assert found.count() == 0 and found.columns == [*tr.SETTING, "source", "y_true", "y_pred"]
    many = spark.range(40).select(F.col("id").cast("string").alias("domain"), F.col("id").alias("source"), F.lit(1).alias("y"))
    with pytest.raises(ValueError, match="16"):
        tr.transfer_predictions(counts, many, vocab, lexicon)


def test_models_of_folds(spark):
    rng = np.random.default_rng(8)
    n = rng.poisson(np.linspace(0.1, 1.5, 12), (90, 12))
    n[:3] = 0
    y = (n[:, 9] - n[:, 10] + 0.7 * rng.normal(size=90) > 0).astype(int)
    fold = np.arange(90) % 3 + 1
    names = [f"T{j:02d}" for j in range(12)]
    counts = spark.createDataFrame([(i, names[j], int(n[i, j])) for i in range(90) for j in range(12) if n[i, j]] + [(500, "T03", 1), (4, None, 2)], "source long, term string, n long")
    folds = spark.createDataFrame([(i, int(y[i]), int(fold[i])) for i in range(90)] + [(600, None, 1)], "source long, y int, fold int")
    scores, coefs = fm.FoldModels(least=8, excluded=("t11",)).run(counts, folds)
    got = {(r["fold"], r["group"]): r for r in scores.collect()}
    weights = {(r["fold"], r["term"]): r["coef"] for r in coefs.collect()}
    assert len(got) == 6
    n[:, 11] = 0
    for k in (1, 2, 3):
        train = fold != k
        df = (n[train] > 0).sum(0)
        keep = df >= 8
        x = n[:, keep] * (np.log((1 + train.sum()) / (1 + df[keep])) + 1)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        b = logistic(x[train], y[train])
        assert {t for f, t in weights if f == k} == {names[j] for j in np.flatnonzero(keep)}
        assert np.allclose([weights[k, names[j]] for j in np.flatnonzero(keep)], b[:-1], atol=1e-3)
        hit = x @ b[:-1] + b[-1] > 0
        for group, rows in (("train", train), ("test", ~train)):
            r, h, t = got[k, group], hit[rows], y[rows] == 1
            assert r["accuracy"] == pytest.approx((h == t).mean()) and r["precision"] == pytest.approx(t[h].mean()) and r["recall"] == pytest.approx(h[t].mean())
            assert r["null_users"] == (size[rows] == 0).sum()
    found = {(r["group"], r["score"]): r for r in fm.summary(scores).collect()}
    assert found["test", "accuracy"]["mean"] == pytest.approx(np.mean([got[k, "test"]["accuracy"] for k in (1, 2, 3)]))
    assert found["train", "null_users"]["std"] == pytest.approx(np.std([got[k, "train"]["null_users"] for k in (1, 2, 3)], ddof=1))


def test_folds_without_models(spark):
    counts = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "source long, term string, n long")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "source long, y int, fold int")
    for args in ((counts, one), (counts.limit(0), one), (counts, one.limit(0))):
        scores, coefs = fm.FoldModels().run(*args)
        assert scores.count() == 0 == coefs.count()


def test_summary_of_domains(spark):
    rows = [("g", 1, 0.9), ("g", 0, 0.8), ("g", 0, 0.2), ("g", 1, 0.7), ("two", 1, 0.9), ("two", 0, 0.1), ("ones", 1, 0.9), ("ones", 1, 0.8), ("ones", 1, 0.7), (None, 0, 0.1), (None, 1, 0.6), (None, 1, 0.7), ("g", None, 0.5), ("g", 1, None)]
    got = {r["grp"]: r for r in ev.domain_summary(spark.createDataFrame(rows, "grp string, y_true int, y_pred double"), ["grp"]).collect()}
    assert got["g"]["precision"] == [1.0, pytest.approx(2 / 3)] and got["g"]["recall"] == [0.5, 1.0] and got["g"]["class_size"] == [2, 2] and got["g"]["auc"] == 0.75
    assert got["g"]["fpr"][0] == 0 and got["g"]["tpr"][-1] == 1 and got["g"]["thresholds"][0] == float("inf")
    assert got["two"]["auc"] is None and got["two"]["fpr"] == [] and got["two"]["binary_fscore"] == 1
    assert got["ones"]["auc"] is None and got["ones"]["precision"] == [1.0] and got["ones"]["class_size"] == [3]
    assert got[None]["auc"] == 1.0 and got[None]["accuracy"] == 1


def test_results_of_runs(spark, tmp_path):
    for name, seed in (("transfer-1", 1), ("transfer-2", 2), ("other", 3)):
        (tmp_path / name / "cross_validation").mkdir(parents=True)
        (tmp_path / name / "cross_validation" / "predictions.csv").write_text(f"source,fold,group,y_true,y_pred\n/u/{name},1,test,1,0.{seed}\n")
        (tmp_path / name / "splits.json").write_text('{"random_seed": 99}')
        if seed != 2:
            (tmp_path / name / "config.json").write_text(json.dumps({"random_seed": seed, "train_data": {"a": "x"}, "more": [1]}, indent=2))
    got = {r["run"]: r for r in readers.scan_results(spark, str(tmp_path), "random_seed int, stratified boolean", "transfer").collect()}
    assert set(got) == {"transfer-1", "transfer-2"}
    assert (got["transfer-1"]["random_seed"], got["transfer-1"]["stratified"], got["transfer-1"]["y_pred"]) == (1, None, 0.1)
    assert got["transfer-2"]["random_seed"] is None and got["transfer-2"]["group"] == "test"


def test_controls_by_age(spark):
    """As many controls as targets in each split and gender, none beyond the targets' ages, more where there are more targets."""
    rows = [(i, "target", "train", "M", 20.0 if i % 4 else 40.0) for i in range(80)] + [(100 + i, "control", "train", "M", 20.0 if i % 2 else 39.9) for i in range(600)]
    rows += [(1000, "target", "train", "F", 30.0), (1001, "control", "train", "F", 30.0), (1002, "control", "train", "F", 31.0), (1003, "control", "train", "F", None)]
    rows += [(2000, "target", "test", "X", 50.0), (2001, "control", "test", "X", 50.0), (2002, "control", "train", "M", 40.0), (2003, "control", "train", "M", 10.0)]
    df = spark.createDataFrame(rows, "source long, label string, split string, gender string, age double")
    got = [r for r in sp.isolate_controls(df, "clpsych", genders=("M", "F")).collect() if r["label"] == "control"]
    men = [r["age"] for r in got if r["gender"] == "M"]
    assert len(men) == 80 and 10.0 not in men and 40.0 not in men and men.count(20.0) > 45
    assert [r["source"] for r in got if r["gender"] == "F"] == [1001] and not [r for r in got if r["gender"] == "X"]
    assert 2001 in {r["source"] for r in sp.isolate_controls(df, "clpsych").collect()}
