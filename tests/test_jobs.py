"""Training and prediction from files to files, continuing non-empty models, and growth by loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlearn import api, jobs
from loamlearn.operators import continuous as C, gbdt

COMMON = 'data {{ train {{ data_path : "{d}/train" }}, test {{ data_path : "{d}/test" }} }}, model {{ data_path : "{d}/model", {model} }}\n'


def _write(path, rows):
    path.mkdir()
    (path / "part-0.txt").write_text("\n".join(f"1###{int(y)}###" + ",".join(f"f{j % 2}@{j}:{v!r}" for j, v in enumerate(x.tolist())) for x, y in rows) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("jobs")
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.normal(size=300)) > 0
    _write(d / "train", list(zip(x[:200], y[:200], strict=True)))
    _write(d / "test", list(zip(x[200:], y[200:], strict=True)))
    return d


@pytest.mark.parametrize("kind,extra", [("linear", ""), ("ffm", "k : [1, 2]\n"), ("gbsdt", "k : 2, tree_num : 1\n")])
def test_train_save_load_predict(spark, folder, kind, extra):
    c = f"type : {kind}\n{extra}" + COMMON.format(d=folder, model="") + "loss { loss_function : sigmoid, evaluate_metric : [\"auc\"], regularization { l1 : [0.0, 0.0], l2 : [0.001, 0.001] } }, optimization.line_search.lbfgs.convergence.max_iter : 4, random { mode : normal, seed : 3, normal { mean : 0.0, std : 0.1 } }"
    got = jobs.train_files(spark, c)
    assert got["train"]["auc"] > 0.85 and got["test"]["auc"] > 0.8
    back = jobs.load(spark, c)
    maps = [{"f0@0": 0.5, "f1@1": -1.0, "f0@2": 0.25}, {"unknown": 1.0}, {}]
    np.testing.assert_allclose(back.predicts(maps), got["predictor"].predicts(maps), rtol=1e-9)
    jobs.predict_files(spark, c, [str(folder / "test")], str(folder / f"out-{kind}"), "LABEL_AND_PREDICT")
    lines = [r["value"] for r in spark.read.text(str(folder / f"out-{kind}")).collect()]
    assert len(lines) == 100 and all(len(x.split("###")) == 2 for x in lines)
    jobs.predict_files(spark, c, [str(folder / "test")], str(folder / f"feat-{kind}"), "PREDICT_AS_FEATURE")
    assert all(f",{kind}_label_" in r["value"] for r in spark.read.text(str(folder / f"feat-{kind}")).collect())


def test_continue_dump_and_just_evaluate(spark, folder):
    c = lambda n, more="": "type : linear\n" + COMMON.format(d=folder, model=f"dump_freq : 1, {more}").replace("/model", "/again") + f"loss {{ loss_function : sigmoid, evaluate_metric : [auc], regularization {{ l1 : [0.0], l2 : [0.001] }} }}, optimization.line_search.lbfgs.convergence.max_iter : {n}"
    short = jobs.train_files(spark, c(2))
    kept = jobs.train_files(spark, c(2, "continue_train : true").replace("evaluate_metric : [auc]", "evaluate_metric : [auc], just_evaluate : true"))
    np.testing.assert_allclose(kept["predictor"].w, short["predictor"].w)
    more = jobs.train_files(spark, c(6, "continue_train : true"))
    assert more["train"]["loss"] < short["train"]["loss"]


def test_gbdt_files_and_continuing(spark, folder):
    c = lambda n, more="": "type : gradient_boosting\n" + COMMON.format(d=folder, model=f'feature_importance_path : "{folder}/importance", {more}').replace("/model", "/forest") + f"optimization {{ loss_function : sigmoid, round_num : {n}, max_depth : 3, eval_metric : [auc] }}"
    two = jobs.train_files(spark, c(2))
    four = jobs.train_files(spark, c(4, "continue_train : true"))
    p, q = two["predictor"].model, four["predictor"].model
    assert len(p.trees) == 2 and len(q.trees) == 4 and four["train"]["loss"] < two["train"]["loss"]
    maps = [{"f0@0": a, "f1@1": b} for a in (-1.0, 0.3) for b in (-0.5, 2.0)]
    old = gbdt.Forest(q.features, q.trees[:2], q.objective, 1, q.base_prediction)
    from loamlearn.operators.score import Predictor

    np.testing.assert_allclose(Predictor(old, "sigmoid").predicts(maps), two["predictor"].predicts(maps), rtol=1e-9)
    np.testing.assert_allclose(jobs.load(spark, c(4)).predicts(maps), four["predictor"].predicts(maps), rtol=1e-9)
    assert spark.read.text(f"{folder}/importance").count() > 1


def test_unknown_keys_fail():
    with pytest.raises(ValueError, match="model.dumpfreq"):
        api._config("type : linear, model.dumpfreq : 3")


def _state(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3)) + 0.0
    df = spark.createDataFrame([(1.0, [float(t)], {f"x{j}": float(v) for j, v in enumerate(r)}) for r, t in zip(x, y, strict=True)], "weight double, label array<double>, features map<string,double>").repartition(5)
    names = ["x0", "x1", "x2"]
    values = {n: np.arange(12.0) for n in names}
    state = gbdt.prepare(df, names, values).withColumn("sum", F.array(F.lit(0.0)))
    return gbdt.advanced(state, [], gbdt.Forest(names), gbdt.Params(), 0)


def test_counting_ahead_and_in_parts_changes_nothing(spark, monkeypatch):
    state = _state(spark)
    assert "raw" not in state.columns
    p = gbdt.Params(max_depth=6, max_leaves=9, policy="loss", min_child_hess=0.5)
    same = gbdt.grow(state, 3, 12, p)
    jobs_run = []
    real = gbdt.histograms
    monkeypatch.setattr(gbdt, "histograms", lambda *a, **k: jobs_run.append(1) or real(*a, **k))
    monkeypatch.setattr(gbdt, "SPREAD", 5)
    monkeypatch.setattr(gbdt, "FAN", 2)
    parts = gbdt.grow(state, 3, 12, p)
    ahead = len(jobs_run)
    monkeypatch.setattr(gbdt, "AHEAD", 0)
    single = gbdt.grow(state, 3, 12, p)
    assert len(jobs_run) - ahead > ahead
    for t in (parts, single):
        assert [(n.feature, n.left_bin, n.left, n.count) for n in t.nodes] == [(n.feature, n.left_bin, n.left, n.count) for n in same.nodes]
        np.testing.assert_allclose(t.values, same.values)


def test_gradient_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(1.0, [float(i % 2)], [0, 1 + i % 4], [1.0, float(v)]) for i, v in enumerate(rng.normal(size=200))], "weight double, label array<double>, idx array<long>, val array<double>").repartition(6)
    m, w = C.build("linear", 5), rng.normal(size=5)
    a = C.evaluate(rows, m, "sigmoid", w)
    monkeypatch.setattr(C, "DIRECT", 0)
    monkeypatch.setattr(C, "FAN", 2)
    monkeypatch.setattr(C, "SPREAD", 2)
    b = C.evaluate(rows, m, "sigmoid", w)
    np.testing.assert_allclose(a[1], b[1])
    assert a[0] == pytest.approx(b[0]) and a[2] == b[2]
