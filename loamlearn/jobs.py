"""Training and batch prediction from files to files, by configuration.

``train_files`` reads the sample lines that the configuration names, trains (or continues, or only evaluates) and writes
the model in its text form; ``load`` reads it back; ``predict_files`` scores files into lines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import continuous, features as feat, score
from .operators.score import FieldOf, Predictor
from .sources import lines as src, models as M
from .sources.config import get

TREES = ("gbdt", "gradient_boosting", "random_forest")


def kind_of(c: dict) -> str:
    return get(c, "type", get(c, "model_name", "linear"))


def delimiters(c: dict) -> src.Delimiters:
    d = "data.delim."
    return src.Delimiters(get(c, d + "x_delim", "###"), get(c, d + "y_delim", ","), get(c, d + "features_delim", ","), get(c, d + "feature_name_val_delim", ":"))


def read_samples(spark: SparkSession, c: dict, part: str, hook=None) -> DataFrame | None:
    """weight, label, features, init_pred of the configuration's ``train`` or ``test`` files; None without a path.

    A line without weight or features at all is an error; too many bad features are one, too.
    """
    path = get(c, f"data.{part}.data_path")
    if not path:
        return None
    lines = src.read_lines(spark, *[p.strip() for p in path.split(",")])
    if hook:
        lines = src.apply_hook(lines, hook)
    got = src.checked(src.parse(lines, delimiters(c)), get(c, f"data.{part}.max_error_tol", 0))
    return got.select("weight", "label", "features", "init_pred")


def save(spark: SparkSession, p: Predictor, c: dict, precision: np.ndarray | None = None) -> None:
    """The model's lines at model.data_path, its dictionary or feature importance where the configuration names them."""
    path, delim, kind = get(c, "model.data_path"), get(c, "model.delim", ","), kind_of(c)
    if kind in TREES:
        M.write_lines(spark, M.forest_lines(p.model), path)
        if get(c, "model.feature_importance_path"):
            M.write_lines(spark, M.importance_lines(p.model), get(c, "model.feature_importance_path"))
        return
    names = sorted(p.index, key=p.index.get)
    if isinstance(p.model, continuous.Ensemble):
        trees = p.model.trees
        scalar = trees[0][0].scalar if trees else False
        M.write_lines(spark, M.tree_info_lines(trees[0][0].k if trees else 0, len(trees), len(trees), get(c, "uniform_base_prediction", 0.5)), f"{path}/info")
        for i, (m, w) in enumerate(trees):
            M.write_lines(spark, M.soft_tree_lines(names, w, m.k, scalar, delim), f"{path}/tree-{i:05d}")
    elif kind == "linear":
        M.write_lines(spark, M.linear_lines(names, p.w, precision, delim), path)
    else:
        rows = M.fm_rows(p.w, len(names)) if kind in ("fm", "ffm") else p.w.reshape(len(names), -1)
        M.write_lines(spark, M.vector_lines(names, rows, delim), path)
    if get(c, "model.dict_path") and not get(c, "model.need_dict", False):
        M.write_lines(spark, [n for n in names if n != feat.BIAS], get(c, "model.dict_path"))


def load(spark: SparkSession, config: dict | str) -> Predictor:
    """The predictor of the model at model.data_path, by the configuration's type."""
    c = api._config(config)
    path, delim, kind = get(c, "model.data_path"), get(c, "model.delim", ","), kind_of(c)
    objective, bias, k = get(c, "loss.loss_function", get(c, "optimization.loss_function", "sigmoid")), get(c, "model.need_bias", True), get(c, "k", 1)
    if kind in TREES:
        forest = M.read_forest(M.read_text(spark, path), "random_forest" in (get(c, "model_type"), kind))
        return Predictor(forest, forest.objective)
    if kind not in continuous.KINDS:
        raise ValueError(f"unknown model type {kind!r}")
    order = lambda names: {n: i for i, n in enumerate(([feat.BIAS] if bias else []) + sorted(n for n in names if n != feat.BIAS))}
    if kind.startswith("gb"):
        head = dict(x.strip().split(":", 1) for x in M.read_text(spark, f"{path}/info") if x.strip())
        per = [M.read_text(spark, f"{path}/tree-{i:05d}") for i in range(int(head["finished_tree_num"]))]
        scalar = kind in ("gbsdt", "gbhsdt")
        index = order(M.read_vectors(per[0][1 + scalar :], delim)) if per else {}
        trees = [(continuous.build(kind, len(index), k=int(head["K"])), M.read_soft_tree(x, list(index), scalar, delim)[1]) for x in per]
        ensemble, base = get(c, "model_type", "gradient_boosting"), float(head["uniform_base_prediction"])
        from .functions.losses import A, loss as loss_of

        return Predictor(continuous.Ensemble(trees, ensemble, 1.0 if ensemble == "random_forest" else get(c, "learning_rate", 0.1), float(loss_of(objective).inverse(A, np.float64(base)))), objective, index=index, bias=bias)
    lines = M.read_text(spark, path)
    if kind == "linear":
        got = M.read_linear(lines, delim)
        index = order(got)
        return Predictor(continuous.build(kind, len(index)), objective, np.array([got.get(n, (0.0,))[0] for n in index]), index, bias=bias)
    got = M.read_vectors(lines, delim)
    index = order(got)
    width = len(next(iter(got.values())))
    rows = np.array([got.get(n, np.zeros(width)) for n in index]).reshape(len(index), -1)
    if kind == "multiclass_linear":
        return Predictor(continuous.build(kind, len(index), k), objective, rows.ravel(), index, bias=bias)
    first, latent = k if isinstance(k, list) else (1, k)
    options = {"k": latent, "first_order": bool(first), "bias_latent": get(c, "bias_need_latent_factor", False), "bias": bias}
    field_of = None
    if kind == "ffm":
        options["fields"] = (width - 1) // latent
        mark = api.field_delim(c)
        fields = sorted({n.split(mark)[0] for n in index if n != feat.BIAS})
        if get(c, "model.field_dict_path"):
            fields = sorted(r["feature"] for r in M.read_dictionary(spark, get(c, "model.field_dict_path")).collect())
        field_of = FieldOf(fields, mark)
    return Predictor(continuous.build(kind, len(index), **options), objective, M.fm_vector(rows), index, field_of, bias)


def thompson(p: Predictor, precision: dict[str, float | None], alpha: float, seed: int) -> Predictor:
    """A linear predictor with one draw of its coefficients; what has no precision doesn't move."""
    known = np.array([np.inf if precision.get(n) is None else precision[n] for n in sorted(p.index, key=p.index.get)])
    return Predictor(p.model, p.objective, continuous.thompson(p.w, np.where(np.isinf(known), 1e30, known), alpha, seed, p.bias), p.index, p.field_of, p.bias)


def train_files(spark: SparkSession, config: dict | str, hook=None) -> dict:
    """Trains by configuration and writes the model; the result holds the predictor and the metrics asked for."""
    c = api._config(config)
    samples, test = read_samples(spark, c, "train", hook), read_samples(spark, c, "test", hook)
    start = load(spark, c) if get(c, "model.continue_train", False) else None
    every = get(c, "model.dump_freq", -1)
    dump = (lambda i, p: save(spark, p, c) if i and i % every == 0 else None) if every and every > 0 and get(c, "model.data_path") else None
    p = api.train(samples, c, test, start, dump)
    only = get(c, "loss.just_evaluate", get(c, "optimization.just_evaluate", False))
    if get(c, "model.data_path") and not only:
        save(spark, p, c)
    asked = get(c, "loss.evaluate_metric", get(c, "optimization.eval_metric", [])) or []
    out = {"predictor": p}
    for name, data in (("train", samples), ("test", test)):
        if data is not None and (asked or only) and p.predicts([{}]).shape[1] == 1:
            out[name] = api.evaluate(p, data, list(asked))
    return out


def predict_files(spark: SparkSession, config: dict | str, paths: list[str], out: str, mode: str = score.RESULT_ONLY, kind: str = "value", predictor: Predictor | None = None) -> None:
    """Scores sample lines into ``out``: a directory an input file, its lines in their order. Bad lines are an error."""
    c = api._config(config)
    p, d = predictor or load(spark, c), delimiters(c)
    lines = src.checked(src.parse(src.read_lines(spark, *paths), d), get(c, "data.test.max_error_tol", 0))
    got = p.apply(lines, kind)
    label = F.array_join(F.transform("label", lambda v: v.cast("string")), d.y)
    scalar = not isinstance(p.model, continuous.Ensemble) and kind_of(c) not in TREES and kind == "value"
    many = p.predicts([{}]).shape[1] > 1
    done = score.saved_form(got, mode, F.col("predicts"), F.col("value"), F.coalesce(label, F.lit("")), kind_of(c), kind, not scalar or many, d.x, d.y, d.features, d.name_value)
    score.write_predictions(done.select("file", "order", "value"), out)
