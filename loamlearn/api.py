"""train, predict and evaluate by configuration (a dict or its HOCON text)."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.losses import loss as loss_of, pure_classification
from .operators import binning, continuous, features as feat, gbdt, metrics
from .operators.optim import Settings, grid_search, hoag
from .operators.score import FieldOf, Predictor
from .plans.session import saved
from .sources.config import check_keys, get, read_config


#: Values that candidate splits may have in all, which the driver holds; a feature's candidates without a rule.
MOST_VALUES, DEFAULT_RULE = 5_000_000, {"cols": "default", "type": "sample_by_quantile", "max_cnt": 255}


def _config(config: dict | str) -> dict:
    c = read_config(config) if isinstance(config, str) else config
    check_keys(c)
    return c


def _settings(c: dict) -> Settings:
    ls = "optimization.line_search."
    of = lambda k, default: get(c, f"{ls}backtracking.{k}", get(c, ls + k, default))
    return Settings(memory=get(c, ls + "lbfgs.m", 8), max_iter=get(c, ls + "lbfgs.convergence.max_iter", 50), eps=get(c, ls + "lbfgs.convergence.eps", 1e-3), line_search=get(c, ls + "mode", "wolfe"), step_decr=of("step_decr", 0.5), step_incr=of("step_incr", 2.1), max_line_steps=of("max_iter", 55), min_step=of("min_step", 1e-16), max_step=of("max_step", 1e18), c1=of("c1", 1e-4), c2=of("c2", 0.9))


def prepared(samples: DataFrame, c: dict, words: DataFrame | None = None, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows of index arrays, dictionary, statistics): hashing, filter, transform, dictionary, as configured."""
    base = samples.withColumn("sample_id", F.monotonically_increasing_id()) if "sample_id" not in samples.columns else samples
    base = saved(base, "samples")
    ex = feat.exploded(base)
    if get(c, "feature.feature_hash.need_feature_hash", False):
        from .functions.hashing import hash_features

        ex = hash_features(ex, get(c, "feature.feature_hash.bucket_size"), get(c, "feature.feature_hash.seed", 0), get(c, "feature.feature_hash.feature_prefix", "hash_"))
    need_bias = get(c, "model.need_bias", True)
    if words is None and get(c, "model.need_dict", False):
        from .sources.models import read_dictionary

        words = saved(feat.dictionary(read_dictionary(samples.sparkSession, get(c, "model.dict_path")), need_bias), "words")
    if words is None:
        words = saved(feat.dictionary(feat.feature_counts(ex, get(c, "feature.filter_threshold", 0)), need_bias), "words")
    mode = get(c, "feature.transform.mode", "standardization")
    if get(c, "feature.transform.switch_on", False):
        stats = saved(feat.feature_stats(ex), "stats") if stats is None else stats
        ex = feat.transform_features(ex, stats, mode, tuple(get(c, "feature.transform.include_features", []) or ()), tuple(get(c, "feature.transform.exclude_features", []) or ()), **({"range_min": get(c, "feature.transform.scale_range.min", -1), "range_max": get(c, "feature.transform.scale_range.max", 1)} if mode == "scale_range" else {}))
    maps = ex.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))
    rows = base.drop("features").join(maps, "sample_id", "left").withColumn("features", F.coalesce("features", F.create_map().cast("map<string,double>")))
    if need_bias:
        rows = feat.with_bias(rows)
    delim = field_delim(c)
    fields = None
    if get(c, "type") == "ffm" and get(c, "model.field_dict_path"):
        from .sources.models import read_dictionary

        fields = feat.dictionary(read_dictionary(samples.sparkSession, get(c, "model.field_dict_path")), True).withColumnRenamed("feature", "field")
    elif get(c, "type") == "ffm":
        names = words.select(F.when(F.col("feature") == feat.BIAS, feat.BIAS).otherwise(F.split("feature", "\\Q" + delim + "\\E")[0]).alias("feature")).distinct()
        fields = feat.dictionary(names.filter(F.col("feature") != feat.BIAS), True).withColumnRenamed("feature", "field")
    return saved(continuous.indexed(rows, words, fields=fields, field_delim=delim), "rows"), words, stats


def field_delim(c: dict) -> str:
    return get(c, "data.field_delim", get(c, "data.delim.field_delim", "@"))


def _random(c: dict) -> dict:
    """How coefficients begin, if the configuration says so."""
    if get(c, "random.mode") is None:
        return {}
    return {"mode": get(c, "random.mode"), "seed": get(c, "random.seed", 1), "mean": get(c, "random.normal.mean", 0.0), "std": get(c, "random.normal.std", 0.01), "low": get(c, "random.uniform.range_start", -0.01), "high": get(c, "random.uniform.range_end", 0.01)}


def moved(w: np.ndarray, was: dict[str, int], index: dict[str, int], fresh: np.ndarray, head: int = 0, rows=None, flat=None) -> np.ndarray:
    """Coefficients of a model with other features: those of known names, else ``fresh`` ones. head: leaves before them."""
    rows, flat = rows or (lambda v, n: v.reshape(n, -1)), flat or (lambda m: m.ravel())
    out, old = rows(fresh[head:].copy(), len(index)), rows(w[head:], len(was))
    for name, i in index.items():
        if name in was:
            out[i] = old[was[name]]
    return np.concatenate([w[:head], flat(out)])


def with_init(samples: DataFrame, objective: str, base: float | None = None) -> DataFrame:
    """init: the score of a row's own initial prediction (0 without one), plus ``base``."""
    from .functions.losses import C

    o = loss_of(objective)
    own = F.coalesce(o.inverse(C, F.get("init_pred", 0)), F.lit(0.0))
    return samples.withColumn("init", own if base is None else own + F.lit(float(base))).drop("init_pred")


def train(samples: DataFrame, config: dict | str, test: DataFrame | None = None, start: Predictor | None = None, dump=None) -> Predictor:
    """samples: weight, label (array), features (map), init_pred (array) if base predictions depend on samples.

    start continues a model; dump(number, predictor) is called at each iteration, tree or round.
    """
    c = _config(config)
    kind, objective = get(c, "type", get(c, "model_name", "linear")), get(c, "loss.loss_function", get(c, "optimization.loss_function", "sigmoid"))
    loss_of(objective)
    if rates := get(c, "data.y_sampling", []):
        if not pure_classification(objective):
            raise ValueError("y_sampling needs a classification objective")
        samples = feat.label_sampling(samples, {float(a): float(b) for a, b in (r.split("@") for r in rates)}, objective)
    own = get(c, "sample_dependent_base_prediction", get(c, "optimization.sample_dependent_base_prediction", False)) and "init_pred" in samples.columns
    if kind in ("gbdt", "gradient_boosting", "random_forest"):
        return _train_gbdt(samples, c, objective, own, start, dump)
    if own and kind.startswith("gb"):
        samples = with_init(samples, objective)
    if "init_pred" in samples.columns:
        samples = samples.drop("init_pred")
    rows, words, stats = prepared(samples, c)
    test_rows = prepared(test.drop("init_pred"), c, words, stats)[0] if test is not None else None
    # the driver holds a name a coefficient, as it holds the coefficients
    index = {r["feature"]: r["idx"] for r in words.collect()}
    n, k, bias = len(index), get(c, "k", 1), get(c, "model.need_bias", True)
    l1, l2 = get(c, "loss.regularization.l1", [0.0]), get(c, "loss.regularization.l2", [0.0])
    settings, random = _settings(c), _random(c)
    if kind.startswith("gb"):
        old = None
        if start is not None:
            again = []
            for m, w in start.model.trees:
                fresh = continuous.build(kind, n, k=m.k)
                again.append((fresh, moved(w, start.index, index, np.zeros(fresh.dim), m.k if m.scalar else 0)))
            old = continuous.Ensemble(again, start.model.kind, start.model.learning_rate, start.model.base_score)
        each = (lambda i, e: dump(i, Predictor(e, objective, index=index, bias=bias))) if dump else None
        trees = len(old.trees) if old and get(c, "loss.just_evaluate", False) else get(c, "tree_num", 1)
        span = get(c, "leaf_random_init_range")
        model = continuous.train_ensemble(rows, kind, n, objective, trees, settings, get(c, "learning_rate", 0.1), get(c, "model_type", "gradient_boosting"), k, l1, l2, get(c, "instance_sample_rate", 1.0), get(c, "feature_sample_rate", 1.0), get(c, "uniform_base_prediction", 0.5), start=old, leaf_range=(span if isinstance(span, list) else [-span, span]) if span else None, random=random, on_tree=each)
        return Predictor(model, objective, index=index, bias=bias)
    options: dict = {}
    if kind in ("fm", "ffm"):
        first, latent = k if isinstance(k, list) else (1, k)
        options = {"k": latent, "first_order": bool(first), "bias_latent": get(c, "bias_need_latent_factor", False), "bias": bias}
        if kind == "ffm":
            options["fields"] = rows.agg(F.max(F.array_max("fld"))).first()[0] + 1
    model = continuous.build(kind, n, k if kind == "multiclass_linear" else 1, **options)
    field_of = None
    if kind == "ffm":
        delim = field_delim(c)
        names = sorted({x.split(delim)[0] for x in index if x != feat.BIAS})
        if get(c, "model.field_dict_path"):
            from .sources.models import read_dictionary

            names = sorted(r["feature"] for r in read_dictionary(samples.sparkSession, get(c, "model.field_dict_path")).collect())
            options["fields"] = model.fields = len(names) + 1
        field_of = FieldOf(names, delim)
    made = lambda w: Predictor(model, objective, w, index, field_of, bias)
    fresh = continuous.initial(model, **random) if random else continuous.initial(model, "zero" if kind in ("linear", "multiclass_linear") else "normal")
    if start is not None:
        from .sources.models import fm_rows, fm_vector

        shape = {"rows": fm_rows, "flat": fm_vector} if kind in ("fm", "ffm") else {}
        fresh = moved(start.w, start.index, index, fresh, **shape)
    each = (lambda i, w: dump(i, made(w))) if dump else None
    last = [fresh]

    def fit(a, b):
        got = continuous.train(rows, model, objective, settings, a, b, fresh if get(c, "hyper.restart", True) else last[0], test_rows, bias, just_evaluate=get(c, "loss.just_evaluate", False), on_iteration=each)
        last[0] = got.w
        return got

    if get(c, "hyper.switch_on", False) and test_rows is not None:
        if get(c, "hyper.mode") == "grid":
            g1, g2 = get(c, "hyper.grid.l1", [0, 0, 0]), get(c, "hyper.grid.l2", [0, 0, 0])
            _, got, _ = grid_search(lambda a, b: ((t := fit([a], [b])).test_loss, t), g1, g2)
        else:
            mask = np.zeros(model.dim)
            for a, z, *_ in model.penalty_ranges([0.0], [1.0], bias):
                mask[a:z] = 1

            def once(lam):
                t = fit([0.0], [lam])
                _, g, wt = continuous.evaluate(test_rows, model, objective, t.w)
                return t.result, t.test_loss, g / max(wt, 1e-300)

            weight = rows.agg(F.sum("weight")).first()[0]
            begin = get(c, "hyper.hoag.init_l2", (get(c, "hyper.hoag.l2") or l2)[0] or 1.0)
            best, _ = hoag(once, float(begin), weight, mask, get(c, "hyper.hoag.init_step", 1.0), get(c, "hyper.hoag.step_decr_factor", 0.7), get(c, "hyper.hoag.test_loss_reduce_limit", 1e-5), get(c, "hyper.hoag.outer_iter", 10))
            got = fit([0.0], [best])
    else:
        got = fit(l1, l2)
    return made(got.w)


def _train_gbdt(samples: DataFrame, c: dict, objective: str, own: bool = False, start: Predictor | None = None, dump=None) -> Predictor:
    o = "optimization."
    ex = samples.select("weight", F.explode("features").alias("feature", "value"))
    names = sorted(r["feature"] for r in feat.feature_counts(ex, get(c, "feature.filter_threshold", 0)).select("feature").collect())
    fills = {r["feature"]: r["fill"] for r in feat.missing_values(ex, get(c, "feature.missing_value", "value")).collect()}
    # absent features count as their fill value, so that is a candidate too
    rules = [dict(r, cols=r["cols"] if r["cols"] == "default" or isinstance(r["cols"], list) else r["cols"].split(",")) for r in get(c, "feature.approximate") or [DEFAULT_RULE]]
    found = saved(binning.candidates(ex, rules), "candidates")
    if (many := found.count()) > MOST_VALUES:
        raise ValueError(f"{many} candidate split values in all; choose sample_by_quantile or another rule with fewer than {MOST_VALUES}")
    got = found.groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("v")).collect()
    values = {r["feature"]: np.union1d(r["v"], [fills.get(r["feature"], 0.0)]) for r in got}
    p = gbdt.Params(rounds=get(c, o + "round_num", 10), learning_rate=get(c, o + "regularization.learning_rate", 0.1), max_depth=get(c, o + "max_depth", 6), max_leaves=get(c, o + "max_leaf_cnt", 64), policy=get(c, o + "tree_grow_policy", "level"), min_child_hess=get(c, o + "min_child_hessian_sum", 1.0), min_split_samples=get(c, o + "min_split_samples", -1), min_split_loss=get(c, o + "min_split_loss", 1e-5), max_abs_leaf=get(c, o + "max_abs_leaf_val", 0.0) or 0.0, l1=get(c, o + "regularization.l1", 0.0), l2=get(c, o + "regularization.l2", 0.0), feature_rate=get(c, o + "feature_sample_rate", 1.0), instance_rate=get(c, o + "instance_sample_rate", 1.0), averaged="random_forest" in (get(c, "model_type"), get(c, "type")), split_type=get(c, "feature.split_type", "mean"), lad_refine=objective == "l1", base_prediction=get(c, o + "uniform_base_prediction", 0.5), zmax=get(c, o + "sigmoid_zmax", 0.0) or 0.0)
    old = None
    if start is not None:
        # the model's features by their place in this data; those that it lacks are all missing
        for f in start.model.features:
            if f not in values:
                values[f] = np.array([fills.setdefault(f, 0.0)])
                names.append(f)
        place = {f: i for i, f in enumerate(names)}
        old = gbdt.Forest(names, [gbdt.Tree([gbdt.Node(**{**n.__dict__, "feature": place[start.model.features[n.feature]] if not n.leaf else -1}) for n in t.nodes]) for t in start.model.trees], start.model.objective, start.model.groups, start.model.base_prediction, start.model.averaged)
        for t in old.trees:  # the model's own thresholds split the bins, too
            for n in t.nodes:
                if not n.leaf:
                    values[names[n.feature]] = np.union1d(values[names[n.feature]], [n.threshold])
        p.rounds = max(0, p.rounds - len(old.trees) // old.groups)
    if own:
        base = 0.0 if get(c, o + "class_num", 1) > 1 else gbdt.Forest(names, [], objective, 1, p.base_prediction).base_score
        samples = with_init(samples, objective, base)
    if old is not None and (p.rounds == 0 or get(c, o + "just_evaluate", False)):
        return Predictor(old, objective)
    each = (lambda i, f: dump(i, Predictor(f, objective))) if dump else None
    forest = gbdt.train(samples, names, values, objective, p, get(c, o + "class_num", 1), fills, "init" if own else None, old, each)
    return Predictor(forest, objective)


def predict(predictor: Predictor, samples: DataFrame, kind: str = "value") -> DataFrame:
    return predictor.apply(samples, kind)


def evaluate(predictor: Predictor, samples: DataFrame, names: list[str]) -> dict[str, float]:
    """Metrics of a scalar objective, with the mean loss."""
    from .functions.losses import C

    got = predictor.apply(predictor.apply(samples, "score", "s"), "value", "p")
    loss = loss_of(predictor.objective).loss(C, F.col("s")[0], F.col("label")[0])
    return metrics.evaluate(got.select(F.col("label")[0].alias("y"), F.col("p")[0].alias("p"), F.col("weight").alias("w"), loss.alias("__loss")), names, F.col("__loss"))
