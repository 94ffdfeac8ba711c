import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlearn import api
from loamlearn.functions import losses as L
from loamlearn.functions.quantile import Summary, summaries
from loamlearn.operators import binning, continuous as C, gbdt, metrics, optim, score
from loamlearn.plans.queries import FOREST
from loamlearn.sources import models as M


def _rows(rng, n=30, feats=6, fields=None):
    row = np.repeat(np.arange(n), 4)
    idx = np.concatenate([[0, *rng.choice(np.arange(1, feats), 3, replace=False)] for _ in range(n)])
    return C.Rows(n, row, idx, rng.normal(size=len(row)), None if fields is None else fields[idx])


@pytest.mark.parametrize("kind,options", [("linear", {}), ("multiclass_linear", {"classes": 4}), ("fm", {"k": 3}), ("ffm", {"k": 2, "fields": 3}), ("gbmlr", {"k": 3}), ("gbsdt", {"k": 4}), ("gbhmlr", {"k": 5}), ("gbhsdt", {"k": 3})])
def test_gradients(kind, options):
    rng = np.random.default_rng(0)
    fields = np.array([0, 1, 1, 2, 2, 1])
    rows = _rows(rng, fields=fields if kind == "ffm" else None)
    m = C.build(kind, 6, **options)
    w = rng.normal(size=m.dim) * 0.5
    if kind in ("fm", "ffm"):
        w[6 : 6 + (m.dim - 6) // 6] = 0  # the bias has no latent part
    slope = rng.normal(size=m.forward(w, rows)[0].shape)
    got = m.backward(w, rows, m.forward(w, rows)[1], slope)
    for i in rng.choice(m.dim, min(m.dim, 25), replace=False):
        if kind in ("fm", "ffm") and 6 <= i < 6 + (m.dim - 6) // 6:
            continue
        if kind == "multiclass_linear":
            pass
        e = np.zeros(m.dim)
        e[i] = 1e-6
        num = ((m.forward(w + e, rows)[0] - m.forward(w - e, rows)[0]) * slope).sum() / 2e-6
        assert got[i] == pytest.approx(num, rel=1e-4, abs=1e-6)
    if kind.startswith("gb"):
        np.testing.assert_allclose(m.gates(w, rows).sum(axis=1), 1)


def test_lbfgs_and_owlqn():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 5))
    y = a @ np.array([1.0, -2, 0, 0, 3]) + rng.normal(size=60) * 0.1
    f = lambda w: (0.5 * ((a @ w - y) ** 2).sum(), a.T @ (a @ w - y))
    got = optim.minimise(f, np.zeros(5), optim.Settings(max_iter=100, eps=1e-8), optim.Penalty([(0, 5, 0.0, 0.5)]))
    np.testing.assert_allclose(got.w, np.linalg.solve(a.T @ a + 0.5 * np.eye(5), a.T @ y), rtol=1e-5)
    for mode in ("sufficient_decrease", "strong_wolfe"):
        assert optim.minimise(f, np.zeros(5), optim.Settings(max_iter=100, eps=1e-8, line_search=mode)).value == pytest.approx(f(np.linalg.lstsq(a, y, rcond=None)[0])[0], rel=1e-4)
    sparse = optim.minimise(f, np.zeros(5), optim.Settings(max_iter=200, eps=1e-6), optim.Penalty([(0, 5, 5.0, 0.0)]))
    g = a.T @ (a @ sparse.w - y)
    assert (np.abs(g[sparse.w == 0]) <= 5 + 1e-3).all() and (sparse.w == 0).sum() >= 1
    np.testing.assert_allclose(g[sparse.w != 0], -5 * np.sign(sparse.w[sparse.w != 0]), rtol=1e-2)
    assert optim.grid((1, 1, 1), (0, 2, 2)) == [(1, 0), (1, 1), (1, 2)]


def test_split_against_brute_force():
    rng = np.random.default_rng(2)
    p = gbdt.Params(l1=0.1, l2=1.0, min_child_hess=2.0)
    for _ in range(20):
        hist = rng.normal(size=(3, 7, 3))
        hist[..., 1] = np.abs(hist[..., 1]) * (rng.random((3, 7)) < 0.8)
        hist[..., 0] *= hist[..., 1] > 0
        hist[1:, :, :2] *= hist[0, :, :2].sum(axis=0) / hist[1:, :, :2].sum(axis=1, keepdims=True)
        hist[..., 1] = np.abs(hist[..., 1])
        best = None
        for f in range(3):
            g, h = hist[f, :, 0], hist[f, :, 1]
            used = np.flatnonzero((g != 0) | (h != 0))
            for b in used[:-1]:
                lg, lh, rg, rh = g[: b + 1].sum(), h[: b + 1].sum(), g[b + 1 :].sum(), h[b + 1 :].sum()
                if min(lh, rh) < 2:
                    continue
                gain = float(gbdt.gain_of(lg, lh, p) + gbdt.gain_of(rg, rh, p) - gbdt.gain_of(lg + rg, lh + rh, p))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b)
        got = gbdt.best_split(hist, p)
        assert (got is None) == (best is None) and (got is None or got[0] == pytest.approx(best[0], rel=1e-6, abs=1e-9))


def test_model_text_round_trip():
    f = M.read_forest(FOREST)
    again = M.read_forest(M.forest_lines(f))
    assert f == again
    v = np.array([[10, 0.1, 0.01], [30, 0.01, 0.5], [30, np.nan, 0.5], [np.nan, 0.1, np.nan]])
    np.testing.assert_array_equal(f.leaf_ids(v), [[1, 1], [3, 2], [4, 2], [1, 2]])
    names = ["_bias_", "a", "b"]
    assert M.read_linear(M.linear_lines(names, np.array([1.5, 0, -2]), np.array([1, 1, 3.0]))) == {"_bias_": (1.5, None), "b": (-2.0, 3.0)}
    w = np.random.default_rng(0).normal(size=3 * 4)
    np.testing.assert_array_equal(M.fm_vector(np.stack([M.read_vectors(M.vector_lines(names, M.fm_rows(w, 3)))[n] for n in names])), w)
    for scalar, dim in ((True, 3 + 3 * 2), (False, 3 * 5)):
        w = np.random.default_rng(1).normal(size=dim)
        k, got = M.read_soft_tree(M.soft_tree_lines(names, w, 3, scalar), names, scalar)
        assert k == 3
        np.testing.assert_array_equal(got, w)


def test_summary_error():
    rng = np.random.default_rng(5)
    v, w = rng.permutation(10_000).astype(float), rng.random(10_000)
    s = Summary(entries=200)
    for i in range(0, 10_000, 500):
        s = s.merge(Summary(v[i : i + 500], w[i : i + 500], 200))
    order = np.argsort(v)
    cum = np.cumsum(w[order])
    for q in (0.01, 0.3, 0.5, 0.99):
        rank = cum[np.searchsorted(v[order], s.query(q))] / cum[-1]
        assert abs(rank - q) < 0.03


def test_summaries_of_tasks_without_rows(spark):
    got = summaries(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, value double").repartition(1).union(spark.createDataFrame([], "feature string, value double")), "feature", "value").collect()
    assert {r["feature"]: Summary.from_bytes(r["summary"], 10).query(0.5) for r in got} == {"a": 1.0, "b": 2.0}


def test_summaries_of_many_pieces(spark):
    """The error of ranks doesn't grow with the batches and tasks that are merged."""
    n = 400_000
    rows = spark.range(n, numPartitions=70).select(F.lit("a").alias("feature"), ((F.col("id") * 7919) % n).cast("double").alias("value"), (F.col("id") % 3 + 1).cast("double").alias("w"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        s = Summary.from_bytes(summaries(rows, "feature", "value", "w", 50).first()["summary"], 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    i = np.arange(n)
    weight = np.zeros(n)
    weight[i * 7919 % n] = i % 3 + 1
    rank = np.cumsum(weight) / weight.sum()
    assert s.total == weight.sum()
    assert max(abs(rank[int(s.query(q))] - q) for q in np.arange(1, 100) / 100) < 1 / 100


def test_bins():
    v = np.array([1.0, 2, 4, 8])
    assert binning.assign(np.array([0, 1.4, 1.5, 2.9, 3, 100]), binning.bin_edges(v)).tolist() == [0, 0, 1, 1, 2, 3]
    assert binning.split_value(v, 1, 2) == 3 and binning.split_value(v, 0, 2, "median") == 2


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] - 2 * x[:, 1] + x[:, 2] * x[:, 3] + 0.3 * rng.normal(size=400)) > 0).astype(float)
    return spark.createDataFrame([(1.0, [float(t)], {f"f{j % 2}@{j}": float(v) for j, v in enumerate(r)}) for r, t in zip(x, y, strict=True)], "weight double, label array<double>, features map<string,double>").repartition(3)


@pytest.mark.parametrize("kind,extra", [("linear", ""), ("fm", "k : [1, 2]\n"), ("ffm", "k : [1, 2]\n"), ("gbsdt", "k : 3\ntree_num : 2\n"), ("gbhmlr", "k : 3\ntree_num : 1\n")])
def test_train_api(spark, samples, kind, extra):
    p = api.train(samples, f"type : {kind}\n{extra}loss {{ loss_function : sigmoid, regularization {{ l1 : [0.0, 0.0], l2 : [0.001, 0.001] }} }}\noptimization.line_search.lbfgs.convergence.max_iter : 8")
    got = api.evaluate(p, samples, ["auc@1000", "rmse"])
    assert got["auc@1000"] > 0.85 and got["loss"] < 0.6
    one = samples.limit(3).collect()
    np.testing.assert_allclose([r["predicts"] for r in api.predict(p, spark.createDataFrame(one, samples.schema)).collect()], [p.predict(r["features"]) for r in one])


def test_train_gbdt(spark, samples):
    for policy in ("level", "loss"):
        p = api.train(samples, f"type : gbdt\noptimization {{ loss_function : sigmoid, round_num : 3, max_depth : 3, max_leaf_cnt : 6, tree_grow_policy : {policy} }}\nfeature.approximate : [{{cols: default, type: sample_by_quantile, max_cnt: 15}}]")
        assert api.evaluate(p, samples, ["auc"])["auc"] > 0.85
        for t in p.model.trees:
            assert t.leaves <= 6
            for n in t.nodes:
                if not n.leaf:
                    assert n.count == t.nodes[n.left].count + t.nodes[n.right].count
                    assert n.hess == pytest.approx(t.nodes[n.left].hess + t.nodes[n.right].hess)
    more = gbdt.train(samples, p.model.features, {f: np.linspace(-2, 2, 9) for f in p.model.features}, "sigmoid", gbdt.Params(rounds=1, max_depth=2), start=gbdt.Forest(p.model.features, [], "sigmoid"))
    assert len(more.trees) == 1


def test_gbdt_multiclass_and_lad(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    c = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    df = spark.createDataFrame([(1.0, [float(t)], {"a": float(r[0]), "b": float(r[1])}) for r, t in zip(x, c, strict=True)], "weight double, label array<double>, features map<string,double>")
    values = {"a": np.linspace(-2, 2, 21), "b": np.linspace(-2, 2, 21)}
    f = gbdt.train(df, ["a", "b"], values, "softmax", gbdt.Params(rounds=3, max_depth=3, learning_rate=0.5), classes=3)
    assert (f.score(x).argmax(axis=1) == c).mean() > 0.9
    y = x[:, 0] * 3
    df = spark.createDataFrame([(1.0, [float(t)], {"a": float(r[0]), "b": float(r[1])}) for r, t in zip(x, y, strict=True)], "weight double, label array<double>, features map<string,double>")
    f = gbdt.train(df, ["a", "b"], values, "l1", gbdt.Params(rounds=1, max_depth=1, learning_rate=1.0, lad_refine=True, base_prediction=0.0))
    t = f.trees[0]
    at = t.route_values(x)
    for n in (1, 2):
        s = np.sort(y[at == n])
        assert t.nodes[n].value == pytest.approx(s[(len(s) + 1) // 2 - 1])


def test_save_modes_and_stream(spark, samples, tmp_path):
    from pyspark.sql import functions as F

    from loamlearn.streaming.scorer import scored_stream, windowed_loss

    p = score.Predictor(M.read_forest(FOREST), "sigmoid")
    df = spark.createDataFrame([("1###0###quantity:3", "0", {"quantity": 3.0})], "line string, label string, features map<string,double>")
    got = p.apply(df, "leafid", "leaf")
    assert score.saved_form(got, score.AS_FEATURE, F.col("leaf"), F.col("line"), model="m", kind="leafid").first()["value"] == "1###0###quantity:3,m_tree_leaf_0:1,m_tree_leaf_1:2"
    with pytest.raises(ValueError):
        score.saved_form(got, score.LABEL_AND_PREDICT, F.col("leaf"))
    src = str(tmp_path / "in")
    df.withColumn("ts", F.timestamp_seconds(F.lit(100))).withColumn("weight", F.lit(1.0)).write.parquet(src)
    stream = scored_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), p).withColumn("loss", F.col("predicts")[0])
    q = windowed_loss(stream, "ts", "loss").writeStream.format("memory").queryName("q_loss").outputMode("complete").start()
    q.processAllAvailable()
    assert spark.sql("SELECT * FROM q_loss").count() == 1
    q.stop()


def test_exact_auc(spark):
    rng = np.random.default_rng(4)
    p, y, w = np.round(rng.normal(size=500), 1), rng.integers(0, 2, 500), rng.random(500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(p, y, w, strict=True)], "p double, y double, w double")
    pos, neg = y == 1, y == 0
    cmp = (p[pos][:, None] > p[neg]) + 0.5 * (p[pos][:, None] == p[neg])
    want = (cmp * w[pos][:, None] * w[neg]).sum() / (w[pos].sum() * w[neg].sum())
    assert metrics.exact_auc(df).first()[0] == pytest.approx(want)
    assert L.pure_classification("softmax") and not L.pure_classification("l2")
