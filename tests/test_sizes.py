"""Joins by feature don't gather the rows of a feature, of which there may be very many, in one task."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamlearn.operators import binning, continuous as C, features as feat, gbdt, optim, score
from loamlearn.plans import session


@pytest.fixture
def ex(spark):
    # a table whose size Spark doesn't know, as of large inputs, and no small ones that it could send by itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.range(600, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("feature"), F.when(F.col("id") % 7 > 0, (F.col("id") % 50).cast("double")).alias("value"), F.lit(1.0).alias("weight"), F.col("id"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["standardization", "scale_range"])
def test_transforms(ex, name):
    got = feat.transform_features(ex, feat.feature_stats(ex), name)
    assert "SortMergeJoin" not in plan(got) and got.count() == 600


def test_fills(ex):
    got = feat.filled(ex, feat.missing_values(ex, "value@-1"))
    assert "SortMergeJoin" not in plan(got) and got.filter("value = -1").count() == ex.filter("value IS NULL").count()


def test_bins(ex):
    for got in (binning.by_count(ex, 20), binning.by_rate(ex, 0.5, 3), binning.by_precision(ex, 1), binning.by_quantile(ex, 16)):
        assert "SortMergeJoin" not in plan(got)
    assert binning.by_count(ex, 20).groupBy("feature").count().filter("count > 20").count() == 0


def test_scores(spark, ex):
    got = score.parallel_linear(ex.drop("weight"), spark.createDataFrame([("a", 2.0), ("b", 0.5)], "feature string, weight double"), ("id",))
    assert "SortMergeJoin" not in plan(got) and got.count() == 400


def test_many_features_are_not_sent(spark, ex, monkeypatch):
    monkeypatch.setattr(session, "SENT_ROWS", 2)
    got = feat.filled(ex, feat.missing_values(ex, "value@-1"))
    assert "SortMergeJoin" in plan(got) and got.count() == 600


@pytest.fixture
def rows(spark):
    return spark.range(60_000, numPartitions=1).select(F.array((F.col("id") % 2).cast("double")).alias("label"), (1.0 + F.col("id") % 3).alias("weight"), F.array(F.lit(0), F.col("id") % 5 + 1).cast("array<bigint>").alias("idx"), F.array(F.lit(1.0), F.rand(3)).alias("val"))


def test_packed_rows_follow_splits_of_files(spark, rows, monkeypatch):
    def count(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in C.unpacked(batches))]})

    monkeypatch.setattr(C, "PACKED_GROUP", 1 << 18)
    monkeypatch.setattr(C, "PIECE", 1 << 12)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        mine = C.packed(rows)
        assert rows.rdd.getNumPartitions() == 1 and mine.rdd.getNumPartitions() > 2
        sizes = mine.mapInArrow(count, "n long").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["n"] for r in sizes) == 60_000 and max(r["n"] for r in sizes) < 60_000
    assert mine.agg(F.sum("n"), F.sum("weight")).first() == (60_000, 120_000.0)


def test_packed_rows_train_alike(spark, rows):
    m, w = C.build("linear", 6), np.arange(6) / 10
    mine = C.packed(rows.withColumn("z", F.col("weight") / 10))
    for a, b in zip(C.evaluate(rows.withColumn("z", F.col("weight") / 10), m, "sigmoid", w), C.evaluate(mine, m, "sigmoid", w), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    session.remove(mine)
    got = C.train(rows, m, "sigmoid", optim.Settings(max_iter=3), test=rows.limit(100))
    assert got.weight == 120_000 and got.test_loss > 0


def test_packed_rows_are_deleted(spark, rows, monkeypatch):
    made = []
    monkeypatch.setattr(C, "saved", lambda df, *more: made.append(session.saved(df, *more)) or made[-1])
    C.train(rows, C.build("linear", 6), "sigmoid", optim.Settings(max_iter=1))
    folders = {f.rsplit("/", 1)[0].removeprefix("file:") for df in made for f in df.inputFiles()}
    assert len(made) == 1 and folders and not any(os.path.exists(f.replace("//", "/")) for f in folders)


@pytest.mark.parametrize("kind", ["linear", "gbmlr", "gbhsdt"])
def test_rows_of_the_same_features_go_as_a_matrix(kind):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    batch = pa.RecordBatch.from_pydict({"idx": [[0, 3, 3, 5]] * 20, "val": rng.normal(size=(20, 4)).tolist()})
    fast = C.read_rows(batch)
    assert fast.same.tolist() == [0, 3, 3, 5]
    assert C.read_rows(pa.RecordBatch.from_pydict({"idx": [[0, 3], [0, 4]], "val": [[1.0, 1.0]] * 2})).same is None
    slow = C.Rows(fast.n, fast.row, fast.idx, fast.val)
    m = C.build(kind, 7, **({} if kind == "linear" else {"k": 4}))
    w, slope = rng.normal(size=m.dim), rng.normal(size=(20, 1))
    (a, kept), (b, other) = m.forward(w, fast), m.forward(w, slow)
    np.testing.assert_allclose(a, b, rtol=1e-9)
    np.testing.assert_allclose(m.backward(w, fast, kept, slope), m.backward(w, slow, other, slope), rtol=1e-9, atol=1e-12)


@pytest.fixture
def boosted(spark):
    x = [F.when(F.col("id") % 11 > 0, (F.col("id") * k % 7).cast("double")) for k in (3, 5)]
    return spark.range(900, numPartitions=3).select(F.array((F.col("id") % 2).cast("double")).alias("label"), (1.0 + F.col("id") % 3).alias("weight"), F.create_map(F.lit("a"), x[0], F.lit("b"), x[1]).alias("features"), F.array(F.lit(0.25)).alias("first"))


def test_a_task_of_boosting_has_one_python_worker(boosted, monkeypatch):
    plans = []
    save, count = session.Rolling.save, gbdt.histograms
    monkeypatch.setattr(session.Rolling, "save", lambda self, df: plans.append(plan(df)) or save(self, df))
    monkeypatch.setattr(gbdt, "histograms", lambda rows, *more: plans.append(plan(rows)) or count(rows, *more))
    forest = gbdt.train(boosted, ["a", "b"], {n: np.arange(7.0) for n in "ab"}, "sigmoid", gbdt.Params(rounds=2, max_depth=2))
    assert len(forest.trees) == 2 and max(p.count("MapInArrow") for p in plans) == 1


def test_one_pass_begins_like_two(boosted):
    values, forest, p = {n: np.arange(7.0) for n in "ab"}, gbdt.Forest(["a", "b"]), gbdt.Params(instance_rate=0.5)
    for first in (None, "first"):
        two = gbdt.advanced(gbdt.prepare(boosted, ["a", "b"], values, {"a": 2.0}, first).withColumn("sum", F.array(F.lit(0.0))), [], forest, p, 0)
        one = gbdt.begin(boosted, ["a", "b"], values, forest, p, 0, {"a": 2.0}, first)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert 0 < one.filter("sampled").count() < 900


def test_rows_of_the_driver_need_no_tasks(spark):
    got = session.local(spark, [(1, None, 0.5, True), (2, "x", float("nan"), False)], "n int, s string, x double, b boolean")
    assert "RDD" not in plan(got) and str(got.collect()) == "[Row(n=1, s=None, x=0.5, b=True), Row(n=2, s='x', x=nan, b=False)]"
    assert got.schema == spark.createDataFrame([], "n int, s string, x double, b boolean").schema
    assert session.local(spark, [], "n int").count() == 0
