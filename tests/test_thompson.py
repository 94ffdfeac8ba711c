"""Thompson sampling with alpha > 0 and precisions from data, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from loamlearn.operators import continuous
from loamlearn.plans import queries as Q

DIR = "/root/testdata/sf0.001"


def test_drawn_scores(spark):
    pdf = Q.s_bin(spark, DIR).toPandas()
    x = np.column_stack([np.ones(len(pdf)), *(pdf[n] for n in Q.NAMES)])
    weight, w, l2, alpha = pdf["w"].to_numpy(), np.array([Q.BIAS, *Q.FIXED.values()]), 0.001, 0.5
    model = continuous.build("linear", 6)
    rows = Q._index_rows(spark, DIR).withColumnRenamed("w", "weight").withColumn("label", F.array("y"))
    got = continuous.precisions(rows, model, "sigmoid", w, l2)
    p = 1 / (1 + np.exp(-x @ w))
    want = ((weight * p * (1 - p))[:, None] * x**2).sum(axis=0) + weight.sum() * l2
    np.testing.assert_allclose(got[1:], want[1:], rtol=1e-4)
    draws = np.array([continuous.thompson(w, got, alpha, seed) for seed in range(4000)])
    assert np.abs(draws[:, 0] - w[0]).max() < 1e-12 and len(np.unique(draws[:, 1])) == 4000
    sd = alpha / np.sqrt(want[1:])
    assert (np.abs(draws[:, 1:].mean(axis=0) - w[1:]) < 5 * sd / np.sqrt(4000)).all()
    np.testing.assert_allclose(draws[:, 1:].std(axis=0), sd, rtol=0.06)
    scored = continuous.scored(Q._index_rows(spark, DIR), model, draws[7]).select(*Q.KEY, F.col("scores")[0].alias("s")).toPandas()
    mine = scored.merge(pdf[Q.KEY].assign(t=x @ draws[7]), on=Q.KEY)
    assert len(mine) == len(pdf) and np.allclose(mine["s"], mine["t"], atol=1e-5) and np.abs(x @ draws[7] - x @ w).max() > 1e-4
