import numpy as np
import pytest

from loamlearn.llm import topk


def _brute(rows, k):
    fine = [(i, [np.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({(i, tuple(v)) for i, v in fine if i % 20 == 0}):
        got = sorted((-sum(int(a) * int(b) for a, b in zip(qv, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows,leaf_rows", [(1000, 100, 16), (40, 5, 4)])
def test_topk(spark, shard_rows, block_rows, leaf_rows):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(150)] + [(3, [1.0] * 5)] * 7 + [(200 + i, [2.0] * 5) for i in range(30)]
    rows += [(400, None), (420, [1.0, None, 1.0, 1.0, 1.0]), (440, [float("nan")] * 5), (460, [float("inf")] * 5), (None, [1.0] * 5), (480, [1.0, 2.0]), (481, [3.0, 4.0]), (500, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 20, shard_rows=shard_rows, block_rows=block_rows, leaf_rows=leaf_rows).collect())
    assert got == _brute(rows, 20)


def test_edges(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df).count() == 0
    df = spark.createDataFrame([(20, [1e9, 2e9]), (21, [3e9, 1.0]), (22, [-1e12, 5.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0")).orderBy("rank").collect()]
    f = [[int(64e9), int(128e9)], [int(192e9), 64], [int(-64e12), 320]]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    assert got == [(20, 1, 21, dot(f[0], f[1])), (20, 2, 22, dot(f[0], f[2]))]


def test_boxes_are_tight_and_halves_even():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1000, 6))
    t = topk.Tree(np.arange(1000), np.ones(1000, int), v, 50)
    for (a, b), x, y, lo, hi in zip(t.spans, t.left, t.right, t.low, t.high, strict=True):
        np.testing.assert_array_equal(lo, t.vecs[a:b].min(axis=0))
        np.testing.assert_array_equal(hi, t.vecs[a:b].max(axis=0))
        if x >= 0:
            assert abs((t.spans[x][1] - t.spans[x][0]) - (t.spans[y][1] - t.spans[y][0])) <= 1


def _frame(spark, vecs):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in vecs], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("shard_rows", [1000, 21, 7])
def test_large_scores_across_shards(spark, shard_rows):
    """Scores beyond 2**53, a unit apart: the k-th score must travel as an integer."""
    rows = [(i, (2.0**24, i / 64)) for i in range(1, 41)] + [(100, (2.0**24, 1 / 64))]
    df = _frame(spark, rows)
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id = 100"), 20, shard_rows=shard_rows, leaf_rows=4).collect())
    assert [r[2] for r in got] == list(range(40, 20, -1)) and got[0][3] - got[1][3] == 1


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(i, centres[i % 30] + rng.normal(size=16) * 0.3) for i in range(3000)]
    df = _frame(spark, rows)
    asked = df.filter("vec_id % 20 = 0")
    assert topk.scored_share(df, asked, 10, shard_rows=200, leaf_rows=16) < 0.5
    got = sorted(tuple(r) for r in topk.top_k(df, asked, 10, shard_rows=200, leaf_rows=16).collect())
    assert got == _brute([(i, v.tolist()) for i, v in rows], 10)


def test_cells_hold_every_row_once():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(500, 3)), np.ones((200, 3))])
    nodes = topk.split_cells(v, 13)
    cells = topk.cell_of(v, nodes)
    assert sorted(n[2] for n in nodes if n[0] < 0) == list(range(cells.max() + 1)) and len(set(cells[500:])) == 1
    assert set(topk.cell_of(np.ones((5, 3)), topk.split_cells(np.ones((9, 3)), 4))) == {0}
    assert topk.cell_of(np.zeros((2, 0)), topk.split_cells(np.zeros((0, 0)), 3)).tolist() == [0, 0]
