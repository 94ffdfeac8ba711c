"""Models with continuous coefficients: linear, multiclass linear, FM, FFM and four kinds of soft trees.

Samples become one row each with arrays idx and val (and field). A gradient is one job: every task
scores its rows with the broadcast coefficients and gives one partial sum; sums are folded in two
steps, and the driver runs the quasi-Newton loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import A, MultiLoss, loss as loss_of
from ..plans.session import remove, saved, sendable
from .features import BIAS
from .optim import Penalty, Result, Settings, minimise


@dataclass
class Rows:
    """Sparse rows: row number, feature, value and field of every entry; the features of a row, if all rows have the same ones."""

    n: int
    row: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    fld: np.ndarray | None = None
    same: np.ndarray | None = None


def sums(rows: Rows, values: np.ndarray) -> np.ndarray:
    """Sum of entry values by row; a second axis is kept."""
    if values.ndim == 1:
        return np.bincount(rows.row, values, rows.n)
    return np.stack([np.bincount(rows.row, values[:, j], rows.n) for j in range(values.shape[1])], axis=1)


def by_feature(rows: Rows, values: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(rows.idx, values, n)
    return np.stack([np.bincount(rows.idx, values[:, j], n) for j in range(values.shape[1])], axis=1)


def gathered(rows: Rows, m: np.ndarray) -> np.ndarray:
    """By row the sum of values times their features' coefficients, of which there may be several columns."""
    if rows.same is not None:
        return rows.val.reshape(rows.n, -1) @ m[rows.same]
    return sums(rows, m[rows.idx] * (rows.val if m.ndim == 1 else rows.val[:, None]))


def spread(rows: Rows, d: np.ndarray, n: int) -> np.ndarray:
    """By feature the sum of values times what their rows have in ``d``."""
    if rows.same is not None:
        out = np.zeros((n, *d.shape[1:]))
        np.add.at(out, rows.same, rows.val.reshape(rows.n, -1).T @ d)
        return out
    return by_feature(rows, d[rows.row] * (rows.val if d.ndim == 1 else rows.val[:, None]), n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


@dataclass
class Model:
    """n: features with the bias; scores are n x classes (1 for scalar objectives)."""

    n: int
    classes: int = 1

    @property
    def dim(self) -> int:
        raise NotImplementedError

    def forward(self, w: np.ndarray, rows: Rows) -> tuple[np.ndarray, tuple]:
        raise NotImplementedError

    def backward(self, w: np.ndarray, rows: Rows, kept: tuple, slope: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def penalty_ranges(self, l1: list[float], l2: list[float], bias: bool) -> list[tuple[int, int, float, float]]:
        return [(int(bias), self.dim, l1[0], l2[0])]


@dataclass
class Linear(Model):
    @property
    def dim(self):
        return self.n

    def forward(self, w, rows):
        return gathered(rows, w)[:, None], ()

    def backward(self, w, rows, kept, slope):
        return spread(rows, slope[:, 0], self.n)

    def precision(self, w, rows, second: np.ndarray) -> np.ndarray:
        """The diagonal of the objective's second derivative."""
        return by_feature(rows, second[rows.row] * rows.val**2, self.n)


@dataclass
class MulticlassLinear(Model):
    """Feature-major coefficients of the first K - 1 classes; the last class scores 0."""

    @property
    def dim(self):
        return self.n * (self.classes - 1)

    def forward(self, w, rows):
        m = w.reshape(self.n, -1)
        return np.concatenate([sums(rows, m[rows.idx] * rows.val[:, None]), np.zeros((rows.n, 1))], axis=1), ()

    def backward(self, w, rows, kept, slope):
        return by_feature(rows, slope[rows.row, :-1] * rows.val[:, None], self.n).ravel()

    def penalty_ranges(self, l1, l2, bias):
        return [((self.classes - 1) if bias else 0, self.dim, l1[0], l2[0])]


@dataclass
class FM(Model):
    """First-order coefficients, then k latent ones a feature."""

    k: int = 8
    first_order: bool = True
    bias_latent: bool = False
    bias: bool = True

    @property
    def dim(self):
        return self.n * (1 + self.k)

    def _v(self, w):
        v = w[self.n :].reshape(self.n, self.k)
        if self.bias and not self.bias_latent:
            v = v.copy()
            v[0] = 0
        return v

    def forward(self, w, rows):
        vx = self._v(w)[rows.idx] * rows.val[:, None]
        s = sums(rows, vx)
        pair = 0.5 * (s * s - sums(rows, vx * vx)).sum(axis=1)
        one = sums(rows, w[rows.idx] * rows.val) if self.first_order else (sums(rows, np.where(rows.idx == 0, w[0] * rows.val, 0.0)) if self.bias else 0)
        return (one + pair)[:, None], (vx, s)

    def backward(self, w, rows, kept, slope):
        vx, s = kept
        d = slope[rows.row, 0] * rows.val
        first = by_feature(rows, d, self.n)
        if not self.first_order:
            first[int(self.bias) :] = 0
        latent = by_feature(rows, d[:, None] * (s[rows.row] - vx), self.n)
        if self.bias and not self.bias_latent:
            latent[0] = 0
        return np.concatenate([first, latent.ravel()])

    def penalty_ranges(self, l1, l2, bias):
        two = (l1[-1], l2[-1])
        return [(int(bias), self.n, l1[0], l2[0]), (self.n, self.dim, *two)]


@dataclass
class FFM(Model):
    """First-order coefficients, then k latent ones a feature and opposite field."""

    k: int = 4
    fields: int = 1
    first_order: bool = True
    bias_latent: bool = False
    bias: bool = True

    @property
    def dim(self):
        return self.n * (1 + self.fields * self.k)

    def _pairs(self, rows):
        """All pairs of entries p < q of a row; a bias without latent part has none."""
        at = np.flatnonzero((rows.idx != 0) | (self.bias_latent or not self.bias))
        at = at[np.argsort(rows.row[at], kind="stable")]
        row = rows.row[at]
        end = np.searchsorted(row, row, "right")
        many = end - np.arange(len(at)) - 1
        p = np.repeat(np.arange(len(at)), many)
        q = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) + p + 1
        return at[p], at[q]

    def forward(self, w, rows):
        v = w[self.n :].reshape(self.n, self.fields, self.k)
        p, q = self._pairs(rows)
        a, b = v[rows.idx[p], rows.fld[q]], v[rows.idx[q], rows.fld[p]]
        pair = np.bincount(rows.row[p], (a * b).sum(axis=1) * rows.val[p] * rows.val[q], rows.n)
        one = sums(rows, w[rows.idx] * rows.val) if self.first_order else 0
        return (one + pair)[:, None], (p, q, a, b)

    def backward(self, w, rows, kept, slope):
        p, q, a, b = kept
        first = by_feature(rows, slope[rows.row, 0] * rows.val, self.n) if self.first_order else np.zeros(self.n)
        d = (slope[rows.row[p], 0] * rows.val[p] * rows.val[q])[:, None]
        g = np.zeros((self.n * self.fields, self.k))
        np.add.at(g, rows.idx[p] * self.fields + rows.fld[q], d * b)
        np.add.at(g, rows.idx[q] * self.fields + rows.fld[p], d * a)
        return np.concatenate([first, g.ravel()])

    penalty_ranges = FM.penalty_ranges


@dataclass
class SoftTree(Model):
    """K experts under gates: softmax or a binary tree of logistic gates; experts linear or scalar.

    Linear experts: per feature K - 1 gates, then K expert coefficients. Scalar experts: K leaves first,
    then K - 1 gates a feature. gate_mask: features whose gates are used (feature sampling).
    """

    k: int = 4
    hierarchical: bool = False
    scalar: bool = False
    gate_mask: np.ndarray | None = None

    @property
    def dim(self):
        return self.k + self.n * (self.k - 1) if self.scalar else self.n * (2 * self.k - 1)

    def _split(self, w):
        if self.scalar:
            gates, experts = w[self.k :].reshape(self.n, self.k - 1), w[: self.k]
        else:
            m = w.reshape(self.n, 2 * self.k - 1)
            gates, experts = m[:, : self.k - 1], m[:, self.k - 1 :]
        return (gates if self.gate_mask is None else gates * self.gate_mask[:, None]), experts

    def _leaves(self, logits):
        """Weights of the K experts and the gates' logistic values."""
        if not self.hierarchical:
            z = np.concatenate([logits, np.zeros((len(logits), 1))], axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True), None
        s = sigmoid(logits)
        node = np.ones((len(logits), 2 * self.k))
        for i in range(2, 2 * self.k):  # even nodes are left
            node[:, i] = node[:, i // 2] * (s[:, i // 2 - 1] if i % 2 == 0 else 1 - s[:, i // 2 - 1])
        return node[:, self.k :], s

    @property
    def depth(self) -> int:
        return max(1, ceil(log2(self.k))) if self.k > 1 else 0

    def gates(self, w, rows):
        g, _ = self._split(w)
        return self._leaves(gathered(rows, g))[0]

    def forward(self, w, rows):
        g, e = self._split(w)
        p, s = self._leaves(gathered(rows, g) if self.k > 1 else np.zeros((rows.n, 0)))
        h = np.broadcast_to(e, (rows.n, self.k)) if self.scalar else gathered(rows, e)
        f = (p * h).sum(axis=1)
        return f[:, None], (p, s, h, f)

    def backward(self, w, rows, kept, slope):
        p, s, h, f = kept
        d = slope[:, :1]
        if self.hierarchical:
            mean = np.zeros((rows.n, 2 * self.k))  # expected expert below each node
            mean[:, self.k :] = h
            reach = np.ones((rows.n, 2 * self.k))
            for i in range(self.k - 1, 0, -1):
                mean[:, i] = s[:, i - 1] * mean[:, 2 * i] + (1 - s[:, i - 1]) * mean[:, 2 * i + 1]
            for i in range(2, 2 * self.k):
                reach[:, i] = reach[:, i // 2] * (s[:, i // 2 - 1] if i % 2 == 0 else 1 - s[:, i // 2 - 1])
            i = np.arange(1, self.k)
            dg = d * reach[:, i] * s * (1 - s) * (mean[:, 2 * i] - mean[:, 2 * i + 1])
        else:
            dg = d * (p * (h - f[:, None]))[:, :-1]
        gates = spread(rows, dg, self.n) if self.k > 1 else np.zeros((self.n, 0))
        if self.gate_mask is not None:
            gates = gates * self.gate_mask[:, None]
        de = d * p
        if self.scalar:
            return np.concatenate([de.sum(axis=0), gates.ravel()])
        return np.concatenate([gates, spread(rows, de, self.n)], axis=1).ravel()

    def penalty_ranges(self, l1, l2, bias):
        if self.scalar:
            return [(0, self.k, l1[0], l2[0]), (self.k + (self.k - 1) * int(bias), self.dim, l1[-1], l2[-1])]
        return [((2 * self.k - 1) * int(bias), self.dim, l1[0], l2[0])]


KINDS = {"linear": Linear, "multiclass_linear": MulticlassLinear, "fm": FM, "ffm": FFM, "gbmlr": SoftTree, "gbsdt": SoftTree, "gbhmlr": SoftTree, "gbhsdt": SoftTree}


def build(kind: str, n: int, classes: int = 1, **options) -> Model:
    if kind in ("gbhmlr", "gbhsdt"):
        options["hierarchical"] = True
    if kind in ("gbsdt", "gbhsdt"):
        options["scalar"] = True
    return KINDS[kind](n=n, classes=classes, **options)


def indexed(samples: DataFrame, words: DataFrame, keys: tuple = ("sample_id",), fields: DataFrame | None = None, field_delim: str = "@") -> DataFrame:
    """Adds idx, val (fld): features of the dictionary only. samples: keys unique a row, features: map.

    The small side of both joins is the dictionary; the arrays come from one shuffle on the keys.
    """
    ex = samples.select(*keys, F.explode("features").alias("feature", "value")).join(sendable(words, "words"), "feature")
    entry = [F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("val")]
    if fields is not None:
        name = F.when(F.col("feature") == BIAS, F.lit(BIAS)).otherwise(F.split("feature", "\\Q" + field_delim + "\\E")[0])
        ex = ex.withColumn("field", name).join(fields.withColumnRenamed("idx", "fld"), "field")
        entry.append(F.col("fld").cast("long").alias("fld"))
    per = ex.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("e"))
    got = samples.drop("features").join(per, list(keys), "left").withColumn("e", F.coalesce("e", F.array().cast(per.schema["e"].dataType)))
    names = ["idx", "val"] + (["fld"] if fields is not None else [])
    return got.select(*[c for c in got.columns if c != "e"], *[F.col(f"e.{n}").alias(n) for n in names])


#: Bytes of packed rows in one value, before compression, and in a row group: Parquet ends a group after 100 values at
#: the earliest, and a task reads the groups in one of Spark's splits of a file.
PIECE, PACKED_GROUP = 1 << 20, 16 << 20


def packed(data: DataFrame) -> DataFrame:
    """block, n, weight: the rows that training reads, many of them in one value, and their number and sum of weights.

    A saved table. Each evaluation then reads it by splits of files, of bounded size however large the table, and
    no row is converted again.
    """
    if "block" in data.columns:
        return data
    data = data.select(*[c for c in ("label", "weight", "idx", "val", "fld", "z") if c in data.columns])
    piece = PIECE

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            step = max(1, batch.num_rows * piece // max(1, batch.nbytes))
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                    writer.write_batch(part)
                weight = part.column(part.schema.get_field_index("weight")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([part.num_rows], pa.int32()), pa.array([float(weight.sum())])], ["block", "n", "weight"])

    return saved(data.mapInArrow(run, "block binary, n int, weight double"), "packed", {"parquet.block.size": PACKED_GROUP, "compression": "none"})


def unpacked(batches):
    """Batches of rows, of packed ones or of such that are rows already."""
    import pyarrow as pa

    for batch in batches:
        at = batch.schema.get_field_index("block")
        if at < 0:
            yield batch
            continue
        for block in batch.column(at):
            with pa.ipc.open_stream(block.as_buffer()) as reader:
                yield from reader


def read_rows(batch) -> Rows:
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    lengths = get("idx").value_lengths().to_numpy(zero_copy_only=False)
    n, idx = batch.num_rows, get("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    has = batch.schema.get_field_index("fld") >= 0
    width = int(lengths[0]) if n and not np.isnan(lengths[0]) else 0
    same = idx[:width] if width and (lengths == width).all() and (idx.reshape(n, width) == idx[:width]).all() else None
    return Rows(n, np.repeat(np.arange(n), lengths), idx, get("val").flatten().to_numpy(zero_copy_only=False), get("fld").flatten().to_numpy(zero_copy_only=False).astype(np.int64) if has else None, same)


def _column(batch, name: str, default: float, width: int = 1) -> np.ndarray:
    i = batch.schema.get_field_index(name)
    if i < 0:
        return np.full((batch.num_rows, width), default)
    c = batch.column(i)
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) if hasattr(c, "flatten") and str(c.type).startswith("list") else c.to_numpy(zero_copy_only=False).astype(float)[:, None]


def loss_and_slope(objective, scores: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its derivative by each score."""
    if isinstance(objective, MultiLoss):
        k = scores.shape[1]
        s = [scores[:, j] for j in range(k)]
        y = [label[:, j] for j in range(k)] if label.shape[1] > 1 else [(label[:, 0] == j).astype(float) for j in range(k)]
        return objective.loss(A, s, y), np.stack(objective.first(A, s, y), axis=1)
    s, y = scores[:, 0], label[:, 0]
    return objective.loss(A, s, y), objective.first(A, s, y)[:, None]


#: Coefficients in one row of a partial gradient, tasks that are added at first, and bytes that the driver may add by itself.
SPREAD, FAN, DIRECT = 1 << 16, 64, 64 << 20


def evaluate(data: DataFrame, model: Model, objective_name: str, w: np.ndarray, options: dict | None = None, tasks: int | None = None) -> tuple[float, np.ndarray, float]:
    """(weighted loss, gradient, sum of weights): one job. data: label, weight, idx, val (fld, z), or packed.

    tasks: partitions of ``data``, if known. Unless all partial gradients together are small, ranges of coefficients
    are added on executors, FAN tasks at a time first.
    """
    sent = data.sparkSession.sparkContext.broadcast(w)
    opts = options or {}

    def run(batches):
        import pyarrow as pa

        objective, w = loss_of(objective_name, **opts), sent.value
        total, grad, weight, some = 0.0, np.zeros(model.dim), 0.0, False
        for batch in unpacked(batches):
            rows = read_rows(batch)
            scores, kept = model.forward(w, rows)
            weights = _column(batch, "weight", 1.0)[:, 0]
            values, slope = loss_and_slope(objective, scores + _column(batch, "z", 0.0), _column(batch, "label", 0.0))
            total += float((weights * values).sum())
            weight += float(weights.sum())
            grad += model.backward(w, rows, kept, slope * weights[:, None])
            some = True
        if some:
            cuts = [grad[i : i + SPREAD].tobytes() for i in range(0, max(1, len(grad)), SPREAD)]
            first = [1.0] + [0.0] * (len(cuts) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([total * x for x in first]), pa.array([weight * x for x in first]), pa.array(cuts, pa.binary())], ["part", "loss", "weight", "grad"])

    def add(table):
        import pyarrow as pa

        grad = np.zeros(len(table.column("grad")[0].as_py()) // 8)
        for x in table.column("grad"):
            grad += np.frombuffer(x.as_py())
        return pa.table({"part": table.column("part").slice(0, 1), "loss": [sum(table.column("loss").to_pylist())], "weight": [sum(table.column("weight").to_pylist())], "grad": pa.array([grad.tobytes()], pa.binary())})

    schema = "part int, loss double, weight double, grad binary"
    parts = data.mapInArrow(run, schema)
    tasks = data.rdd.getNumPartitions() if tasks is None else tasks
    if tasks * model.dim * 8 > DIRECT:
        if tasks > FAN:
            parts = parts.groupBy("part", F.floor(F.spark_partition_id() / FAN)).applyInArrow(add, schema)
        parts = parts.groupBy("part").applyInArrow(add, schema)
    grad, loss, weight = np.zeros(model.dim), 0.0, 0.0
    for r in parts.collect():
        x = np.frombuffer(r["grad"])
        grad[r["part"] * SPREAD : r["part"] * SPREAD + len(x)] += x
        loss, weight = loss + r["loss"], weight + r["weight"]
    sent.destroy()
    return loss, grad, weight


@dataclass
class Trained:
    model: Model
    w: np.ndarray
    result: Result
    weight: float
    train_loss: float
    test_loss: float | None = None


def initial(model: Model, mode: str = "zero", seed: int = 1, mean: float = 0.0, std: float = 0.01, low: float = -0.01, high: float = 0.01) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if mode == "normal":
        return rng.normal(mean, std, model.dim)
    return rng.uniform(low, high, model.dim) if mode == "uniform" else np.zeros(model.dim)


def train(data: DataFrame, model: Model, objective: str, settings: Settings = Settings(), l1=(0.0,), l2=(0.0,), w0: np.ndarray | None = None, test: DataFrame | None = None, bias: bool = True, options: dict | None = None, just_evaluate: bool = False, on_iteration=None) -> Trained:
    """Minimises the weighted loss plus W (l2 / 2 |w|^2 + l1 |w|). With test data the best coefficients on it are kept.

    data is packed first, and deleted in that form at the end, unless it and the test data are packed already.
    """
    tables = [(data, packed(data)), *([(test, packed(test))] if test is not None else [])]
    try:
        return _train(tables[0][1], model, objective, settings, l1, l2, w0, tables[1][1] if test is not None else None, bias, options, just_evaluate, on_iteration)
    finally:
        for given, mine in tables:
            if given is not mine:
                remove(mine)


def _train(data, model, objective, settings, l1, l2, w0, test, bias, options, just_evaluate, on_iteration) -> Trained:
    w0 = initial(model, "zero" if isinstance(model, Linear | MulticlassLinear) else "normal") if w0 is None else w0
    weight = data.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    tasks = data.rdd.getNumPartitions()
    f = lambda w: evaluate(data, model, objective, w, options, tasks)[:2]

    def check(w):
        v, _, n = evaluate(test, model, objective, w, options)
        return v / n if n else float("nan")

    def each(i, w, v):
        if on_iteration:
            on_iteration(i, w)
        return check(w) if test is not None else None

    if just_evaluate:
        value = f(w0)[0]
        return Trained(model, w0, Result(w0, value, 0, True, [value]), weight, value / weight, check(w0) if test is not None else None)
    penalty = Penalty(model.penalty_ranges(list(l1), list(l2), bias), weight)
    res = minimise(f, w0, settings, penalty, each if test is not None or on_iteration else None)
    w = res.best if res.best is not None else res.w
    return Trained(model, w, res, weight, f(w)[0] / weight, check(w) if test is not None else None)


def scored(data: DataFrame, model: Model, w: np.ndarray, name: str = "scores") -> DataFrame:
    """Adds an array column with the model's scores."""
    from pyspark.sql import types as T

    sent = data.sparkSession.sparkContext.broadcast(w)
    schema = T.StructType([*data.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = model.forward(sent.value, read_rows(batch))[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(np.ascontiguousarray(s, float).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema.names)

    return data.mapInArrow(run, schema)


def precisions(data: DataFrame, model: Linear, objective: str, w: np.ndarray, l2: float) -> np.ndarray:
    """The diagonal that Thompson sampling uses: sum of w h x^2 + W l2."""
    sent = data.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        import pyarrow as pa

        total, weight = np.zeros(model.n), 0.0
        for batch in batches:
            rows = read_rows(batch)
            s = model.forward(sent.value, rows)[0][:, 0]
            weights = _column(batch, "weight", 1.0)[:, 0]
            total += model.precision(sent.value, rows, weights * loss_of(objective).second(A, s, _column(batch, "label", 0.0)[:, 0]))
            weight += weights.sum()
        yield pa.RecordBatch.from_pydict({"d": [total.tobytes()], "w": [weight]})

    got = data.mapInArrow(run, "d binary, w double").collect()
    return np.sum([np.frombuffer(r["d"]) for r in got], axis=0) + sum(r["w"] for r in got) * l2


def thompson(w: np.ndarray, precision: np.ndarray, alpha: float, seed: int, bias: bool = True) -> np.ndarray:
    """One draw of the coefficients; the bias doesn't move."""
    p = np.maximum(precision, 1e-9)
    if bias:
        p = p.copy()
        p[0] = 1e30
    return w + np.random.default_rng(seed).normal(size=len(w)) * alpha / np.sqrt(p)


@dataclass
class Ensemble:
    """Soft trees: boosted (shrunk, but for the last one) or averaged."""

    trees: list[tuple[Model, np.ndarray]] = field(default_factory=list)
    kind: str = "gradient_boosting"
    learning_rate: float = 1.0
    base_score: float = 0.0

    def score(self, rows: Rows) -> np.ndarray:
        f = [m.forward(w, rows)[0][:, 0] for m, w in self.trees]
        if self.kind == "random_forest":
            return self.base_score + np.mean(f, axis=0) if f else np.full(rows.n, self.base_score)
        return self.base_score + sum((x * (self.learning_rate if i + 1 < len(f) else 1.0) for i, x in enumerate(f)), np.zeros(rows.n))

    def gates(self, rows: Rows) -> np.ndarray:
        """Expert weights of every tree, the leaf prediction of soft trees."""
        return np.stack([m.gates(w, rows) for m, w in self.trees], axis=1)


def train_ensemble(data: DataFrame, kind: str, n: int, objective: str, tree_num: int, settings: Settings = Settings(), learning_rate: float = 0.1, ensemble: str = "gradient_boosting", k: int = 4, l1=(0.0,), l2=(0.0,), instance_rate: float = 1.0, feature_rate: float = 1.0, base_prediction: float = 0.5, seed: int = 1, start: Ensemble | None = None, leaf_range: tuple | None = None, random: dict | None = None, on_tree=None) -> Ensemble:
    """Each tree is fitted on the scores so far, which are saved with the rows once a tree.

    A column ``init`` of ``data`` is added to the base score. leaf_range: range of the scalar leaves' first values;
    random: how other coefficients begin (see ``initial``); on_tree(number, ensemble) may look at it.
    """
    base = float(loss_of(objective).inverse(A, np.float64(base_prediction)))
    out = start or Ensemble(kind=ensemble, learning_rate=1.0 if ensemble == "random_forest" else learning_rate, base_score=base)
    rng = np.random.default_rng(seed)
    if start and ensemble != "random_forest" and start.trees:
        out = Ensemble(list(start.trees), start.kind, start.learning_rate, start.base_score)
    shift = lambda df, m, w: scored(df, m, w, "__f").withColumn("z", F.col("z") + out.learning_rate * F.col("__f")[0]).drop("__f")
    state = data.withColumn("z", F.lit(base) + F.col("init") if "init" in data.columns else F.lit(base)).drop("init")
    if ensemble != "random_forest":
        for m, w in out.trees:
            state = shift(state, m, w)
    state = saved(state, "soft-trees")
    for t in range(len(out.trees), tree_num):
        mask = np.where(rng.random(n) < feature_rate, 1.0, 0.0) if feature_rate < 1 else None
        if mask is not None:
            mask[0] = 1
        model = build(kind, n, k=k, gate_mask=mask)
        part = state
        if instance_rate < 1:
            part = saved(state.filter(F.rand(seed * 1000 + t) < instance_rate).withColumn("weight", F.col("weight") / instance_rate), "soft-sample")
        w0 = initial(model, **{"mode": "normal", "std": 0.1, **(random or {}), "seed": (random or {}).get("seed", 99999) + t * seed})
        if leaf_range and model.scalar:
            w0[:k] = np.random.default_rng(seed + t).uniform(leaf_range[0], leaf_range[1], k)
        got = train(part, model, objective, settings, l1, l2, w0)
        out.trees.append((model, got.w))
        if on_tree:
            on_tree(t + 1, out)
        if ensemble != "random_forest" and t + 1 < tree_num:
            state = saved(shift(state, model, got.w), "soft-trees")
    return out
