"""Objective functions, each written once over an algebra that is either Columns or numpy arrays.

A scalar objective has loss, predict, first and second derivative by score, and the inverse of
predict. Binary labels are 0 or 1. Multiclass ones work on K scores and K label masses.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import lgamma

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ColumnOps:
    """What the formulas need, on Columns; stays inside generated code."""

    exp, log, log1p, abs, sign = staticmethod(F.exp), staticmethod(F.log), staticmethod(F.log1p), staticmethod(F.abs), staticmethod(F.signum)

    @staticmethod
    def where(c, a, b):
        return F.when(c, a).otherwise(b)

    @staticmethod
    def most(a, b):
        return F.greatest(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))

    @staticmethod
    def least(a, b):
        return F.least(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))

    @staticmethod
    def log_factorial(y):
        """ln(y!) of the whole part: a table of 32 values, beyond it Stirling's series (error below 1e-13)."""
        n = F.floor(y).cast("double")
        table = F.array(*[F.lit(lgamma(i + 1)) for i in range(32)])
        x = F.greatest(n + 1, F.lit(2.0))
        series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
        return F.when(n < 32, F.element_at(table, n.cast("int") + 1)).otherwise(series)


class ArrayOps:
    exp, log, log1p, abs, sign, where, most, least = np.exp, np.log, np.log1p, np.abs, np.sign, np.where, np.maximum, np.minimum

    @staticmethod
    def log_factorial(y):
        return np.vectorize(lambda v: lgamma(int(v) + 1), otypes=[float])(y)


def _sigmoid(o, s):
    e = o.exp(-o.abs(s))
    return o.where(s >= 0, 1 / (1 + e), e / (1 + e))


@dataclass(frozen=True)
class Loss:
    """A scalar objective."""

    name: str
    classification: bool = False
    options: dict = field(default_factory=dict)

    def loss(self, o, s, y):
        raise NotImplementedError

    def predict(self, o, s):
        return s

    def first(self, o, s, y):
        raise NotImplementedError

    def second(self, o, s, y):
        return s * 0 + 1.0

    def inverse(self, o, p):
        return p

    def second_for_trees(self, o, s, y):
        """The second derivative that tree growing uses."""
        return self.second(o, s, y)


class Sigmoid(Loss):
    def loss(self, o, s, y):
        return o.log1p(o.exp(-o.abs(s))) + o.most(s, 0.0) - s * y

    def predict(self, o, s):
        return _sigmoid(o, s)

    def first(self, o, s, y):
        return _sigmoid(o, s) - y

    def second(self, o, s, y):
        p = _sigmoid(o, s)
        return p * (1 - p)

    def inverse(self, o, p):
        return -o.log(1 / p - 1)

    def second_for_trees(self, o, s, y):
        """With option zmax, large enough that |g / h| is at most zmax."""
        zmax = self.options.get("zmax", 0.0)
        h = self.second(o, s, y)
        return o.most(h, o.abs(self.first(o, s, y)) / zmax) if zmax else h


class L2(Loss):
    def loss(self, o, s, y):
        return 0.5 * (y - s) * (y - s)

    def first(self, o, s, y):
        return s - y


class L1(Loss):
    def loss(self, o, s, y):
        return o.abs(y - s)

    def first(self, o, s, y):
        return o.sign(s - y)


class Huber(Loss):
    @property
    def delta(self):
        return float(self.options.get("delta", 0.5))

    def loss(self, o, s, y):
        d = o.abs(y - s)
        return o.where(d <= self.delta, 0.5 * d * d, self.delta * (d - 0.5 * self.delta))

    def first(self, o, s, y):
        return o.most(o.least(s - y, self.delta), -self.delta)

    def second(self, o, s, y):
        return s * 0


class _Margin(Loss):
    """Of z = (2y - 1)s; ``of(o, z)`` and its derivatives by z."""

    def loss(self, o, s, y):
        return self.of(o, (2 * y - 1) * s)

    def first(self, o, s, y):
        return (2 * y - 1) * self.slope(o, (2 * y - 1) * s)

    def second(self, o, s, y):
        return s * 0


class Hinge(_Margin):
    def of(self, o, z):
        return o.most(1 - z, 0.0)

    def slope(self, o, z):
        return o.where(z < 1, z * 0 - 1.0, z * 0)


class L2Hinge(_Margin):
    def of(self, o, z):
        return 0.5 * o.most(1 - z, 0.0) * o.most(1 - z, 0.0)

    def slope(self, o, z):
        return o.least(z - 1, 0.0)

    def second(self, o, s, y):
        return s * 0 + 1.0


class SmoothHinge(_Margin):
    def of(self, o, z):
        return o.where(z <= 0, 0.5 - z, o.where(z < 1, 0.5 * (1 - z) * (1 - z), z * 0))

    def slope(self, o, z):
        return o.where(z <= 0, z * 0 - 1.0, o.where(z < 1, z - 1, z * 0))

    def second(self, o, s, y):
        t = 2 * y - 1
        z = t * s
        return o.where((z <= 0) | (z >= 1), z * 0, t * t)


class Exponential(_Margin):
    """The exponent ends at 8."""

    def of(self, o, z):
        return o.exp(o.least(-z, 8.0))

    def slope(self, o, z):
        return -self.of(o, z)

    def second(self, o, s, y):
        return self.of(o, (2 * y - 1) * s)


class Poisson(Loss):
    """The exponent ends at 30."""

    def loss(self, o, s, y):
        return o.exp(o.least(s, 30.0)) - y * s + o.log_factorial(y)

    def predict(self, o, s):
        return o.exp(o.least(s, 30.0))

    def first(self, o, s, y):
        return o.exp(o.least(s, 30.0)) - y

    def second(self, o, s, y):
        return o.exp(o.least(s, 30.0))

    def inverse(self, o, p):
        return o.log(p)


class Mape(Loss):
    def loss(self, o, s, y):
        return o.abs((y - s) / y)

    def first(self, o, s, y):
        return o.sign((s - y) / y) / y


class InvMape(Loss):
    def loss(self, o, s, y):
        return o.abs((y - s) / s)

    def first(self, o, s, y):
        return o.sign((s - y) / s) * y / (s * s)


class Smape(Loss):
    def loss(self, o, s, y):
        return 2 * o.abs(s - y) / (y + o.abs(s))

    def first(self, o, s, y):
        d = (y + o.abs(s)) / 2
        return (o.sign(s - y) * d - 0.5 * o.sign(s) * o.abs(s - y)) / (d * d)


_SCALAR = {"sigmoid": (Sigmoid, True), "sigmoid_cross_entropy": (Sigmoid, True), "l2": (L2, False), "l1": (L1, False), "huber": (Huber, False), "hinge": (Hinge, True), "l2_hinge": (L2Hinge, True), "smooth_hinge": (SmoothHinge, True), "exponential": (Exponential, True), "poisson": (Poisson, False), "mape": (Mape, False), "inv_mape": (InvMape, False), "smape": (Smape, False)}
SCALAR_NAMES = tuple(_SCALAR)


class ColumnVector:
    """K Columns taken from an array column, as the multiclass formulas see them."""

    def __init__(self, columns):
        self.columns = list(columns)


@dataclass(frozen=True)
class MultiLoss:
    """A multiclass objective on lists of K scores and label masses (Columns or arrays)."""

    name: str

    def loss(self, o, s, y):
        raise NotImplementedError

    def predict(self, o, s):
        return list(s)

    def first(self, o, s, y):
        raise NotImplementedError

    def second(self, o, s, y):
        return [x * 0 + 1.0 for x in s]

    def inverse(self, o, p):
        return list(p)


def _maximum(o, xs):
    out = xs[0]
    for x in xs[1:]:
        out = o.most(out, x)
    return out


class Softmax(MultiLoss):
    def loss(self, o, s, y):
        top = _maximum(o, s)
        return o.log(sum(o.exp(x - top) for x in s)) + top - sum(a * b for a, b in zip(s, y, strict=True))

    def predict(self, o, s):
        top = _maximum(o, s)
        e = [o.exp(x - top) for x in s]
        total = sum(e)
        return [x / total for x in e]

    def first(self, o, s, y):
        return [p - t for p, t in zip(self.predict(o, s), y, strict=True)]

    def second(self, o, s, y):
        """Twice the diagonal: the usual bound for one-vs-rest tree steps."""
        return [2 * p * (1 - p) for p in self.predict(o, s)]

    def inverse(self, o, p):
        return [o.log(x) for x in p]


class HSoftmax(MultiLoss):
    """A complete binary tree in heap order: even nodes are left and get the logistic of their parent's score.

    The last of the K scores is not used.
    """

    def _masses(self, y):
        k = len(y)
        heap = [None] * k + list(y)
        for i in range(k - 1, 0, -1):
            heap[i] = heap[2 * i] + heap[2 * i + 1]
        return heap

    def loss(self, o, s, y):
        heap = self._masses(y)
        return sum(heap[i] * (o.log1p(o.exp(-o.abs(s[i - 1]))) + o.most(s[i - 1], 0.0)) - heap[2 * i] * s[i - 1] for i in range(1, len(y)))

    def predict(self, o, s):
        k = len(s)
        out = []
        for leaf in range(k, 2 * k):
            p, node = None, leaf
            while node > 1:
                g = _sigmoid(o, s[node // 2 - 1])
                step = g if node % 2 == 0 else 1 - g
                p, node = step if p is None else p * step, node // 2
            out.append(p if p is not None else s[0] * 0 + 1.0)
        return out

    def first(self, o, s, y):
        heap = self._masses(y)
        return [_sigmoid(o, s[i - 1]) * heap[i] - heap[2 * i] for i in range(1, len(y))] + [s[-1] * 0]

    def second(self, o, s, y):
        heap = self._masses(y)
        return [_sigmoid(o, s[i - 1]) * (1 - _sigmoid(o, s[i - 1])) * heap[i] for i in range(1, len(y))] + [s[-1] * 0]


class _MultiMargin(MultiLoss):
    """Sums over classes of a function of score minus the true class's score."""

    def _truth(self, o, s, y):
        return sum(o.where(t == 1, x, x * 0) for x, t in zip(s, y, strict=True))

    def loss(self, o, s, y):
        truth = self._truth(o, s, y)
        return sum(self.of(o, x - truth) for x in s) - self.of0

    def first(self, o, s, y):
        truth = self._truth(o, s, y)
        slopes = [o.where(t == 1, x * 0, self.slope(o, x - truth)) for x, t in zip(s, y, strict=True)]
        total = sum(slopes)
        return [o.where(t == 1, -total, g) for g, t in zip(slopes, y, strict=True)]


class MultiHinge(_MultiMargin):
    of0 = 1.0

    def of(self, o, d):
        return o.most(d + 1, 0.0)

    def slope(self, o, d):
        return o.where(d > -1, d * 0 + 1.0, d * 0)


class MultiL2Hinge(_MultiMargin):
    of0 = 0.5

    def of(self, o, d):
        return 0.5 * o.most(d + 1, 0.0) * o.most(d + 1, 0.0)

    def slope(self, o, d):
        return o.most(d + 1, 0.0)


class MultiSmoothHinge(_MultiMargin):
    of0 = 0.5

    def of(self, o, d):
        return o.where(d >= 0, d + 0.5, o.where(d > -1, 0.5 * (d + 1) * (d + 1), d * 0))

    def slope(self, o, d):
        return o.where(d >= 0, d * 0 + 1.0, o.most(d + 1, 0.0))


_MULTI = {"softmax": Softmax, "softmax_cross_entropy": Softmax, "hsoftmax": HSoftmax, "hsoftmax_cross_entropy": HSoftmax, "multiclass_hinge": MultiHinge, "multiclass_l2_hinge": MultiL2Hinge, "multiclass_smooth_hinge": MultiSmoothHinge}
MULTI_NAMES = tuple(_MULTI)


def loss(name: str, **options) -> Loss | MultiLoss:
    """By name; ``huber@0.3`` sets delta. Registered kinds can be added to with ``register``."""
    base, _, arg = name.lower().partition("@")
    if base in _MULTI:
        return _MULTI[base](base)
    if base not in _SCALAR:
        raise ValueError(f"unknown objective {name!r}")
    kind, classification = _SCALAR[base]
    if arg:
        options["delta"] = float(arg)
    return kind(base, classification, options)


def register(name: str, kind: type, classification: bool = False) -> None:
    """Adds an objective under a new name."""
    if issubclass(kind, MultiLoss):
        _MULTI[name] = kind
    else:
        _SCALAR[name] = (kind, classification)


def pure_classification(name: str) -> bool:
    """Whether class counts, label sampling and the confusion matrix make sense."""
    base = name.lower().partition("@")[0]
    return base in _MULTI or _SCALAR.get(base, (None, False))[1]


C, A = ColumnOps, ArrayOps


def columns(array: Column, k: int) -> list[Column]:
    return [array[i] for i in range(k)]
