"""Quasi-Newton minimisation on the driver; every evaluation of the function is one distributed aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np


@dataclass
class Settings:
    memory: int = 8
    max_iter: int = 50
    eps: float = 1e-3
    line_search: str = "wolfe"
    step_decr: float = 0.5
    step_incr: float = 2.1
    max_line_steps: int = 55
    min_step: float = 1e-16
    max_step: float = 1e18
    c1: float = 1e-4
    c2: float = 0.9


@dataclass
class Penalty:
    """l1 and l2 of coefficient ranges, times the sum of sample weights."""

    ranges: list[tuple[int, int, float, float]] = field(default_factory=list)
    weight: float = 1.0

    def vectors(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        l1, l2 = np.zeros(dim), np.zeros(dim)
        for a, z, one, two in self.ranges:
            l1[a:z], l2[a:z] = one * self.weight, two * self.weight
        return l1, l2


def pseudo_gradient(w: np.ndarray, g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The steepest one-sided derivative of f + l1 |w|."""
    up, down = g + l1, g - l1
    at_zero = np.where(up < 0, up, np.where(down > 0, down, 0.0))
    return np.where(l1 == 0, g, np.where(w > 0, up, np.where(w < 0, down, at_zero)))


@dataclass
class Result:
    w: np.ndarray
    value: float
    iterations: int
    converged: bool
    history: list[float]
    best: np.ndarray | None = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def two_loop(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian's estimate times g."""
    q, alphas = g.copy(), []
    for s, y in reversed(pairs):
        a = s @ q / (s @ y)
        alphas.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(alphas), strict=True):
        q += (a - y @ q / (s @ y)) * s
    return q


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w0: np.ndarray, settings: Settings = Settings(), penalty: Penalty | None = None, on_iteration: Callable[[int, np.ndarray, float], float | None] | None = None) -> Result:
    """L-BFGS, with l1 OWL-QN. on_iteration may return a test loss; ``best`` is the w of the least one."""
    s_ = settings
    w = np.asarray(w0, float).copy()
    l1, l2 = penalty.vectors(len(w)) if penalty else (np.zeros(len(w)), np.zeros(len(w)))
    owl = bool(l1.any())

    def full(x):
        v, g = f(x)
        return v + 0.5 * (l2 * x * x).sum() + (l1 * np.abs(x)).sum(), g + l2 * x

    value, g = full(w)
    history, pairs = [value], []
    best, best_test, converged, it = None, np.inf, False, 0
    for it in range(1, s_.max_iter + 1):
        pg = pseudo_gradient(w, g, l1)
        if np.linalg.norm(pg) / max(1.0, np.linalg.norm(w)) <= s_.eps:
            converged = True
            break
        p = -two_loop(pg, pairs)
        if owl:
            p[p * pg >= 0] = 0
        slope = pg @ p
        if slope >= 0:
            pairs, p = [], -pg
            slope = pg @ p
        step = 1 / np.linalg.norm(pg) if not pairs else 1.0
        orthant = np.where(w != 0, np.sign(w), -np.sign(pg))
        low, ok = None, False
        for _ in range(s_.max_line_steps):
            x = w + step * p
            if owl:
                x = np.where((l1 > 0) & (x * orthant <= 0), 0.0, x)
            v, gx = full(x)
            descent = pg @ (x - w) if owl else step * slope
            if not np.isfinite(v) or v > value + s_.c1 * descent:
                step *= s_.step_decr
            elif owl or s_.line_search == "sufficient_decrease":
                ok = True
            else:
                after = gx @ p
                if after < s_.c2 * slope:
                    low = (x, v, gx)
                    step *= s_.step_incr
                elif s_.line_search == "strong_wolfe" and after > -s_.c2 * slope:
                    low = (x, v, gx)
                    step *= s_.step_decr
                else:
                    ok = True
            if ok or not s_.min_step < step < s_.max_step:
                break
        if not ok:
            if low is None:
                break
            x, v, gx = low
        s, y = x - w, gx - g
        if s @ y > 1e-60:
            pairs = [*pairs, (s, y)][-s_.memory :]
        w, value, g = x, v, gx
        history.append(value)
        test = on_iteration(it, w, value) if on_iteration else None
        if test is not None and test < best_test:
            best, best_test = w.copy(), test
    return Result(w, value, it, converged, history, best, pairs)


def grid(l1: tuple[float, float, int], l2: tuple[float, float, int]) -> list[tuple[float, float]]:
    """All (l1, l2) of start + i * (end - start) / parts; equal points once."""
    points = lambda a, b, n: sorted({a + i * (b - a) / n for i in range(n + 1)}) if n else [a]
    return list(product(points(*l1), points(*l2)))


def grid_search(fit: Callable[[float, float], tuple[float, object]], l1, l2) -> tuple[tuple[float, float], object, dict]:
    """The point of least test loss; fit gives (test loss, model)."""
    tried = {p: fit(*p) for p in grid(l1, l2)}
    best = min(tried, key=lambda p: tried[p][0])
    return best, tried[best][1], {p: t[0] for p, t in tried.items()}


def hoag(fit: Callable[[float], tuple[Result, float, np.ndarray]], lam: float, weight: float, mask: np.ndarray, step: float = 1.0, decr: float = 0.7, limit: float = 1e-5, outer_iter: int = 10) -> tuple[float, list[tuple[float, float]]]:
    """Searches l2 by the sign of the test loss's derivative: log l2 moves by ``step``, which shrinks at each turn.

    fit(l2) gives (result, test loss, test gradient). The derivative is -l2 * W * w . (H^-1 test gradient),
    H^-1 by the result's last pairs.
    """
    tried, last_sign = [], 0.0
    for _ in range(outer_iter):
        res, test, g = fit(lam)
        tried.append((lam, test))
        if len(tried) > 3 and np.mean([abs(tried[-i][1] - tried[-i - 1][1]) for i in (1, 2, 3)]) < limit:
            break
        sign = np.sign(-lam * weight * ((res.w * mask) @ two_loop(g, res.pairs)))
        if last_sign and sign != last_sign:
            step *= decr
        last_sign = sign
        lam = float(np.exp(np.log(lam) - sign * step))
    return min(tried, key=lambda t: t[1])[0], tried
