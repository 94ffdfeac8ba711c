"""Weighted quantiles: exact as a window over values, or a mergeable summary with a rank error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_quantiles(df: DataFrame, keys: list[str], value: Column, weight: Column, q: float | Column = 0.5) -> DataFrame:
    """keys and quantile: of each group the first value at which the cumulative weight reaches q times the whole.

    Weights are summed by value before the window, so a group's sort holds its distinct values only.
    """
    per = df.select(*keys, value.alias("v"), weight.alias("w")).filter("v IS NOT NULL AND NOT isnan(v)").groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    over = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    goal = q if isinstance(q, Column) else F.lit(float(q))
    ranked = per.withColumn("cum", F.sum("w").over(over)).withColumn("total", F.sum("w").over(whole))
    return ranked.filter(F.col("cum") >= goal * F.col("total")).groupBy(*keys).agg(F.min("v").alias("quantile"))


class Summary:
    """Weighted values with lower and upper ranks; merging adds errors, pruning to b entries adds total / b."""

    def __init__(self, values=(), weights=None, entries: int = 1000):
        v = np.asarray(values, float)
        w = np.ones(len(v)) if weights is None else np.asarray(weights, float)
        keep = ~np.isnan(v)
        self.v, at = np.unique(v[keep], return_inverse=True)
        self.w = np.bincount(at, w[keep], len(self.v)) if len(self.v) else np.zeros(0)
        self.hi = np.cumsum(self.w)
        self.lo = self.hi - self.w
        self.entries = entries
        self._prune()

    @property
    def total(self) -> float:
        return float(self.hi[-1]) if len(self.hi) else 0.0

    def _prune(self) -> None:
        if len(self.v) > 2 * self.entries:
            at = np.unique(np.concatenate([[0], np.searchsorted(self.hi, np.linspace(0, self.total, self.entries + 1)[1:-1]), [len(self.v) - 1]]))
            self.v, self.w, self.lo, self.hi = (x[at] for x in (self.v, self.w, self.lo, self.hi))

    def merge(self, other: Summary) -> Summary:
        if not len(self.v) or not len(other.v):
            return self if len(self.v) else other
        out = Summary(entries=self.entries)
        v = np.union1d(self.v, other.v)
        lo, hi, w = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
        for s in (self, other):
            # a value that a summary lacks lies between its neighbours' bounds
            right = np.searchsorted(s.v, v, "right")
            left = np.searchsorted(s.v, v, "left")
            has = right > left
            at = np.minimum(left, len(s.v) - 1)
            lo += np.where(has, s.lo[at], np.where(left > 0, (s.lo + s.w)[np.maximum(left - 1, 0)], 0))
            hi += np.where(has, s.hi[at], np.where(left < len(s.v), (s.hi - s.w)[at], s.total))
            w += np.where(has, s.w[at], 0)
        out.v, out.w, out.lo, out.hi = v, w, lo, hi
        out._prune()
        return out

    def query(self, q: float) -> float:
        """A value whose rank is within the error of q times the total."""
        return float(self.v[np.argmin(np.abs((self.lo + self.hi) / 2 - q * self.total))])

    def to_bytes(self) -> bytes:
        return np.stack([self.v, self.w, self.lo, self.hi]).astype("<f8").tobytes()

    @staticmethod
    def from_bytes(data: bytes, entries: int) -> Summary:
        out = Summary(entries=entries)
        out.v, out.w, out.lo, out.hi = np.frombuffer(data, "<f8").reshape(4, -1)
        return out


#: Entries that summaries in the making have for each one asked for: their errors add up over the levels of merging.
FINE = 8


class Pile:
    """A summary of many pieces: raw values are gathered into summaries, and only those of as many pieces are merged.

    N pieces are pruned log2(N) times at FINE * entries entries, so the error of a rank is at most
    (log2(N) + 2) / (2 * FINE * entries) of the total, under 1 / entries for up to 2**14 pieces of 2 * FINE * entries values.
    """

    def __init__(self, entries: int):
        self.entries = FINE * entries
        self.raw, self.held, self.levels = [], 0, {}

    def add(self, values, weights=None) -> None:
        v = np.asarray(values, float)
        self.raw.append((v, np.ones(len(v)) if weights is None else np.asarray(weights, float)))
        self.held += len(v)
        if self.held >= 2 * self.entries:
            self._flush()

    def _flush(self) -> None:
        if self.raw:
            v, w = (np.concatenate(x) for x in zip(*self.raw, strict=True))
            self.raw, self.held = [], 0
            self.push(Summary(v, w, self.entries))

    def push(self, s: Summary, level: int = 0) -> None:
        while level in self.levels:
            s, level = self.levels.pop(level).merge(s), level + 1
        self.levels[level] = s

    def whole(self) -> Summary:
        self._flush()
        out = Summary(entries=self.entries)
        for level in sorted(self.levels):
            out = out.merge(self.levels[level])
        return out


def summaries(df: DataFrame, key: str, value: str, weight: str | None = None, entries: int = 1000) -> DataFrame:
    """key, summary (binary): built in each task, merged by key, 64 tasks at a time first. See Pile for the error."""

    def build(batches):
        import pandas as pd

        got: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby(key):
                got.setdefault(k, Pile(entries)).add(part[value], part[weight] if weight else None)
        if got:  # of a task without rows, pandas would make columns of numbers
            yield pd.DataFrame({key: list(got), "summary": [p.whole().to_bytes() for p in got.values()]})

    def fold(pdf):
        import pandas as pd

        p = Pile(entries)
        for b in pdf["summary"]:
            p.push(Summary.from_bytes(b, p.entries))
        return pd.DataFrame({key: pdf[key].iloc[:1], "summary": [p.whole().to_bytes()]})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, summary binary"
    rows = df.select(key, value, *([weight] if weight else []))
    parts = rows.mapInPandas(build, schema)
    if rows.rdd.getNumPartitions() > 64:
        parts = parts.groupBy(key, F.floor(F.spark_partition_id() / 64)).applyInPandas(fold, schema)
    return parts.groupBy(key).applyInPandas(fold, schema)
