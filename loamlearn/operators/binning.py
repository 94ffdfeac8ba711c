"""Candidate split values (bins) of features, and values to bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantile import Summary, summaries
from ..plans.session import sendable


def no_sample(ex: DataFrame) -> DataFrame:
    """feature, value: every distinct value."""
    return ex.filter("value IS NOT NULL AND NOT isnan(value)").select("feature", "value").distinct()


def by_precision(ex: DataFrame, digits: int, use_log: bool = False, use_min_max: bool = False) -> DataFrame:
    """Distinct values cut to ``digits`` decimals, after log(1 + x - min(min, 0)) and scaling to [0, 1] if asked; scaled back."""
    v = F.col("value")
    ok = ex.filter("value IS NOT NULL AND NOT isnan(value)")
    ends = ok.groupBy("feature").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    got = ok.select("feature", "value").distinct().join(sendable(ends, "ends"), "feature")
    shift = F.least("lo", F.lit(0.0))
    there = (lambda c: F.log(1 + c - shift)) if use_log else (lambda c: c)
    back = (lambda c: F.exp(c) - 1 + shift) if use_log else (lambda c: c)
    lo, width = there(F.col("lo")), there(F.col("hi")) - there(F.col("lo"))
    x = there(v)
    if use_min_max:
        x = F.when(width == 0, F.lit(0.0)).otherwise((x - lo) / width)
    base = float(10**digits)
    cut = F.when(x >= 0, F.floor(x * base)).otherwise(F.ceil(x * base)) / base
    y = cut * width + lo if use_min_max else cut
    return got.select("feature", back(y).alias("value")).distinct()


def by_quantile(ex: DataFrame, max_cnt: int, alpha: float = 1.0, use_weight: bool = False, factor: int = 8, exact: bool = False) -> DataFrame:
    """At most about max_cnt values at equal steps of rank; values weigh count**alpha, or sums of weight**alpha.

    Features with no more distinct values keep all. Others use a mergeable summary of factor * max_cnt
    entries, or with ``exact`` a window over the distinct values.
    """
    ok = ex.filter("value IS NOT NULL AND NOT isnan(value)")
    mass = F.sum(F.pow("weight", F.lit(alpha))) if use_weight else F.pow(F.count(F.lit(1)), F.lit(alpha))
    per = ok.groupBy("feature", "value").agg(mass.alias("w"))
    n = sendable(per.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "counts")
    few = per.join(n.filter(F.col("n") <= max_cnt), "feature").select("feature", "value")
    many = per.join(n.filter(F.col("n") > max_cnt), "feature")
    if exact:
        over = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = many.withColumn("cum", F.sum("w").over(over)).withColumn("total", F.sum("w").over(Window.partitionBy("feature")))
        step = F.ceil(F.col("cum") / F.col("total") * max_cnt - 1e-9)
        return few.unionByName(ranked.groupBy("feature", step.alias("step")).agg(F.max("value").alias("value")).select("feature", "value"))

    def query(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(f, v) for f, b in zip(pdf["feature"], pdf["summary"], strict=True) for s in [Summary.from_bytes(b, factor * max_cnt)] for v in sorted({s.query(i / max_cnt) for i in range(1, max_cnt + 1)})]
            yield pd.DataFrame(rows, columns=["feature", "value"])

    return few.unionByName(summaries(many, "feature", "value", "w", factor * max_cnt).mapInPandas(query, "feature string, value double"))


def by_count(ex: DataFrame, max_cnt: int, seed: int = 7) -> DataFrame:
    """The distinct values of max_cnt rows a feature, drawn without replacement by seeded random numbers; which rows
    these are changes with the partitioning."""
    ok = ex.filter("value IS NOT NULL AND NOT isnan(value)")
    n = sendable(ok.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "counts")
    # a first cut leaves a few times as many as needed, so that the sort is small
    drawn = ok.withColumn("r", F.rand(seed)).join(n, "feature").filter(F.col("r") * F.col("n") < 2 * max_cnt + 50)
    top = drawn.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("r"))).filter(F.col("k") <= max_cnt)
    return top.select("feature", "value").distinct()


def by_rate(ex: DataFrame, rate: float, min_cnt: int, seed: int = 7) -> DataFrame:
    """Distinct values of a Bernoulli sample; features with up to min_cnt distinct values keep all.

    A value of n rows is in such a sample with the chance 1 - (1 - rate)**n, so values are drawn, once each, by a keyed
    digest: the result doesn't depend on the partitioning.
    """
    values = ex.filter("value IS NOT NULL AND NOT isnan(value)").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))
    n = sendable(values.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "counts")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "feature", F.col("value").cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    return values.join(n, "feature").filter((F.col("n") <= min_cnt) | (u < 1 - F.pow(F.lit(1.0 - rate), F.col("rows")))).select("feature", "value")


def candidates(ex: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """feature, value by rules: {cols: [...] or "default", type: ..., options}; unnamed features take the default, else no_sample."""
    kinds = {"no_sample": lambda d, **_: no_sample(d), "sample_by_quantile": lambda d, max_cnt, alpha=1.0, use_sample_weight=False, quantile_approximate_bin_factor=8, **_: by_quantile(d, max_cnt, alpha, use_sample_weight, quantile_approximate_bin_factor), "sample_by_cnt": lambda d, max_cnt, **_: by_count(d, max_cnt), "sample_by_rate": lambda d, sample_rate, min_cnt=0, **_: by_rate(d, sample_rate, min_cnt), "sample_by_precision": lambda d, dot_precision, use_log=False, use_min_max=False, **_: by_precision(d, dot_precision, use_log, use_min_max)}
    rules = [dict(r) for r in rules or []]
    named = [c for r in rules if r["cols"] != "default" for c in r["cols"]]
    if len(named) != len(set(named)):
        raise ValueError("a column has two rules")
    if not any(r["cols"] == "default" for r in rules):
        rules.append({"cols": "default", "type": "no_sample"})
    out = None
    for r in rules:
        cols, kind = r.pop("cols"), r.pop("type")
        mine = ex.filter(~F.col("feature").isin(*named) if named else F.lit(True)) if cols == "default" else ex.filter(F.col("feature").isin(*cols))
        got = kinds[kind](mine, **r)
        out = got if out is None else out.unionByName(got)
    return out


def bin_edges(values: np.ndarray) -> np.ndarray:
    """Midpoints between sorted bin values: a value belongs to the nearest bin, at a midpoint to the upper one."""
    v = np.sort(np.asarray(values, float))
    return (v[1:] + v[:-1]) / 2


def assign(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, "right")


def assigned(value: Column, edges: np.ndarray) -> Column:
    """Bin of a Column for known edges: a balanced tree of comparisons, inside generated code."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < float(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(edges))


def split_value(values: np.ndarray, left: int, right: int, kind: str = "mean") -> float:
    """The threshold between bins left and right: their midpoint, or the value of the middle bin between them."""
    if kind == "mean":
        return float((values[left] + values[right]) / 2)
    if kind == "median":
        span = left + right
        return float(values[span // 2]) if span % 2 == 0 else float((values[span // 2] + values[span // 2 + 1]) / 2)
    raise ValueError(f"unknown split type {kind!r}")
