"""Text forms of models and their side files: plain lines, read and written on the driver or as DataFrames."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.features import BIAS
from ..operators.gbdt import Forest, Node, Tree


def write_lines(spark: SparkSession, lines, path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> list[str]:
    """Lines of a model: its size is that of the coefficients, which the driver holds anyway."""
    return [r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(path).collect()]


def linear_lines(names: list[str], w: np.ndarray, precision: np.ndarray | None = None, delim: str = ",") -> list[str]:
    """name,weight,precision; zero weights are left out; the bias has no precision."""
    return [delim.join((n, repr(float(v)), "null" if n == BIAS or precision is None else repr(float(precision[i])))) for i, (n, v) in enumerate(zip(names, w, strict=True)) if v != 0]


def read_linear(lines: list[str], delim: str = ",") -> dict[str, tuple[float, float | None]]:
    out = {}
    for x in filter(str.strip, lines):
        name, w, *rest = x.strip().split(delim)
        out[name] = (float(w), None if not rest or rest[0] == "null" else float(rest[0]))
    return out


def vector_lines(names: list[str], rows: np.ndarray, delim: str = ",") -> list[str]:
    """name,v0,v1,...: multiclass (K - 1 weights), FM (weight, latent) and FFM (weight, latent by field) models."""
    return [delim.join((n, *(repr(float(v)) for v in r))) for n, r in zip(names, rows, strict=True)]


def read_vectors(lines: list[str], delim: str = ",") -> dict[str, np.ndarray]:
    return {x.split(delim)[0]: np.array(x.strip().split(delim)[1:], float) for x in lines if x.strip()}


def fm_rows(w: np.ndarray, n: int) -> np.ndarray:
    """First-order weight and latent ones side by side, of FM and FFM coefficients."""
    return np.concatenate([w[:n, None], w[n:].reshape(n, -1)], axis=1)


def fm_vector(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows[:, 0], rows[:, 1:].ravel()])


def soft_tree_lines(names: list[str], w: np.ndarray, k: int, scalar: bool, delim: str = ",") -> list[str]:
    """``k:K``, for scalar experts a line of leaves, then name and coefficients of each feature."""
    out = [f"k:{k}"]
    if scalar:
        out.append(delim.join(repr(float(v)) for v in w[:k]))
        w = w[k:]
    return out + vector_lines(names, w.reshape(len(names), -1), delim)


def read_soft_tree(lines: list[str], names: list[str], scalar: bool, delim: str = ",") -> tuple[int, np.ndarray]:
    lines = [x for x in lines if x.strip()]
    k = int(lines[0].split(":")[1])
    head = np.array(lines[1].split(delim), float) if scalar else np.zeros(0)
    got = read_vectors(lines[1 + scalar :], delim)
    width = k - 1 if scalar else 2 * k - 1
    return k, np.concatenate([head, np.concatenate([got.get(n, np.zeros(width)) for n in names])])


def tree_info_lines(k: int, tree_num: int, finished: int, base: float) -> list[str]:
    return [f"K:{k}", f"tree_num:{tree_num}", f"finished_tree_num:{finished}", f"uniform_base_prediction:{base}"]


def forest_lines(f: Forest) -> list[str]:
    out = [f"uniform_base_prediction={f.base_prediction}", f"class_num={f.groups}", f"loss_function={f.objective}", f"tree_num={len(f.trees)}"]
    for i, t in enumerate(f.trees):
        out.append(f"booster[{i + 1}] depth={t.depth},node_num={len(t.nodes)},leaf_cnt={t.leaves}")

        def walk(j: int, depth: int, t=t) -> None:
            n = t.nodes[j]
            tail = f"hess_sum={n.hess},sample_cnt={n.count}"
            if n.leaf:
                out.append("\t" * depth + f"{j}:leaf={n.value!r},{tail}")
            else:
                out.append("\t" * depth + f"{j}:[{f.features[n.feature]}<={n.threshold!r}] yes={n.left},no={n.right},missing={n.left if n.default_left else n.right},gain={n.gain!r},{tail}")
                walk(n.left, depth + 1)
                walk(n.right, depth + 1)

        if t.nodes:
            walk(0, 0)
    return out


_SPLIT = re.compile(r"(\d+):\[(.*)<=([^\]]+)\] yes=(\d+),no=(\d+),missing=(\d+),gain=([^,]+),hess_sum=([^,]+),sample_cnt=(\S+)")
_LEAF = re.compile(r"(\d+):leaf=([^,]+),hess_sum=([^,]+),sample_cnt=(\S+)")


def read_forest(lines: list[str], averaged: bool = False) -> Forest:
    head = dict(x.strip().split("=", 1) for x in lines[:4])
    f = Forest([], [], head["loss_function"], int(head["class_num"]), float(head["uniform_base_prediction"]), averaged)
    at: dict[str, int] = {}
    for x in lines[4:]:
        x, depth = x.strip(), len(x) - len(x.lstrip("\t"))
        if x.startswith("booster["):
            f.trees.append(Tree([Node() for _ in range(int(re.search(r"node_num=(\d+)", x)[1]))]))
        elif m := _SPLIT.match(x):
            name = m[2]
            if name not in at:
                at[name] = len(f.features)
                f.features.append(name)
            n = f.trees[-1].nodes[int(m[1])]
            n.feature, n.threshold, n.left, n.right, n.gain, n.hess, n.count, n.depth = at[name], float(m[3]), int(m[4]), int(m[5]), float(m[7]), float(m[8]), int(float(m[9])), depth
            n.default_left = m[6] == m[4]
        elif m := _LEAF.match(x):
            n = f.trees[-1].nodes[int(m[1])]
            n.value, n.hess, n.count, n.depth = float(m[2]), float(m[3]), int(float(m[4])), depth
    return f


def importance_lines(f: Forest) -> list[str]:
    return ["feature_name\tsum_split_count\tsum_gain", *(f"{n}\t{c}\t{g}" for n, c, g in f.importance())]


def stats_lines(stats: list, mode: str, range_min: float = -1.0, range_max: float = 1.0) -> list[str]:
    return [f"{r['feature']}###mode={mode}, mean={r['mean']}, stdvar={r['std']}, max={r['max']}, min={r['min']}, rangeMax={range_max}, rangeMin={range_min}" for r in stats]


def read_stats(lines: list[str]) -> dict[str, dict]:
    out = {}
    for x in filter(str.strip, lines):
        name, _, rest = x.partition("###")
        out[name] = {k.strip(): (v if k.strip() == "mode" else float(v)) for k, v in (p.split("=") for p in rest.split(","))}
    return out


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """feature: one name a line, recursively."""
    from pyspark.sql import functions as F

    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("feature")).filter("feature <> ''").distinct()
