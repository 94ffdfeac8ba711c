"""Batch and single-row scoring, save modes, leaf ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.losses import A, MultiLoss, loss as loss_of
from ..plans.session import sendable
from .continuous import Ensemble, Model, Rows
from .features import BIAS
from .gbdt import Forest

RESULT_ONLY, LABEL_AND_PREDICT, AS_FEATURE = "PREDICT_RESULT_ONLY", "LABEL_AND_PREDICT", "PREDICT_AS_FEATURE"


def _activated(objective: str, scores: np.ndarray) -> np.ndarray:
    o = loss_of(objective)
    if isinstance(o, MultiLoss):
        return np.stack(o.predict(A, [scores[:, j] for j in range(scores.shape[1])]), axis=1)
    return np.asarray(o.predict(A, scores[:, 0]))[:, None]


#: Number of rows, then row, place and value of each known feature in them.
Entries = tuple[int, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class FieldOf:
    """The field of an FFM feature: the place of what stands before the delimiter, the bias's field being 0."""

    names: list[str]
    delim: str = "@"

    def __call__(self, name: str) -> int:
        return 0 if name == BIAS else self.names.index(name.split(self.delim)[0]) + 1


@dataclass
class Predictor:
    """One interface over models: score, predict, loss and leaf of feature maps, in batches or one by one.

    index: feature name to position, of continuous models; unknown features are skipped. field_of
    gives an FFM feature's field. transform changes (name, value) as the training data was changed.
    """

    model: Model | Ensemble | Forest
    objective: str
    w: np.ndarray | None = None
    index: dict[str, int] | None = None
    field_of: Callable[[str], int] | None = None
    bias: bool = True
    transform: Callable[[str, float], float] | None = None

    def _places(self) -> dict[str, int]:
        """The column or coefficient of every known feature."""
        return {f: i for i, f in enumerate(self.model.features)} if isinstance(self.model, Forest) else self.index

    def _of_maps(self, maps: list[dict]) -> Entries:
        known = self._places()
        got = [(i, known[k], v, k) for i, m in enumerate(maps) for k, v in m.items() if k in known]
        return self._entries(len(maps), *(np.array([g[j] for g in got], t) for j, t in ((0, np.int64), (1, np.int64), (2, float))), [g[3] for g in got])

    def _of_arrow(self, column, known) -> Entries:
        """The known features of a column of maps. known: their names and places, in one order."""
        import pyarrow.compute as pc

        names, places = known
        offsets = column.offsets.to_numpy()
        part = slice(int(offsets[0]), int(offsets[-1])) if len(offsets) else slice(0, 0)
        keys, values = column.keys[part], column.items[part]
        at = pc.index_in(keys, names)
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        ok = np.asarray(at.is_valid()) & np.asarray(values.is_valid())
        where = np.flatnonzero(ok)
        value = values.cast("double").to_numpy(zero_copy_only=False)[where]
        at = at.fill_null(0).to_numpy(zero_copy_only=False)[where]
        return self._entries(len(column), row[where], places[at], value, [names[int(i)].as_py() for i in at] if self.transform else None)

    def _entries(self, n: int, row: np.ndarray, at: np.ndarray, value: np.ndarray, names) -> Entries:
        if self.transform:
            value = np.array([self.transform(k, v) for k, v in zip(names, value, strict=True)], float)
        return n, row, at, value

    def _rows(self, e: Entries) -> Rows:
        n, row, idx, val = e
        if self.bias:
            row, idx, val = np.concatenate([row, np.arange(n)]), np.concatenate([idx, np.zeros(n, np.int64)]), np.concatenate([val, np.ones(n)])
        fld = None
        if self.field_of:
            of = np.zeros(max(self.index.values(), default=0) + 1, np.int64)
            for k, j in self.index.items():
                of[j] = self.field_of(k)
            fld = of[idx]
        return Rows(n, row, idx, val, fld)

    def _dense(self, e: Entries) -> np.ndarray:
        n, row, at, value = e
        out = np.full((n, len(self.model.features)), np.nan)
        out[row, at] = value
        return out

    def _scores(self, e: Entries) -> np.ndarray:
        if isinstance(self.model, Forest):
            return self.model.score(self._dense(e))
        if isinstance(self.model, Ensemble):
            return self.model.score(self._rows(e))[:, None]
        return self.model.forward(self.w, self._rows(e))[0]

    def _leaves(self, e: Entries) -> np.ndarray:
        if isinstance(self.model, Forest):
            return self.model.leaf_ids(self._dense(e)).astype(float)
        if isinstance(self.model, Ensemble):
            return self.model.gates(self._rows(e)).reshape(e[0], -1)
        raise ValueError("only trees have leaves")

    def scores(self, maps: list[dict]) -> np.ndarray:
        return self._scores(self._of_maps(maps))

    def predicts(self, maps: list[dict]) -> np.ndarray:
        return _activated(self.objective, self.scores(maps))

    def predict(self, features: dict) -> list[float]:
        return self.predicts([features])[0].tolist()

    def score(self, features: dict) -> list[float]:
        return self.scores([features])[0].tolist()

    def loss(self, features: dict, label: list[float]) -> float:
        s, o = self.scores([features]), loss_of(self.objective)
        y = np.array(label, float)
        if isinstance(o, MultiLoss):
            y = y if len(y) > 1 else (np.arange(s.shape[1]) == y[0]).astype(float)
            return float(o.loss(A, [s[:, j] for j in range(s.shape[1])], [y[j : j + 1] for j in range(len(y))])[0])
        return float(o.loss(A, s[:, 0], y[:1])[0])

    def leaves(self, maps: list[dict]) -> np.ndarray:
        """Leaf ids of trees; expert weights (trees x K, flat) of soft trees."""
        return self._leaves(self._of_maps(maps))

    def apply(self, samples: DataFrame, kind: str = "value", name: str = "predicts", features_col: str = "features") -> DataFrame:
        """Adds an array column of predictions, scores or leaf values. Rows stay in their partitions and order."""
        sent = samples.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*samples.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
        at = samples.columns.index(features_col)

        def run(batches):
            import pyarrow as pa

            me = sent.value
            places = me._places()
            known = pa.array(list(places), pa.string()), np.fromiter(places.values(), np.int64, len(places))
            score = {"value": lambda e: _activated(me.objective, me._scores(e)), "score": me._scores, "leafid": me._leaves}[kind]
            for batch in batches:
                got = np.asarray(score(me._of_arrow(batch.column(at), known)), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32()), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema.names)

        return samples.mapInArrow(run, schema)


def _text(values: Column, digits: bool) -> Column:
    return F.transform(values, lambda v: v.cast("long").cast("string") if digits else v.cast("string"))


def saved_form(df: DataFrame, mode: str, predicts: Column, raw_line: Column | None = None, raw_label: Column | None = None, model: str = "model", kind: str = "value", indexed: bool = True, x_delim: str = "###", y_delim: str = ",", features_delim: str = ",", name_value: str = ":") -> DataFrame:
    """Adds ``value``, the line to write.

    indexed: whether a value's name ends in its number; scalar continuous models write none. Leaf
    values are named <model>_tree_leaf_i.
    """
    parts = _text(predicts, kind == "leafid")
    if mode == RESULT_ONLY:
        return df.withColumn("value", F.array_join(parts, y_delim))
    if raw_label is None and raw_line is None:
        raise ValueError(f"{mode} needs the rows' labels")
    if mode == LABEL_AND_PREDICT:
        return df.withColumn("value", F.concat(raw_label, F.lit(x_delim), F.array_join(parts, y_delim)))
    if mode == AS_FEATURE:
        stem = f"{model}_tree_leaf_" if kind == "leafid" else f"{model}_label_"
        named = F.transform(parts, lambda v, i: F.concat(F.lit(stem), i.cast("string") if indexed else F.lit(""), F.lit(name_value), v))
        return df.withColumn("value", F.concat(raw_line, F.lit(features_delim), F.array_join(named, features_delim)))
    raise ValueError(f"unknown save mode {mode!r}")


def write_predictions(df: DataFrame, path: str) -> None:
    """One directory an input file (column ``file``), lines in the order of ``order``."""
    out = df.withColumn("source_file", F.regexp_extract("file", "([^/]+)/?$", 1)).repartitionByRange("file", "order").sortWithinPartitions("file", "order")
    out.select("source_file", "value").write.mode("overwrite").partitionBy("source_file").text(path)


def parallel_linear(ex: DataFrame, weights: DataFrame, keys: tuple = ("sample_id",)) -> DataFrame:
    """keys, score of a linear model as a join and an aggregate; both sides may be of any size."""
    return ex.join(sendable(weights, "weights"), "feature").groupBy(*keys).agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
