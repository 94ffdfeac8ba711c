"""Evaluation as aggregates: columns y, p (or arrays of K), w."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 100_000


def _error(kind: str) -> Column:
    y, p = F.col("y"), F.col("p")
    return {"rmse": (y - p) * (y - p), "mae": F.abs(y - p), "mape": F.abs((y - p) / y), "smape": F.abs(y - p) / ((y + F.abs(p)) / 2)}[kind]


def point_metric(kind: str, weight: Column | None = None) -> Column:
    """An aggregate Column: rmse, mae, mape or smape."""
    w = F.col("w") if weight is None else weight
    mean = F.sum(w * _error(kind)) / F.sum(w)
    return F.sqrt(mean) if kind == "rmse" else mean


def mean_loss(loss: Column, weight: Column) -> Column:
    return F.sum(weight * loss) / F.sum(weight)


def auc(df: DataFrame, slots: int = SLOTS, keys: list[str] | None = None) -> DataFrame:
    """One row (a row a key): the area by ``slots`` slots of p; ties within a slot count a half, positive means y = 1.

    After the group-by there are at most ``slots`` rows a key.
    """
    keys = keys or []
    slot = F.least(F.greatest(F.floor(F.col("p") * slots), F.lit(0)), F.lit(slots - 1)).alias("slot")
    per = df.groupBy(*keys, slot).agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("neg"))
    over = Window.partitionBy(*keys).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    area = F.sum(F.col("neg") * (F.coalesce("above", F.lit(0.0)) + F.col("pos") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return per.withColumn("above", F.sum("pos").over(over)).groupBy(*keys).agg(area.alias("auc"))


def exact_auc(df: DataFrame) -> DataFrame:
    """By distinct p instead of slots: for scores that aren't in [0, 1].

    Distinct values are ranked in range partitions; only the partitions' sums meet in one window.
    """
    from ..plans.session import saved

    per = df.groupBy("p").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("neg"))
    per = saved(per.repartitionByRange(F.desc("p")).withColumn("part", F.spark_partition_id()), "auc")
    sums = per.groupBy("part").agg(F.sum("pos").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("n")
    over = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    got = per.withColumn("inner", F.coalesce(F.sum("pos").over(over), F.lit(0.0))).join(F.broadcast(sums), "part")
    return got.agg((F.sum(F.col("neg") * (F.col("base") + F.col("inner") + F.col("pos") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def predicted_class(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def arg_max(array: Column) -> Column:
    """Index of the first greatest value."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """actual, predicted, w with margins: a null in either column sums over it."""
    return df.select(actual.cast("int").alias("actual"), predicted.cast("int").alias("predicted"), "w").cube("actual", "predicted").agg(F.sum("w").alias("w"))


def precision_recall(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """class, precision, recall, accuracy: one row a class."""
    cells = df.select(actual.cast("int").alias("a"), predicted.cast("int").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    each = cells.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("side")), F.struct(F.col("b").alias("c"), F.lit(0).alias("side")))).alias("s"), "w", (F.col("a") == F.col("b")).alias("hit"))
    per = each.groupBy(F.col("s.c").alias("class")).agg(F.sum(F.when(F.col("hit") & (F.col("s.side") == 1), F.col("w")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("s.side") == 1, F.col("w")).otherwise(0.0)).alias("act"), F.sum(F.when(F.col("s.side") == 0, F.col("w")).otherwise(0.0)).alias("pred"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0.0)
    return per.select("class", (F.col("tp") / F.nullif("pred", none)).alias("precision"), (F.col("tp") / F.nullif("act", none)).alias("recall"), (F.sum("tp").over(whole) / F.sum("act").over(whole)).alias("accuracy"))


def evaluate(df: DataFrame, metrics: list[str], loss: Column | None = None) -> dict[str, float]:
    """Metrics by name (``auc@100``, ``rmse``, ...), weighted; if weights aren't all one in sum, unweighted ``real_`` ones too."""
    total, n = df.agg(F.sum("w"), F.count(F.lit(1))).first()
    views = [("", df)] + ([("real_", df.withColumn("w", F.lit(1.0)))] if n and abs(total - n) > 1e-6 else [])
    out = {}
    for prefix, v in views:
        cols = {m: point_metric(m) for m in metrics if m in ("rmse", "mae", "mape", "smape")}
        if loss is not None:
            cols["loss"] = mean_loss(loss, F.col("w"))
        if cols:
            row = v.agg(*[c.alias(k) for k, c in cols.items()]).first()
            out |= {prefix + k: row[k] for k in cols}
        for m in metrics:
            name, _, arg = m.partition("@")
            if name == "auc":
                out[prefix + m] = auc(v, int(arg or SLOTS)).first()[0]
            elif name == "confusion_matrix":
                out[prefix + m] = {(r["actual"], r["predicted"]): r["w"] for r in confusion(v, F.col("y"), predicted_class(F.col("p"), float(arg or 0.5))).collect()}
            elif name not in cols:
                raise ValueError(f"unknown metric {m!r}")
    return out
