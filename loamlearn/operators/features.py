"""Features as relations: exploded (sample_id, feature, value), dictionaries, statistics, transforms, sampling, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.losses import pure_classification
from ..functions.quantile import weighted_quantiles
from ..plans.session import saved, sendable

BIAS = "_bias_"
SMALL = 1e-6


def exploded(samples: DataFrame, keys: tuple = ("sample_id",), features_col: str = "features") -> DataFrame:
    return samples.select(*keys, F.explode(features_col).alias("feature", "value"))


def feature_counts(ex: DataFrame, filter_threshold: int = 0) -> DataFrame:
    """feature, cnt: occurrences whatever the value; those below the threshold go."""
    return ex.groupBy("feature").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= filter_threshold)


def dictionary(features: DataFrame, need_bias: bool = True) -> DataFrame:
    """feature, idx: by name, the bias first.

    Ranks come from range partitions, so that no task sorts all names.
    """
    spark = features.sparkSession
    names = features.select("feature").distinct().filter(F.col("feature") != BIAS)
    dealt = names.repartitionByRange("feature").withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "dictionary")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = dealt.join(F.broadcast(sizes), "part").withColumn("idx", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("feature")) - 1 + int(need_bias)).select("feature", F.col("idx").cast("long").alias("idx"))
    return out.unionByName(spark.createDataFrame([(BIAS, 0)], "feature string, idx long")) if need_bias else out


def in_dictionary(ex: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of known features with their idx."""
    return ex.join(sendable(words, "words"), "feature")


def with_bias(samples: DataFrame, features_col: str = "features") -> DataFrame:
    return samples.withColumn(features_col, F.map_concat(features_col, F.create_map(F.lit(BIAS), F.lit(1.0))))


def feature_stats(ex: DataFrame) -> DataFrame:
    """feature, cnt, sum, sum2, max, min, mean, std over present values, without weights."""
    v = F.col("value")
    out = ex.groupBy("feature").agg(F.count(v).alias("cnt"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum2"), F.max(v).alias("max"), F.min(v).alias("min"))
    mean = F.col("sum") / F.col("cnt")
    return out.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("sum2") / F.col("cnt") - mean * mean, F.lit(0.0))))


def transformed_value(mode: str, range_min: float = -1.0, range_max: float = 1.0) -> Column:
    """The transform of ``value`` given the columns of feature_stats."""
    v = F.col("value")
    if mode == "standardization":
        return F.when(F.col("std") < SMALL, v).otherwise((v - F.col("mean")) / F.col("std"))
    if mode == "scale_range":
        width = F.col("max") - F.col("min")
        return F.when(width < SMALL, 1.0).otherwise(range_min + (range_max - range_min) * (v - F.col("min")) / width)
    raise ValueError(f"unknown transform {mode!r}")


def selected(feature: Column, include: tuple = (), exclude: tuple = ()) -> Column:
    """Whether a feature is transformed: include wins, else all but exclude."""
    if include:
        return feature.isin(*include)
    return ~feature.isin(*exclude) if exclude else F.lit(True)


def transform_features(ex: DataFrame, stats: DataFrame, mode: str, include: tuple = (), exclude: tuple = (), **ranges) -> DataFrame:
    """Unselected and unknown features pass as they are; the bias is never transformed."""
    got = ex.join(sendable(stats.select("feature", "cnt", "mean", "std", "max", "min"), "stats"), "feature", "left")
    do = selected(F.col("feature"), include, exclude) & F.col("cnt").isNotNull() & (F.col("feature") != BIAS)
    return got.withColumn("value", F.when(do, transformed_value(mode, **ranges)).otherwise(F.col("value"))).select(*ex.columns)


def label_sampling(samples: DataFrame, rates: dict[float, float], objective: str, label: Column | None = None, seed: int = 7) -> DataFrame:
    """Rates per class: up to 1 keeps a row with that chance and divides its weight by it, above 1 multiplies the weight."""
    if not pure_classification(objective):
        raise ValueError("label sampling needs a classification objective")
    y = F.col("label")[0] if label is None else label
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(float(x)) for kv in rates.items() for x in kv]), y.cast("double")), F.lit(1.0))
    kept = samples.withColumn("__rate", rate).filter(F.rand(seed) < F.col("__rate")) if min(rates.values(), default=1) < 1 else samples.withColumn("__rate", rate)
    return kept.withColumn("weight", F.when(F.col("__rate") <= 1, F.col("weight") / F.col("__rate")).otherwise(F.col("weight") * F.col("__rate"))).drop("__rate")


def one_hot(label: Column, k: int) -> Column:
    """K masses: a class index becomes one-hot, K values stay."""
    return F.when(F.size(label) == 1, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (label[0] == i).cast("double"))).otherwise(label)


def label_error(label: Column, k: int) -> Column:
    """Why K masses are bad, or null: wrong number, out of [0, 1], or not summing to 1 within 1e-3."""
    total = F.aggregate(label, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(label) != k, "number").when(F.exists(label, lambda x: (x < 0) | (x > 1)), "range").when(F.abs(total - 1) > 1e-3, "sum")


def label_stats(samples: DataFrame, label: Column) -> DataFrame:
    return samples.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("weight").alias("weight"))


def missing_values(ex: DataFrame, mode: str = "value", weight_col: str = "weight") -> DataFrame:
    """feature, fill for ``mean``, ``quantile[@q]`` or ``value[@v]``; ex: feature, value (null or NaN: missing), weight."""
    kind, _, arg = mode.partition("@")
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    names = ex.select("feature").distinct()
    if kind == "mean":
        v, w = F.when(ok, F.col("value")), F.when(ok, F.col(weight_col))
        return ex.groupBy("feature").agg(F.coalesce(F.sum(v * w) / F.sum(w), F.lit(0.0)).alias("fill"))
    if kind == "quantile":
        got = weighted_quantiles(ex, ["feature"], F.col("value"), F.col(weight_col), float(arg or 0.5))
        return names.join(got, "feature", "left").select("feature", F.coalesce("quantile", F.lit(0.0)).alias("fill"))
    if kind == "value":
        return names.withColumn("fill", F.lit(float(arg or 0)))
    raise ValueError(f"unknown way to fill {mode!r}")


def filled(ex: DataFrame, fills: DataFrame) -> DataFrame:
    got = ex.join(sendable(fills, "fills"), "feature", "left")
    return got.withColumn("value", F.when(F.col("value").isNull() | F.isnan("value"), F.col("fill")).otherwise(F.col("value"))).drop("fill")


def instance_sample(samples: DataFrame, rate: float, seed: int, compensate: bool = False) -> DataFrame:
    """A Bernoulli sample; with compensate, weights are divided by the rate."""
    if rate >= 1:
        return samples
    kept = samples.filter(F.rand(seed) < rate)
    return kept.withColumn("weight", F.col("weight") / rate) if compensate else kept
