"""Sample lines ``weight###labels###features[###initial prediction]`` to typed rows, LIBSVM conversion, line hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Delimiters:
    x: str = "###"
    y: str = ","
    features: str = ","
    name_value: str = ":"

    def __post_init__(self):
        if self.x in (self.y, self.features, self.name_value) or self.features == self.name_value:
            raise ValueError("x_delim must differ from the others, features_delim from feature_name_val_delim")


def quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value, file, line_no-like order key. Files below directories are read too, hidden ones are not."""
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("order"))


def apply_hook(lines: DataFrame, hook: Callable[[bytes], list[str]]) -> DataFrame:
    """Each line through ``hook``, which gives any number of lines back. Other columns are repeated."""
    rest = [c for c in lines.columns if c != "value"]

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(value=[hook((v or "").encode()) for v in pdf["value"]]).explode("value")
            yield pdf[pdf["value"].notna()]

    return lines.select("value", *rest).mapInPandas(run, lines.select("value", *rest).schema)


def _number(c: Column) -> Column:
    return F.expr("try_cast(trim(__x) as double)") if c is None else F.trim(c).try_cast("double")


def _entries(text: Column, d: Delimiters) -> Column:
    pair = lambda t: F.split(t, quoted(d.name_value))
    got = F.transform(F.filter(F.split(text, quoted(d.features)), lambda t: F.trim(t) != ""), lambda t: F.struct(F.trim(pair(t)[0]).alias("name"), _number(F.get(pair(t), 1)).alias("value")))
    return F.when(F.trim(text) == "", F.array().cast("array<struct<name:string,value:double>>")).otherwise(got)


def parse(lines: DataFrame, delimiters: Delimiters = Delimiters(), value_col: str = "value") -> DataFrame:
    """Adds weight, label (array, null when absent), features (map, the last of equal names), init_pred, error.

    error says why a row is bad: 'weight', 'label', 'feature' or 'init_pred'. NaN is a value, infinity is not.
    """
    d = delimiters
    rest = [c for c in lines.columns if c != value_col]
    parts = F.split(F.trim(F.col(value_col)), quoted(d.x))
    df = lines.select(F.col(value_col), *rest, parts.alias("p"))
    numbers = lambda c: F.transform(F.split(c, quoted(d.y)), lambda t: _number(t))
    bad = lambda v: v.isNull() | (F.abs(v) == float("inf"))
    label, init = F.trim(F.coalesce(F.get("p", 1), F.lit(""))), F.trim(F.coalesce(F.get("p", 3), F.lit("")))
    df = df.select(F.col(value_col), *rest, _number(F.get("p", 0)).alias("weight"), F.when(label != "", numbers(label)).alias("label"), _entries(F.coalesce(F.get("p", 2), F.lit("")), d).alias("e"), F.when(init != "", numbers(init)).alias("init_pred"))
    error = F.when(bad(F.col("weight")), "weight").when(F.exists(F.coalesce("label", F.array().cast("array<double>")), bad), "label").when(F.exists("e", lambda x: bad(x["value"])), "feature").when(F.exists(F.coalesce("init_pred", F.array().cast("array<double>")), bad), "init_pred")
    last = F.transform(F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + 2, F.size("e")), lambda z: z["name"] == x["name"])), lambda x: x)
    return df.withColumn("error", error).select(F.col(value_col), *rest, "weight", "label", F.when(F.col("error").isNull(), F.map_from_entries(last)).alias("features"), "init_pred", "error")


def checked(parsed: DataFrame, max_error_tol: int = 0) -> DataFrame:
    """Good rows; fails on any bad weight, label or initial prediction, and on more bad features than tolerated. One job."""
    n = {r["error"]: r["n"] for r in parsed.filter("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n")).collect()}
    fatal = {k: v for k, v in n.items() if k != "feature"}
    if fatal or n.get("feature", 0) > max_error_tol:
        raise ValueError(f"bad lines: {n}, tolerated feature errors: {max_error_tol}")
    return parsed.filter("error IS NULL").drop("error")


def libsvm_to_lines(lines: DataFrame, mode: str, delimiters: Delimiters = Delimiters(), value_col: str = "value") -> DataFrame:
    """value: sample lines. mode: ``regression``, ``binary_classification@l1,l2`` or ``multi_classification@l1,...``.

    Labels become their index in the mode's list; an unknown label makes the line null. Lines without label keep all features.
    """
    d = delimiters
    kind, _, names = mode.partition("@")
    parts = F.split(F.trim(F.col(value_col)), "\\s+")
    has = ~F.contains(F.element_at(parts, 1), F.lit(":"))
    first = F.element_at(parts, 1)
    if kind == "regression":
        label = first.try_cast("double").cast("string")
    elif kind in ("binary_classification", "multi_classification") and names:
        index = F.array_position(F.array(*[F.lit(x.strip()) for x in names.split(",")]), first)
        label = F.when(index > 0, (index - 1).cast("string"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    features = F.array_join(F.transform(F.slice(parts, F.when(has, 2).otherwise(1), F.size(parts)), lambda t: F.regexp_replace(t, "^([^:]*):", "$1" + d.name_value.replace("\\", "\\\\").replace("$", "\\$"))), d.features)
    return lines.withColumn(value_col, F.concat(F.lit("1" + d.x), F.when(has, label).otherwise(""), F.lit(d.x), features))
