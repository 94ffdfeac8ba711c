"""Scoring a stream: the same predictor on micro-batches, and windowed quality with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.score import Predictor


def scored_stream(samples: DataFrame, predictor: Predictor, name: str = "predicts") -> DataFrame:
    """A stream of samples (features: map) with predictions; stateless, so it runs in any output mode."""
    return predictor.apply(samples, name=name)


def windowed_loss(stream: DataFrame, time_col: str, loss_col: str, weight_col: str = "weight", window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """window, loss, weight: mean loss by time window; rows later than ``delay`` are dropped by the watermark."""
    over = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    got = stream.withWatermark(time_col, delay).groupBy(over.alias("window")).agg(F.sum(F.col(loss_col) * F.col(weight_col)).alias("total"), F.sum(weight_col).alias("weight"))
    return got.select("window", (F.col("total") / F.col("weight")).alias("loss"), "weight")
