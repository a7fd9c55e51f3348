"""Forecast error metrics from mergeable sums, so that every level costs one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import INTERVAL_QUANTILE, ZERO
from ..functions.quantiles import exact_quantile
from .baselines import model_order

_SUMS = ["n", "abs_err", "abs_actual", "sq_err", "smape_sum", "smape_n", "err"]


def error_sums(records: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    a, p = F.col(actual), F.col(pred)
    size = F.abs(a) + F.abs(p)
    ratio = F.when(size > ZERO, 2.0 * F.abs(a - p) / size)
    return records.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.abs(a - p)).alias("abs_err"),
        F.sum(F.abs(a)).alias("abs_actual"),
        F.sum((a - p) * (a - p)).alias("sq_err"),
        F.coalesce(F.sum(ratio), F.lit(0.0)).alias("smape_sum"),
        F.count(ratio).alias("smape_n"),
        F.sum(p - a).alias("err"),
    )


def merge_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])


def wape_ratio() -> Column:
    """Relative absolute error; the plain mean error where there was no demand at all."""
    return F.when(F.col("abs_actual") <= ZERO, F.col("abs_err") / F.col("n")).otherwise(
        F.col("abs_err") / F.col("abs_actual")
    )


def metric_columns() -> dict[str, Column]:
    n = F.col("n")
    return {
        "wape_pct": wape_ratio() * 100.0,
        "mae": F.col("abs_err") / n,
        "rmse": F.sqrt(F.col("sq_err") / n),
        "smape_pct": F.when(F.col("smape_n") > 0, F.col("smape_sum") / F.col("smape_n")).otherwise(0.0) * 100.0,
        "bias_pct": F.when(F.col("abs_actual") > ZERO, F.col("err") / F.col("abs_actual")).otherwise(0.0) * 100.0,
        "validation_points": n,
    }


def metrics(records: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    sums = error_sums(records, keys, actual, pred)
    return sums.select(*keys, *[c.alias(name) for name, c in metric_columns().items()])


def horizon_metrics(records: DataFrame, keys: list[str] = ("model",)) -> DataFrame:
    """Metrics per step, counted from 1."""
    out = metrics(records, [*keys, "step"])
    return out.withColumn("step", F.col("step") + 1)


def leaderboard(records: DataFrame) -> DataFrame:
    """One row per model, best first. The step level is aggregated once and merged upward."""
    by_step = error_sums(records, ["model", "step"])
    overall = merge_sums(by_step, ["model"])
    spread = by_step.groupBy("model").agg(F.stddev_pop(wape_ratio() * 100.0).alias("stability_pct"))
    # as many rows as there are models, so an unpartitioned rank is safe
    place = W.orderBy("wape_pct", model_order(F.col("model")))
    return (
        overall.select("model", *[c.alias(name) for name, c in metric_columns().items()])
        .join(spread, "model")
        .withColumn("place", F.row_number().over(place))
    )


def champion_challenger(board: DataFrame) -> DataFrame:
    role = F.when(F.col("place") == 1, "champion").otherwise("challenger")
    return board.filter("place <= 2").withColumn("role", role)


def interval_coverage(residuals: DataFrame) -> DataFrame:
    """Share of absolute residuals within their 0.8 quantile, over the whole portfolio."""
    absolute = residuals.select(F.abs("residual").alias("r"))
    spread = exact_quantile(absolute, [], "r", INTERVAL_QUANTILE, "interval_spread")
    spread_value = spread.select("interval_spread").scalar()
    inside = absolute.agg(
        F.max(spread_value).alias("interval_spread"),
        (F.avg((F.col("r") <= spread_value).cast("double")) * 100.0).alias("interval_coverage_pct"),
    )
    return inside.withColumn("interval_target_pct", F.lit(100.0 * INTERVAL_QUANTILE))
