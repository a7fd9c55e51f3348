"""Calibrated ranges, forecast rows and portfolio totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import ADJUSTMENT_RANGE, INTERVAL_QUANTILE
from ..functions.quantiles import exact_quantile


def _horizon(value: Column | int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.greatest(value, F.lit(1))


def _growth(validation_h: Column | int) -> Column:
    """Ranges widen with the square root of the step beyond the validated horizon."""
    h, step = _horizon(validation_h), F.col("step") + 1
    return F.when(step > h, F.sqrt(step / h)).otherwise(1.0)


def _item_quantiles(res: DataFrame) -> DataFrame:
    """Per item: overall quantile and a map of step quantiles. An item has few residuals."""
    q = F.percentile("__r", F.lit(INTERVAL_QUANTILE))
    by_item = res.withColumn("__r", F.abs("residual")).repartition("item_id")
    steps = by_item.groupBy("item_id", "step").agg(F.count("*").alias("n"), q.alias("q"))
    step_map = steps.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.when(F.col("n") >= 2, F.col("q"))))).alias("item_steps")
    )
    overall = by_item.groupBy("item_id").agg(F.count("*").alias("n"), q.alias("q"))
    overall = overall.select("item_id", F.when(F.col("n") >= 3, F.col("q")).alias("item_q"))
    return overall.join(step_map, "item_id")


def calibrated_spread(res: DataFrame, blended: DataFrame, validation_h: Column | int) -> DataFrame:
    """Add ``spread`` to forecast rows from four levels of residual quantiles."""
    absolute = res.select("step", F.abs("residual").alias("r"))
    everywhere = exact_quantile(absolute, [], "r", INTERVAL_QUANTILE, "q").select("q").scalar()
    steps = exact_quantile(absolute, ["step"], "r", INTERVAL_QUANTILE, "q")
    # at most one entry per horizon step
    step_value = steps.agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.when(F.col("n") >= 3, F.col("q")))))
    ).scalar()
    joined = blended.join(_item_quantiles(res), "item_id", "left")
    levels = [
        (1.0, F.when(everywhere > 0, everywhere)),
        (1.25, F.try_element_at(step_value, F.col("step"))),
        (1.5, F.col("item_q")),
        (2.0, F.try_element_at("item_steps", F.col("step"))),
    ]
    joined = joined.withColumns({f"__q{i}": value for i, (_, value) in enumerate(levels)})
    top, mass = F.lit(0.0), F.lit(0.0)
    for i, (weight, _) in enumerate(levels):
        here = F.col(f"__q{i}")
        top = top + F.coalesce(here * weight, F.lit(0.0))
        mass = mass + F.when(here.isNotNull(), weight).otherwise(0.0)
    joined = joined.withColumns({"__top": top, "__mass": mass})
    base = F.when(F.col("__mass") > 0, F.col("__top") / F.col("__mass")).otherwise(F.col("disagreement"))
    spread = base * _growth(validation_h) + 0.35 * F.col("disagreement")
    return joined.select(*blended.columns, F.greatest(F.lit(0.0), spread).alias("spread"))


def forecast_rows(calibrated: DataFrame, adjustment_pct: float = 0.0) -> DataFrame:
    low, high = ADJUSTMENT_RANGE
    if not low <= adjustment_pct <= high:
        raise ValueError(f"adjustment must be between {low} and {high} percent")
    times = max(0.0, 1.0 + adjustment_pct / 100.0)
    mid = F.col("baseline") * times
    reach = F.col("spread") * times
    return calibrated.select(
        "item_id", "ts", "step",
        F.greatest(F.lit(0.0), "baseline").alias("baseline_mean"),
        F.lit(float(adjustment_pct)).alias("scenario_adjustment_pct"),
        F.greatest(F.lit(0.0), mid).alias("mean"),
        F.greatest(F.lit(0.0), mid - reach).alias("p10"),
        F.greatest(F.lit(0.0), mid).alias("p50"),
        F.greatest(mid, mid + reach).alias("p90"),
    )


def portfolio_residuals(res: DataFrame) -> DataFrame:
    """Sum of item residuals per date. A date keeps one of its steps, the highest."""
    return res.groupBy("ts").agg(F.sum("residual").alias("residual"), F.max("step").alias("step"))


def portfolio_forecast(forecast: DataFrame, res: DataFrame, validation_h: Column | int) -> DataFrame:
    """Totals per date with a range from portfolio residuals, not from summed ranges."""
    by_date = portfolio_residuals(res).withColumn("r", F.abs("residual"))
    q = F.percentile("r", F.lit(INTERVAL_QUANTILE))
    # one residual per evaluated date: folds x horizon values
    steps = by_date.groupBy("step").agg(F.count("*").alias("n"), q.alias("q"))
    step_value = steps.agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.when(F.col("n") >= 2, F.col("q")))))
    ).scalar()
    everywhere = by_date.agg(F.when(F.count("*") >= 3, q)).scalar()
    totals = forecast.groupBy("ts").agg(
        F.sum("mean").alias("mean"), F.sum("baseline_mean").alias("baseline_mean"),
        F.max("scenario_adjustment_pct").alias("scenario_adjustment_pct"),
        (F.sqrt(F.sum(F.pow(F.col("mean") - F.col("p10"), 2))) * 1.25).alias("__sum_spread"),
    )
    # dates of one forecast run: bounded by the calendar
    totals = totals.withColumn("step", F.row_number().over(W.orderBy("ts")) - 1)
    spread = F.coalesce(F.try_element_at(step_value, F.col("step")), everywhere, F.col("__sum_spread"))
    totals = totals.withColumn("__spread", spread * _growth(validation_h))
    return totals.select(
        "ts", "baseline_mean", "scenario_adjustment_pct", "mean", F.col("mean").alias("p50"),
        F.greatest(F.lit(0.0), F.col("mean") - F.col("__spread")).alias("p10"),
        (F.col("mean") + F.col("__spread")).alias("p90"),
    )


def model_totals(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model", "ts").agg(F.sum("pred").alias("mean"))
