"""Quantity scenarios on a chosen forecast, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.fixed import ADJUSTMENT_RANGE


def quantity_scenario(forecast: DataFrame, pct: float, name: str) -> DataFrame:
    """Scale every row; the model is not refitted and the base rows stay as they were."""
    low, high = ADJUSTMENT_RANGE
    if not name.strip():
        raise ValueError("a scenario needs a name")
    if "scenario_name" in forecast.columns:
        raise ValueError("scenarios start from an unadjusted forecast")
    if not low <= pct <= high:
        raise ValueError(f"the change must be between {low} and {high} percent")
    times = 1.0 + pct / 100.0
    scaled = {c: F.col(c) * times for c in ("mean", "p10", "p50", "p90")}
    return forecast.withColumns({
        "baseline_mean": F.col("mean"), **scaled,
        "scenario_adjustment_pct": F.lit(float(pct)), "scenario_name": F.lit(name.strip()),
    })


def compare_scenarios(runs: DataFrame) -> DataFrame:
    """Totals per run against the run they derive from.

    ``runs`` are forecast rows with run_id, base_run_id and scenario_name; they are summed
    per run before runs are compared.
    """
    totals = runs.groupBy("run_id", "base_run_id", "scenario_name").agg(F.sum("mean").alias("total"))
    family = W.partitionBy(F.coalesce("base_run_id", "run_id"))
    base = F.max(F.when(F.col("base_run_id").isNull(), F.col("total"))).over(family)
    totals = totals.withColumn("baseline", base)
    change = F.when(F.col("baseline") != 0, (F.col("total") / F.col("baseline") - 1.0) * 100.0)
    return totals.withColumn("change_pct", F.when(F.col("base_run_id").isNotNull(), change))


def scenario_summary(forecast: DataFrame, portfolio: DataFrame, meta: DataFrame) -> DataFrame:
    """Totals, closing stock, risks and cost exposure of one run."""
    per_item = forecast.groupBy("item_id").agg(F.min_by("mean", "ts").alias("next"), F.sum("mean").alias("total"))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in meta.columns else F.lit(0.0)
    joined = per_item.join(meta, "item_id", "left")
    stock = value("inventory_on_hand_tonnes") - F.col("next")
    room = value("monthly_capacity_tonnes")
    items = joined.agg(
        F.sum(stock).alias("closing_stock"),
        F.count_if(stock < value("safety_stock_tonnes")).alias("stock_risks"),
        F.count_if((room > 0) & (F.col("next") / F.nullif(room, F.lit(0.0)) > 0.9)).alias("capacity_risks"),
        F.sum(F.col("total") * value("unit_cost_irr")).alias("cost_exposure"),
    )
    one = portfolio.agg(F.struct(
        F.sum("mean").alias("total"), F.sum("p10").alias("low"), F.sum("p90").alias("high")
    ).alias("t")).scalar()
    return items.withColumns({"total": one["total"], "low": one["low"], "high": one["high"]})
