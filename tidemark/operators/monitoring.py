"""Drift between runs and the value that planners added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.fixed import DRIFT_BIAS_PCT, DRIFT_QUALITY_POINTS, DRIFT_WAPE_POINTS


def recent_runs(runs: DataFrame, n: int = 12) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def drift(runs: DataFrame, partition: list[str] = ()) -> DataFrame:
    """Each run against the one before it, with the reasons to retrain.

    Without ``partition`` pass ``recent_runs(runs)``: the order then spans a dozen rows.
    """
    w = W.partitionBy(*partition).orderBy("created_at", "run_id")
    first = F.lag("run_id").over(w).isNull()
    rows = runs.withColumns({
        "wape_drift": F.col("wape_pct") - F.lag("wape_pct").over(w),
        "quality_drift": F.col("data_quality_score") - F.lag("data_quality_score").over(w),
        "__first": first,
    })
    tenth = lambda c: F.format_number(F.abs(c), 1)
    reasons = F.array_compact(F.array(
        F.when(F.col("wape_drift") > DRIFT_WAPE_POINTS, F.concat(F.lit("Validation WAPE worsened by "), tenth(F.col("wape_drift")), F.lit(" points."))),
        F.when(F.col("quality_drift") < DRIFT_QUALITY_POINTS, F.concat(F.lit("Data quality fell by "), tenth(F.col("quality_drift")), F.lit(" points."))),
        F.when(F.abs(F.coalesce("bias_pct", F.lit(0.0))) > DRIFT_BIAS_PCT, F.lit("Absolute validation bias is above 10%.")),
    ))
    rows = rows.withColumn("__why", reasons)
    retrain = (F.size("__why") > 0) | F.col("__first")
    quiet = F.when(F.col("__first"), F.array(F.lit("Initial production baseline should be established."))).otherwise(
        F.array(F.lit("No retraining threshold was crossed."))
    )
    told = F.when(F.size("__why") > 0, F.col("__why")).otherwise(quiet)
    return rows.withColumns({"retrain": retrain, "reasons": F.array_join(told, " ")}).drop("__first", "__why")


def run_history(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", "data_end", "wape_pct", "bias_pct",
        F.col("interval_coverage_pct").alias("coverage_pct"), "best_model", F.col("evidence_level").alias("evidence"),
    )


def forecast_value_add(actuals: DataFrame, approved: DataFrame) -> DataFrame:
    """Error of the baseline and of the approved plan, in total and per item.

    ``actuals`` has item_id, ts, actual; ``approved`` has item_id, ts, baseline_mean and
    approved. The total is the row without an item.
    """
    pairs = actuals.join(approved, ["item_id", "ts"])
    a = F.col("actual")
    sums = pairs.groupingSets([[F.col("item_id")], []], F.col("item_id")).agg(
        F.sum(F.abs(a - F.col("baseline_mean"))).alias("b"), F.sum(F.abs(a - F.col("approved"))).alias("p"),
        F.sum(F.abs(a)).alias("d"), F.count("*").alias("observations"),
    )
    base = F.greatest("d", F.lit(1e-9))
    out = sums.select(
        "item_id", (F.col("b") / base * 100.0).alias("baseline_wape_pct"),
        (F.col("p") / base * 100.0).alias("approved_wape_pct"), "observations",
    )
    return out.withColumn("fva_points", F.col("baseline_wape_pct") - F.col("approved_wape_pct")).filter("observations > 0")
