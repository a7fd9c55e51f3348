"""Per-item demand diagnostics: class, seasonality, lifecycle, breaks and isolated zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.fixed import ZERO
from ..functions.periods import season_length
from .features import with_position


def demand_class(panel: DataFrame) -> DataFrame:
    """Average demand interval and squared variation of nonzero demand."""
    base = with_position(panel)
    w = W.partitionBy("item_id").orderBy("ts")
    sold = F.col("target") > F.lit(ZERO)
    marked = base.withColumn("__sold_at", F.when(sold, F.col("idx"))).withColumn(
        "__gap",
        F.when(sold, F.col("idx") - F.last("__sold_at", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))),
    )
    size = F.when(sold, F.col("target"))
    per_item = marked.groupBy("item_id").agg(
        F.count("*").alias("history_points"), F.count(size).alias("__k"), F.avg("__gap").alias("__adi"),
        F.stddev_pop(size).alias("__sd"), F.avg(size).alias("__mean"),
        F.avg((~sold).cast("double")).alias("zero_share"),
    )
    few = F.col("__k") < 2
    adi = F.when(few, F.col("history_points").cast("double")).otherwise(F.col("__adi"))
    cv2 = F.when(few, F.lit(0.0)).otherwise(F.pow(F.col("__sd") / F.greatest("__mean", F.lit(ZERO)), 2))
    out = per_item.withColumns({"average_demand_interval": adi, "squared_coefficient_variation": cv2})
    often = F.col("average_demand_interval") < 1.32
    steady = F.col("squared_coefficient_variation") < 0.49
    return out.select(
        "item_id", "history_points", "average_demand_interval", "squared_coefficient_variation", "zero_share",
        F.when(often & steady, "smooth").when(often, "erratic").when(steady, "intermittent").otherwise("lumpy")
        .alias("demand_class"),
    )


def seasonality(panel: DataFrame, freq: str, season: int | None = None) -> DataFrame:
    s = season or season_length(freq)
    w = W.partitionBy("item_id").orderBy("ts")
    pairs = panel.withColumn("__past", F.lag("target", s).over(w))
    both = F.col("__past").isNotNull()
    # moments instead of corr(): a flat half has no correlation and counts as none
    now, past = F.when(both, F.col("target")), F.col("__past")
    per_item = pairs.groupBy("item_id").agg(
        F.count("*").alias("__n"), F.stddev_pop("target").alias("__sd"),
        F.stddev_pop(now).alias("__sx"), F.stddev_pop(past).alias("__sy"),
        F.covar_pop(now, past).alias("__cov"),
    )
    usable = (F.col("__n") >= 2 * s) & (F.col("__sd") > ZERO) & (F.col("__sx") > ZERO) & (F.col("__sy") > ZERO)
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__cov") / (F.col("__sx") * F.col("__sy"))))
    return per_item.select("item_id", F.when(usable, strength).otherwise(0.0).alias("seasonality_strength"))


def isolated_zeros(panel: DataFrame) -> DataFrame:
    w = W.partitionBy("item_id").orderBy("ts")
    lone = (
        (F.col("target") <= ZERO)
        & (F.lag("target").over(w) > ZERO)
        & (F.lead("target").over(w) > ZERO)
    )
    per_item = panel.withColumn("__lone", F.coalesce(lone, F.lit(False))).groupBy("item_id").agg(
        F.count_if("__lone").alias("isolated_zero_periods")
    )
    return per_item.withColumn("stockout_suspected", F.col("isolated_zero_periods") > 0)


def lifecycle(panel: DataFrame, freq: str, season: int | None = None) -> DataFrame:
    """Compare the last window with the one before it: break, growth, decline or mature."""
    s = season or season_length(freq)
    item = W.partitionBy("item_id")
    base = panel.withColumn("__age", F.row_number().over(item.orderBy(F.desc("ts")))).withColumn(
        "__n", F.count("*").over(item)
    )
    width = F.greatest(F.lit(3), F.least(F.lit(s), F.floor(F.col("__n") / 3)))
    base = base.withColumn("__w", width)
    recent = F.col("__age") <= F.col("__w")
    full = F.col("__n") >= 2 * F.col("__w")
    earlier = F.when(full, ~recent & (F.col("__age") <= 2 * F.col("__w"))).otherwise(
        F.col("__n") - F.col("__age") < F.col("__w")
    )
    # when the history is too short the two windows overlap, and shared rows count twice
    sides = base.select(
        "item_id", "__n", "target",
        F.explode(F.array_compact(F.array(F.when(earlier, F.lit("e")), F.when(recent, F.lit("r"))))).alias("__side"),
    )
    agg = sides.groupBy("item_id").agg(
        F.max("__n").alias("history_points"),
        F.avg(F.when(F.col("__side") == "e", F.col("target"))).alias("earlier_mean"),
        F.avg(F.when(F.col("__side") == "r", F.col("target"))).alias("recent_mean"),
        F.stddev_pop("target").alias("__sd"),
    )
    shift = F.abs(F.col("recent_mean") - F.col("earlier_mean"))
    agg = agg.withColumn("structural_break_score", shift / F.greatest("__sd", F.lit(ZERO)))
    relative = shift / F.greatest(F.abs("earlier_mean"), F.lit(ZERO))
    stage = (
        F.when(F.col("history_points") < max(12, s), "new")
        .when(F.col("recent_mean") > F.col("earlier_mean") * 1.15, "growth")
        .when(F.col("recent_mean") < F.col("earlier_mean") * 0.85, "decline")
        .otherwise("mature")
    )
    return agg.select(
        "item_id", "history_points", "earlier_mean", "recent_mean", "structural_break_score",
        ((F.col("structural_break_score") >= 0.8) & (relative >= 0.15)).alias("structural_break"),
        stage.alias("lifecycle"),
    )


def series_profile(panel: DataFrame, freq: str, season: int | None = None) -> DataFrame:
    """All diagnostics in one row per item; one exchange by item serves every part."""
    panel = panel.select("item_id", "ts", "target").repartition("item_id")
    return (
        demand_class(panel)
        .join(seasonality(panel, freq, season), "item_id")
        .join(isolated_zeros(panel), "item_id")
        .join(lifecycle(panel, freq, season).drop("history_points"), "item_id")
    )


def series_quality(metrics: DataFrame, freq: str) -> DataFrame:
    """Quality score from WAPE, bias and length; expects wape_pct, bias_pct, history_points."""
    short = F.when(F.col("history_points") < 2 * season_length(freq), 12.0).otherwise(0.0)
    score = (
        100.0
        - F.least(F.lit(70.0), F.coalesce("wape_pct", F.lit(0.0)) * 2.0)
        - F.least(F.lit(15.0), F.abs(F.coalesce("bias_pct", F.lit(0.0))) * 0.5)
        - short
    )
    return metrics.withColumn("quality_score", F.bround(F.greatest(F.lit(0.0), score), 1))
