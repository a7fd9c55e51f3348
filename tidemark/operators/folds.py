"""Rolling validation windows and their assignment to a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.periods import season_length, shift_period


def rolling_folds(panel: DataFrame, freq: str, profile: str, horizon: int) -> DataFrame:
    """At most three windows ``(fold, val_start, val_end, fold_h)`` over the union of dates.

    Only the distinct dates of the panel meet in one row, and those are bounded by the
    calendar.
    """
    if profile not in ("fast", "deep"):
        raise ValueError("profile must be fast or deep")
    s, most = season_length(freq), 3 if profile == "deep" else 2
    dates = panel.select("ts").distinct().agg(F.array_sort(F.collect_list("ts")).alias("d"))
    n = F.size("d")
    dates = dates.withColumn("n", n).withColumn(
        "min_train", F.greatest(F.lit(8), F.when(F.col("n") >= s + 8, s + 4).otherwise(6))
    )
    dates = dates.withColumn("room", F.greatest(F.lit(1), F.col("n") - F.col("min_train")))
    dates = dates.withColumn("fold_h", F.least(F.lit(max(1, int(horizon))), F.col("room")))
    dates = dates.withColumn(
        "k", F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("room") / F.col("fold_h")).cast("int")))
    )
    first = F.col("n") - F.col("k") * F.col("fold_h")
    wanted = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: first + i * F.col("fold_h"))
    dates = dates.withColumn("origins", F.filter(wanted, lambda o: o >= F.col("min_train")))
    fallback = F.array(F.greatest(F.lit(3), F.col("n") - F.col("fold_h")))
    tiny = F.col("n") < 6
    split = F.greatest(F.lit(3), F.col("n") - 1)
    dates = dates.withColumns(
        {
            "origins": F.when(tiny, F.array(split)).when(F.size("origins") == 0, fallback).otherwise(F.col("origins")),
            "fold_h": F.when(tiny, F.greatest(F.col("n") - split, F.lit(0))).otherwise(F.col("fold_h")),
        }
    )
    return (
        dates.select("d", "n", "fold_h", F.posexplode("origins").alias("fold", "o"))
        .filter(F.col("o") < F.col("n"))
        .select(
            (F.col("fold") + 1).alias("fold"),
            F.col("d")[F.col("o")].alias("val_start"),
            F.col("d")[F.least(F.col("o") + F.col("fold_h"), F.col("n")) - 1].alias("val_end"),
            "fold_h",
        )
    )


def folds_value(folds: DataFrame) -> Column:
    """The fold table as one array value, so that it joins nothing and broadcasts nothing big."""
    return folds.agg(F.array_sort(F.collect_list(F.struct("fold", "val_start", "val_end", "fold_h"))).alias("f")).scalar()


def validation_horizon(folds: DataFrame) -> Column:
    return folds.agg(F.coalesce(F.max("fold_h"), F.lit(1))).scalar()


def assign_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold it takes part in, as ``train`` or ``validate``."""
    spread = panel.withColumn("__f", F.explode(folds_value(folds)))
    ts = F.col("ts")
    role = F.when(ts < F.col("__f.val_start"), "train").when(ts <= F.col("__f.val_end"), "validate")
    return (
        spread.withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .select(F.col("__f.fold").alias("fold"), *panel.columns, "role")
    )


def series(panel: DataFrame) -> DataFrame:
    """One row per item with its ordered points; at most one point per period."""
    return panel.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ts", "target"))).alias("points"))


def dates_of(items: DataFrame) -> DataFrame:
    """The dates of ``series``, for ``rolling_folds``."""
    return items.select(F.explode("points.ts").alias("ts"))


def fold_histories(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """``(fold, item_id, y, ahead)``: training values and the validation points that follow."""
    return histories(series(panel), folds)


def histories(items: DataFrame, folds: DataFrame) -> DataFrame:
    """``fold_histories`` of ``series``, which a caller stages while items still lie whole in a partition."""
    spread = items.withColumn("__f", F.explode(folds_value(folds)))
    before = F.filter("points", lambda p: p["ts"] < F.col("__f.val_start"))
    ahead = F.filter("points", lambda p: (p["ts"] >= F.col("__f.val_start")) & (p["ts"] <= F.col("__f.val_end")))
    return spread.select(
        F.col("__f.fold").alias("fold"), "item_id",
        F.transform(before, lambda p: p["target"]).alias("y"),
        ahead.alias("ahead"),
    ).filter((F.size("y") > 0) & (F.size("ahead") > 0))


def final_histories(panel: DataFrame, freq: str, horizon: int) -> DataFrame:
    """All history of each item and its next ``horizon`` periods, as fold 0."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    last = F.element_at("points", -1)["ts"]
    future = F.transform(
        steps, lambda k: F.struct(shift_period(last, freq, k).alias("ts"), F.lit(None).cast("double").alias("target"))
    )
    return series(panel).select(
        F.lit(0).alias("fold"), "item_id",
        F.transform("points", lambda p: p["target"]).alias("y"),
        future.alias("ahead"),
    )


def with_step(records: DataFrame, horizon: Column | int) -> DataFrame:
    """0-based step: rank of the date among the item's evaluated dates, modulo the horizon."""
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    rank = F.dense_rank().over(W.partitionBy("item_id").orderBy("ts")) - 1
    return records.withColumn("step", F.pmod(rank, F.greatest(horizon, F.lit(1))).cast("int"))
