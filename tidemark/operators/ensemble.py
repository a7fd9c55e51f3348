"""Method selection, per-item model weights and the weighted forecast.

Records are spread by item once. Weights, the ensemble gate and the blend then follow that
partitioning: an item holds at most models x folds x horizon records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import FALLBACK_MODEL, METHOD_FAMILIES, MODELS
from .baselines import model_order
from .metrics import error_sums, wape_ratio

_TIE = 1e-12


def allowed_models(method: str) -> list[str] | None:
    """Models a method name stands for; ``None`` means all of them."""
    method = (method or "recommended").strip()
    if method == "recommended":
        return None
    if method in METHOD_FAMILIES:
        return METHOD_FAMILIES[method]
    name = method.split(":", 1)[1] if method.startswith("model:") else method
    if name not in MODELS:
        raise ValueError(f"unknown method {method!r}; available: {', '.join([*METHOD_FAMILIES, *MODELS])}")
    return [name]


def check_method(method: str, fitted: list[str]) -> None:
    """A method none of whose models is fitted is an error, not a silent fallback."""
    allowed = allowed_models(method)
    if allowed is not None and not set(allowed) & set(fitted):
        raise ValueError(f"no model of method {method!r} is fitted; available: {', '.join(fitted)}")


def weigh(wapes: DataFrame, keys: list[str]) -> DataFrame:
    """Weights from ``keys..., model, wape``: close to the best, at most six, summing to 1."""
    group = W.partitionBy(*keys)
    v = F.col("wape")
    scored = wapes.filter(v.isNotNull()).withColumn("best", F.min(v).over(group))
    near = scored.filter(v <= F.greatest(F.col("best") * 1.75, F.col("best") + 0.12))
    place = F.row_number().over(group.orderBy("wape", model_order(F.col("model"))))
    kept = near.withColumn("place", place).filter(F.col("place") <= 6)
    raw = F.exp(F.lit(-4.0) * F.greatest(F.lit(0.0), v - F.col("best"))) / F.greatest(v, F.lit(0.025))
    return kept.withColumn("__raw", raw).withColumn("weight", F.col("__raw") / F.sum("__raw").over(group)).drop("__raw")


def _selected(wapes: DataFrame, method: str) -> DataFrame:
    allowed = allowed_models(method)
    return wapes if allowed is None else wapes.filter(F.col("model").isin(allowed))


def _weight_map(weights: DataFrame) -> DataFrame:
    return weights.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("weights"),
        F.min_by("model", "place").alias("best_model"),
        F.min("best").alias("best_wape"),
        F.count("*").alias("models"),
    )


def series_weight_maps(records: DataFrame, method: str = "recommended") -> DataFrame:
    """One row per item: ``weights`` map, ``best_model`` and whether the gate closed."""
    by_item = records.repartition("item_id")
    wapes = error_sums(by_item, ["item_id", "model"]).select("item_id", "model", wape_ratio().alias("wape"))
    maps = _weight_map(weigh(_selected(wapes, method), ["item_id"]))
    if method != "recommended":
        return maps.select("item_id", "weights", "best_model", F.lit(False).alias("gated"))
    blended = _blend(by_item, maps).groupBy("item_id", "ts").agg(
        F.first("actual").alias("actual"), (F.sum("__wp") / F.sum("__w")).alias("pred")
    )
    errors = error_sums(blended, ["item_id"]).select("item_id", wape_ratio().alias("blend_wape"))
    gated = (F.col("models") > 1) & (F.col("blend_wape") >= F.col("best_wape") - _TIE)
    return maps.join(errors, "item_id").withColumn("gated", gated).select(
        "item_id",
        F.when(F.col("gated"), F.create_map("best_model", F.lit(1.0))).otherwise(F.col("weights")).alias("weights"),
        "best_model", "gated",
    )


def _blend(preds: DataFrame, maps: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Predictions with the weight of their model; models without weight drop out."""
    how = "inner" if fallback is None else "left"
    joined = preds.join(maps.select("item_id", "weights"), "item_id", how)
    weights = F.col("weights") if fallback is None else F.coalesce("weights", fallback)
    joined = joined.withColumn("__w", F.try_element_at(weights, F.col("model"))).filter(F.col("__w").isNotNull())
    return joined.withColumn("__wp", F.col("__w") * F.col("pred"))


def series_weights(records: DataFrame, method: str = "recommended") -> DataFrame:
    """Long form: ``item_id, model, weight, gated``."""
    return series_weight_maps(records, method).select(
        "item_id", F.explode("weights").alias("model", "weight"), "gated"
    )


def global_weights(records: DataFrame, method: str = "recommended") -> DataFrame:
    """Weights over the whole portfolio: as many rows as models."""
    wapes = error_sums(records, ["model"]).select("model", wape_ratio().alias("wape"))
    return weigh(_selected(wapes, method).withColumn("__all", F.lit(1)), ["__all"]).select("model", "weight", "wape", "place")


def global_weight_map(records: DataFrame, method: str = "recommended") -> Column:
    entries = F.collect_list(F.struct("model", "weight"))
    one = global_weights(records, method).agg(F.map_from_entries(entries).alias("w"))
    default = F.create_map(F.lit(FALLBACK_MODEL), F.lit(1.0))
    return one.select(F.when(F.size("w") > 0, F.col("w")).otherwise(default)).scalar()


def ensemble(preds: DataFrame, maps: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Blend per item and date, re-normalised over the models that are present."""
    weighted = _blend(preds.repartition("item_id"), maps, fallback)
    return weighted.groupBy("item_id", "ts").agg(
        F.first("step").alias("step"),
        F.first("actual").alias("actual"),
        (F.sum("__wp") / F.sum("__w")).alias("baseline"),
        F.stddev_pop("pred").alias("disagreement"),
    )


def residuals(blended: DataFrame) -> DataFrame:
    return blended.select(
        "item_id", "ts", "step", "actual", F.col("baseline").alias("pred"),
        (F.col("actual") - F.col("baseline")).alias("residual"),
    )


def evidence(folds: DataFrame, horizon: int, panel: DataFrame) -> DataFrame:
    """Evidence level of a run; limited evidence may not be published."""
    facts = folds.agg(F.count("*").alias("rolling_folds"), F.coalesce(F.max("fold_h"), F.lit(0)).alias("validation_horizon"))
    periods = panel.agg(F.count_distinct("ts")).scalar()
    covered = F.col("validation_horizon") >= horizon
    level = (
        F.when((F.col("rolling_folds") >= 3) & covered, "strong")
        .when((F.col("rolling_folds") >= 2) & covered, "moderate")
        .otherwise("limited")
    )
    facts = facts.withColumns({"history_periods": periods, "evidence_level": level})
    limited = F.concat(
        F.lit("Only "), F.col("rolling_folds").cast("string"),
        F.lit(f" validation window(s) cover a horizon of {int(horizon)} periods; review the plan by hand."),
    )
    reason = (
        F.when(F.col("evidence_level") == "strong", "Three validation windows cover the horizon.")
        .when(F.col("evidence_level") == "moderate", "Two validation windows cover the horizon.")
        .otherwise(limited)
    )
    return facts.withColumns({"evidence_reason": reason, "publish_allowed": F.col("evidence_level") != "limited"})


def best_model_label(weights: DataFrame, gated_series: Column, method: str = "recommended") -> DataFrame:
    """Name of the winning selection from the portfolio weights."""
    chosen = weights.filter("weight > 0").agg(F.count("*").alias("k"), F.min_by("model", "place").alias("m"))
    if method == "recommended":
        label = (
            F.when(gated_series > 0, "Recommended guarded selection")
            .when(F.col("k") > 1, "Recommended ensemble")
            .otherwise(F.coalesce("m", F.lit(FALLBACK_MODEL)))
        )
    else:
        label = F.when(F.col("k") == 1, F.col("m")).otherwise(F.lit(f"{method.title()} ensemble"))
    return chosen.select(label.alias("best_model"))
