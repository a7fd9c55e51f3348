"""Origin features and the direct multi-step training frame.

Features describe what is known before an origin. They are computed once per origin from
framed windows that share one partitioning and one sort; the label and driver rows of the
following steps come from the same sort, so no self-join is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import columns as C
from ..functions.fixed import EWM_SPANS, ROLLING_WINDOWS, STD_WINDOWS, ZERO


def _before(k: int):
    return W.partitionBy("item_id").orderBy("ts").rowsBetween(-k, -1)


def with_position(panel: DataFrame) -> DataFrame:
    """``idx``: 0-based position of a row within its item."""
    return panel.withColumn("idx", F.row_number().over(W.partitionBy("item_id").orderBy("ts")) - 1)


def lag_features(lags: list[int]) -> dict[str, Column]:
    w = W.partitionBy("item_id").orderBy("ts")
    return {f"lag_{k}": F.lag("target", k).over(w) for k in lags}


def _median(values: Column, k: int) -> Column:
    """Median of the last ``k`` of an array; null if it is empty."""
    tail = F.sort_array(F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), F.lit(k)))
    n = F.size(tail)
    return (F.get(tail, F.floor((n - 1) / 2).cast("int")) + F.get(tail, F.floor(n / 2).cast("int"))) / 2.0


def add_rolling(df: DataFrame) -> DataFrame:
    """Mean, median and nonzero rate of the last 2, 3, 6 and 12 values, spread of 3 and 6.

    One frame collects the last twelve values for all medians.
    """
    nonzero = (F.col("target") > F.lit(ZERO)).cast("double")
    means, medians, rates, spreads = {}, {}, {}, {}
    for k in ROLLING_WINDOWS:
        means[f"rolling_mean_{k}"] = F.avg("target").over(_before(k))
        medians[f"rolling_median_{k}"] = _median(F.col("__recent"), k)
        rates[f"nonzero_rate_{k}"] = F.coalesce(F.avg(nonzero).over(_before(k)), F.lit(0.0))
    for k in STD_WINDOWS:
        seen = F.count("target").over(_before(k))
        spreads[f"rolling_std_{k}"] = F.when(seen >= 2, F.stddev_pop("target").over(_before(k))).otherwise(0.0)
    recent = F.collect_list("target").over(_before(max(ROLLING_WINDOWS)))
    return df.withColumns({"__recent": recent, **means, **rates, **spreads}).withColumns(medians).drop("__recent")


def _ewm(y: np.ndarray, seen: np.ndarray, idx: np.ndarray, span: int) -> pa.Array:
    """Exponential mean of the ``3 * span`` rows before each, seeded by the oldest value; ``y`` starts as many rows earlier than ``idx``."""
    n, off, alpha = len(idx), len(y) - len(idx), 2.0 / (span + 1.0)
    acc, begun = np.zeros(n), np.zeros(n, bool)
    for k in range(3 * span, 0, -1):
        at = slice(off - k, off - k + n)
        use = seen[at] & (idx >= k)
        acc = np.where(use, np.where(begun, alpha * y[at] + (1.0 - alpha) * acc, y[at]), acc)
        begun |= use
    return pa.array(acc, mask=~begun)


def add_ewm(panel: DataFrame) -> DataFrame:
    """Exponential means of the values before each row. Items lie whole and in order in a partition; a batch is worked out at once."""
    reach = 3 * max(EWM_SPANS)

    def batches(source):
        y, seen = np.zeros(reach), np.zeros(reach, bool)
        for batch in source:
            target = batch.column("target")
            idx = batch.column("idx").to_numpy(zero_copy_only=False)
            y = np.concatenate([y[len(y) - reach :], target.to_numpy(zero_copy_only=False).astype(float)])
            seen = np.concatenate([seen[len(seen) - reach :], target.is_valid().to_numpy(zero_copy_only=False)])
            made = [_ewm(y, seen, idx, s) for s in EWM_SPANS]
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, *ewm_names()])

    base = panel if "idx" in panel.columns else with_position(panel)
    dealt = base.repartition("item_id").sortWithinPartitions("item_id", "idx")
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ewm_names()]])
    return dealt.mapInArrow(batches, schema)


def ewm_names() -> list[str]:
    return [f"ewm_{s}" for s in EWM_SPANS]


def level_features() -> dict[str, Column]:
    """Momentum, trailing zeros and the recent level against the last year."""
    w = W.partitionBy("item_id").orderBy("ts")
    recent, prior = F.avg("target").over(_before(2)), F.avg("target").over(w.rowsBetween(-4, -3))
    quarter, year = F.avg("target").over(_before(3)), F.avg("target").over(_before(12))
    past = w.rowsBetween(W.unboundedPreceding, -1)
    last_sale = F.max(F.when(F.col("target") > F.lit(ZERO), F.col("idx"))).over(past)
    return {
        "recent_momentum": F.when((F.col("idx") >= 4) & (F.abs(prior) > ZERO), recent / prior - 1.0).otherwise(0.0),
        "zero_run_length": (F.col("idx") - F.coalesce(last_sale, F.lit(-1)) - 1).cast("double"),
        "seasonal_level_ratio": F.when((F.col("idx") >= 12) & (F.abs(year) > ZERO), quarter / year).otherwise(1.0),
    }


def origin_features(panel: DataFrame, lags: list[int]) -> DataFrame:
    """All features at every origin; ``idx`` counts the observations before it."""
    base = panel if "idx" in panel.columns else with_position(panel)
    return add_rolling(add_ewm(base)).withColumns({**lag_features(lags), **level_features()})


def feature_names(lags: list[int]) -> list[str]:
    rolling = [f"{name}_{k}" for k in ROLLING_WINDOWS for name in ("rolling_mean", "rolling_median", "nonzero_rate")]
    rolling += [f"rolling_std_{k}" for k in STD_WINDOWS]
    return [*[f"lag_{k}" for k in lags], *rolling, *ewm_names(), *level_features()]


def direct_frame(
    panel: DataFrame, lags: list[int], horizon: int, drivers: list[str] = (), *,
    keep_unlabelled: bool = False, warmup: int | None = None,
) -> DataFrame:
    """One row per origin and step ahead: features at the origin, drivers and label at the step.

    ``panel`` may end with future rows whose target is null. They never become labels; with
    ``keep_unlabelled`` they are returned too, and ``origin_y`` is the value at the origin,
    which is null where the origin lies in the future.
    """
    warmup = max([*lags, 3]) if warmup is None else warmup
    w = W.partitionBy("item_id").orderBy("ts").rowsBetween(0, horizon - 1)
    ahead = F.collect_list(F.struct("ts", F.col("idx").cast("double").alias("time_idx"), "target", *drivers)).over(w)
    framed = origin_features(panel, lags).withColumn("__ahead", ahead).filter(F.col("idx") >= warmup)
    names = feature_names(lags)
    stepped = framed.select(
        "item_id", F.col("idx").alias("origin_idx"), F.col("ts").alias("origin_ts"),
        F.col("target").alias("origin_y"), *names, F.posexplode("__ahead").alias("__pos", "__row"),
    )
    out = stepped.select(
        "item_id", "origin_idx", "origin_ts", *(["origin_y"] if keep_unlabelled else []), F.col("__row.ts").alias("ts"),
        (F.col("__pos") + 1).cast("double").alias("forecast_step"),
        F.col("__row.time_idx").alias("time_idx"),
        *names,
        *[F.col(f"__row.{c}").alias(c) for c in drivers],
        F.col("__row.target").alias("y"),
    )
    return out if keep_unlabelled else out.filter(F.col("y").isNotNull())


def tail_per_item(panel: DataFrame, n: int = 48) -> DataFrame:
    newest = W.partitionBy("item_id").orderBy(F.desc("ts"))
    return panel.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= n).drop("__r")


def tail_portfolio(panel: DataFrame, n: int = 48) -> DataFrame:
    """The newest ``n`` dates of all items together."""
    return panel.groupBy("ts").agg(F.sum("target").alias("target")).orderBy(F.desc("ts")).limit(n)


def shortest_series(panel: DataFrame, cutoffs: list = ()) -> list[int]:
    """Length of the shortest item, over everything and before each cutoff date.

    These few numbers are needed before lag columns can be named; one job finds them all.
    """
    counts = [F.count("*").alias("n0")]
    counts += [F.count_if(F.col("ts") < F.lit(c)).alias(f"n{i}") for i, c in enumerate(cutoffs, 1)]
    per_item = panel.groupBy("item_id").agg(*counts)
    row = per_item.agg(*[F.min(F.nullif(F.col(f"n{i}"), F.lit(0))).alias(f"n{i}") for i in range(len(counts))]).first()
    return [int(n or 0) for n in row]
