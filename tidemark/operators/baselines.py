"""Forecast methods whose recursion is a simple fold.

They take ``histories`` rows ``(fold, item_id, y, ahead)``, for as many series and folds as there are
rows. The recursions of Croston and TSB advance all series of an Arrow batch together, period by period.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import CROSTON_ALPHA, MODELS, TSB_ALPHA, TSB_BETA, ZERO


def naive_values(y: Column, steps: Column, season: int) -> Column:
    """Value one season back; short series use the mean of the last three values.

    Predictions are appended to the history, so a short series turns seasonal once it is
    long enough.
    """
    n = F.size(y)
    ks = F.sequence(F.lit(1), steps)
    repeat = F.transform(ks, lambda k: F.greatest(F.lit(0.0), y[n - season + (k - 1) % season]))

    def grow(seen: Column, _k: Column) -> Column:
        m = F.size(seen)
        value = (
            F.when(m >= season, F.try_element_at(seen, F.lit(-season)))
            .when(m >= 3, (F.try_element_at(seen, F.lit(-3)) + F.try_element_at(seen, F.lit(-2)) + F.try_element_at(seen, F.lit(-1))) / 3.0)
            .when(m > 0, F.try_element_at(seen, F.lit(-1)))
            .otherwise(F.lit(0.0))
        )
        return F.concat(seen, F.array(F.greatest(F.lit(0.0), value)))

    appended = F.slice(F.aggregate(ks, y, grow), n + 1, steps)
    return F.when(n >= season, repeat).otherwise(appended)


def _flat(value: Column, steps: Column) -> Column:
    return F.array_repeat(F.greatest(F.lit(0.0), value), steps)


def _periods(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by period and series, whether they are known, and the length of each series, which never rises; a null is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
    y, known = np.zeros((sizes.max(initial=0), len(sizes))), np.zeros((sizes.max(initial=0), len(sizes)), bool)
    known[place] = flat.is_valid().to_numpy(zero_copy_only=False)
    y[place] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    return y, known, sizes


def _levels(y: Column, one: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """``one`` over the values, sales and lengths of a batch, longest series first; 0 where it finds none."""

    def batch(lists: pa.Array) -> pa.Array:
        values, known, sizes = _periods(lists)
        order = np.argsort(-sizes, kind="stable")
        values, known, sizes = values[:, order], known[:, order], sizes[order]
        # NaN is above every number, as in Spark
        sold = known & ((values > ZERO) | np.isnan(values))
        level = np.zeros(len(sizes))
        level[order] = one(values, sold, known, sizes)
        return pa.array(level)

    return F.arrow_udf(batch, "double")(y.cast("array<double>"))


def _running(sizes: np.ndarray):
    """How many series have each period."""
    return enumerate(len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes.max(initial=0)), side="right"))


def croston_values(y: Column, steps: Column, alpha: float = CROSTON_ALPHA) -> Column:
    """Smoothed size over smoothed interval, updated only when there is demand."""
    keep, least = 1.0 - alpha, ZERO

    def level(values, sold, known, sizes):
        n = len(sizes)
        z, p, gap, started = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n, bool)
        for t, k in _running(sizes):
            v, now, was = values[t, :k], sold[t, :k], started[:k].copy()
            z[:k] = np.where(now & was, alpha * v + keep * z[:k], np.where(now, v, z[:k]))
            # before the first sale p counts the position of that sale
            p[:k] = np.where(now & was, alpha * gap[:k] + keep * p[:k], np.where(was | now, p[:k], p[:k] + 1.0))
            gap[:k] = np.where(was & ~now & known[t, :k], gap[:k] + 1.0, 1.0)
            started[:k] |= now
        return np.where(started, z / np.maximum(p, least), 0.0)

    return _flat(_levels(y, level), steps)


def tsb_values(y: Column, steps: Column, alpha: float = TSB_ALPHA, beta: float = TSB_BETA) -> Column:
    """Smoothed size times a demand probability that every period updates."""

    def level(values, sold, known, sizes):
        n, count = len(sizes), sold.sum(axis=0)
        if not len(values):
            return np.zeros(n)
        z = values[np.argmax(sold, axis=0), np.arange(n)]
        p = np.minimum(1.0, np.maximum(0.01, count / np.maximum(sizes, 1)))
        for t, k in _running(sizes):
            now = sold[t, :k]
            z[:k] = np.where(now, alpha * values[t, :k] + (1.0 - alpha) * z[:k], z[:k])
            p[:k] = np.where(now, beta, 0.0) + (1.0 - beta) * p[:k]
        return np.where(count > 0, p * z, 0.0)

    return _flat(_levels(y, level), steps)


EXACT = {
    "Seasonal naive": lambda y, steps, season: naive_values(y, steps, season),
    "Croston": lambda y, steps, season: croston_values(y, steps),
    "TSB intermittent": lambda y, steps, season: tsb_values(y, steps),
}


def model_order(model: Column) -> Column:
    """Position in the model list; decides ties."""
    return F.array_position(F.array(*[F.lit(m) for m in MODELS]), model).cast("int")


def predict_series(histories: DataFrame, season: int, methods: dict = EXACT) -> DataFrame:
    """Long records ``(fold, item_id, ts, step, model, actual, pred)``; ``step`` starts at 0."""
    steps = F.size("ahead")
    made = histories.select(
        "fold", "item_id", "ahead",
        *[fn(F.col("y"), steps, season).alias(f"m{i}") for i, fn in enumerate(methods.values())],
    )
    lanes = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(f"m{i}").alias("values")) for i, name in enumerate(methods)
    ])
    lanes = made.select("fold", "item_id", "ahead", F.explode(lanes).alias("lane"))
    points = lanes.select(
        "fold", "item_id", F.col("lane.model").alias("model"),
        F.posexplode(F.arrays_zip("ahead", F.col("lane.values").alias("pred"))).alias("step", "p"),
    )
    return points.select(
        "fold", "item_id", F.col("p.ahead.ts").alias("ts"), "step", "model",
        F.col("p.ahead.target").alias("actual"), F.col("p.pred").alias("pred"),
    )
