"""From raw dated quantities to a gapless panel ``item_id, ts, target, drivers..., flags``.

The first step that moves data is the period rollup. It aggregates before its shuffle, so
an item that owns a third of all raw rows still reaches the later per-item windows as at
most one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as C
from ..functions.fixed import (
    AUTO_ZERO_SHARE, MAD_TO_SIGMA, MIN_PERIODS, NUMERIC_SHARE, OUTLIER_MIN_ROWS,
    OUTLIER_SIGMAS, SHORT_PERIODS,
)
from ..functions.periods import align_period, check_frequency, period_range, shift_period
from ..session import stage

STRATEGIES = ("auto", "zero", "interpolate", "carry")
ROW_ORDER = "row_order"
#: Periods with rows that one task takes before its gaps are filled.
TASK_ROWS = 200_000


def only_actuals(df: DataFrame, column: str = "record_type") -> DataFrame:
    """Keep rows marked actual if there are any, else keep everything."""
    if column not in df.columns:
        return df
    actual = F.coalesce(F.lower(F.col(column).cast("string")) == "actual", F.lit(False))
    any_actual = df.select(F.coalesce(F.max(actual), F.lit(False))).scalar()
    return df.filter(actual | ~any_actual)


def canonicalize(
    df: DataFrame,
    *,
    date_col: str,
    target_col: str,
    item_col: str | None = None,
    drivers: list[str] = (),
    order_by: list[str] = (),
) -> DataFrame:
    """Only the needed columns, under their canonical names.

    ``order_by`` names the columns that give file order, which decides the last text value
    of a period. Without it the order of the read is used.
    """
    needed = [c for c in [date_col, target_col, item_col] if c]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    types = {f.name: f.dataType for f in df.schema}
    drivers = [c for c in dict.fromkeys(drivers) if c in types]
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("Unassigned")) if item_col else F.lit("Total demand")
    # only text drivers need the order of rows
    order = F.struct(*order_by) if order_by else F.monotonically_increasing_id()
    return df.select(
        item.alias("item_id"),
        C.to_day(F.col(date_col), types[date_col]).alias("ts"),
        C.number(df, target_col).alias("target"),
        *[F.col(c) for c in drivers],
        *([order.alias(ROW_ORDER)] if drivers else []),
    )


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts").isNotNull() & F.col("target").isNotNull())


def invalid_rows(df: DataFrame) -> DataFrame:
    bad = F.col("ts").isNull() | F.col("target").isNull()
    return df.agg(F.count_if(bad).alias("invalid_rows"), F.count("*").alias("rows"))


def coerce_drivers(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Decide numeric or text for each driver; returns the frame and both name lists.

    A column is numeric if at least 80 % of all rows parse. Only text columns need to be
    measured, with one aggregate that brings back one row.
    """
    columns = [c for c in columns if c in df.columns]
    types = {f.name: f.dataType for f in df.schema}
    unsure = [c for c in columns if C.is_text(types[c])]
    numeric = [c for c in columns if c not in unsure]
    if unsure:
        shares = df.agg(*[F.avg(C.to_number(F.col(c)).isNotNull().cast("double")).alias(c) for c in unsure]).first()
        numeric += [c for c in unsure if (shares[c] or 0.0) >= NUMERIC_SHARE]
    numeric = [c for c in columns if c in numeric]
    text = [c for c in columns if c not in numeric]
    typed = {c: C.number(df, c) for c in numeric}
    typed |= {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in text}
    return (df.withColumns(typed) if typed else df), numeric, text


def period_rollup(df: DataFrame, freq: str, numeric: list[str] = (), text: list[str] = ()) -> DataFrame:
    """Sum the target, average numeric drivers and take the last text driver per period."""
    check_frequency(freq)
    aggs = [F.sum("target").alias("target")]
    aggs += [F.avg(c).alias(c) for c in numeric]
    aggs += [F.max_by(c, ROW_ORDER).alias(c) for c in text]
    return df.groupBy("item_id", align_period(F.col("ts"), freq).alias("ts")).agg(
        *aggs, F.count("*").alias("source_rows")
    )


def rollup_states(df: DataFrame, freq: str, numeric: list[str] = (), text: list[str] = ()) -> DataFrame:
    """What ``period_rollup`` needs of each item and period, as sums and newest values that merge.

    Roll raw rows up by their own key, join the few states to what groups the keys, and merge: the
    raw rows themselves are never joined.
    """
    check_frequency(freq)
    aggs = [F.sum("target").alias("target"), F.count("*").alias("source_rows")]
    for c in numeric:
        aggs += [F.sum(F.col(c).cast("double")).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n")]
    aggs += [F.max_by(c, ROW_ORDER).alias(c) for c in text]
    aggs += [F.max(ROW_ORDER).alias(ROW_ORDER)] if text else []
    return df.groupBy("item_id", align_period(F.col("ts"), freq).alias("ts")).agg(*aggs)


def _steady_sum(c: str) -> Column:
    """Sum in fixed point plus what that leaves over, so that the order of merging does not show in the result."""
    fixed = F.col(c).try_cast("decimal(28,12)")
    rest = F.col(c) - F.coalesce(fixed.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(fixed).cast("double"), F.lit(0.0)) + F.sum(rest)


def merge_states(states: DataFrame, numeric: list[str] = (), text: list[str] = ()) -> DataFrame:
    """States of several keys under one ``item_id``, merged to the rows of ``period_rollup``."""
    aggs = [F.sum("target").alias("target")]
    aggs += [(_steady_sum(f"{c}__sum") / F.nullif(F.sum(f"{c}__n"), F.lit(0))).alias(c) for c in numeric]
    aggs += [F.max_by(c, ROW_ORDER).alias(c) for c in text]
    return states.groupBy("item_id", "ts").agg(*aggs, F.sum("source_rows").alias("source_rows"))


def duplicate_rows(rolled: DataFrame) -> DataFrame:
    """Source rows that shared their item and period with another row."""
    n = F.col("source_rows")
    return rolled.agg(F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def clip_negative(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("target", F.greatest("target", F.lit(0.0)))


def negative_rows(rolled: DataFrame) -> DataFrame:
    return rolled.agg(F.count_if(F.col("target") < 0).alias("negative_rows"))


def _gap_value(strategy: str) -> Column:
    days = F.datediff("__day", "ts") / F.datediff("__next_ts", "ts")
    ways = {
        "zero": F.lit(0.0),
        "carry": F.col("target"),
        "interpolate": F.col("target") + (F.col("__next") - F.col("target")) * days,
    }
    if strategy != "auto":
        return ways[strategy]
    return F.when(F.col("__zeros") >= AUTO_ZERO_SHARE, ways["zero"]).otherwise(ways["interpolate"])


def whole_items(rolled: DataFrame, *keys: str) -> DataFrame:
    """Items, or other ``keys``, whole in as many partitions as the rows need, for the windows per item that follow.

    Filling gaps multiplies rows and every window sorts them, so shuffled bytes say little of the memory
    that a task needs; here more rows make more tasks, not larger ones.
    """
    held = stage(rolled, "rolled")
    tasks = max(-(-held.count() // TASK_ROWS), held.sparkSession.sparkContext.defaultParallelism)
    return held.repartition(tasks, *(keys or ["item_id"]))


def regularize(rolled: DataFrame, freq: str, strategy: str = "auto", drivers: list[str] = ()) -> DataFrame:
    """Insert every missing period between an item's first and last observation.

    Each observation carries its successor, so it can emit itself and the periods up to the
    next one. That needs one window and no join with a calendar.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    w = W.partitionBy("item_id").orderBy("ts")
    item = W.partitionBy("item_id")
    seen = (
        rolled.select("item_id", "ts", F.col("target").cast("double").alias("target"), *drivers)
        .withColumn("__next_ts", F.lead("ts").over(w))
        .withColumn("__next", F.lead("target").over(w))
        .withColumn("__zeros", F.avg(C.is_zero(F.col("target")).cast("double")).over(item))
        .withColumn("__gap", F.col("__next_ts") > shift_period(F.col("ts"), freq, 1))
        .withColumn("__any_gap", F.max(F.coalesce("__gap", F.lit(False))).over(item))
    )
    last_day = F.coalesce(shift_period(F.col("__next_ts"), freq, -1), F.col("ts"))
    spread = seen.withColumn("__day", F.explode(period_range(F.col("ts"), last_day, freq)))
    imputed = F.col("__day") != F.col("ts")
    used = F.lit(strategy)
    if strategy == "auto":
        used = F.when(F.col("__zeros") >= AUTO_ZERO_SHARE, "zero").otherwise("interpolate")
    return spread.select(
        "item_id",
        F.col("__day").alias("ts"),
        F.when(imputed, _gap_value(strategy)).otherwise(F.col("target")).alias("target"),
        *[F.when(~imputed, F.col(c)).alias(c) for c in drivers],
        imputed.alias("was_imputed"),
        F.when(F.col("__any_gap"), used).alias("strategy_used"),
    )


def winsorize(panel: DataFrame) -> DataFrame:
    """Cap values beyond median +- 6 robust sigmas; needs 8 rows and a nonzero spread."""
    item = W.partitionBy("item_id")
    marked = (
        panel.withColumn("__mid", F.percentile("target", F.lit(0.5)).over(item))
        .withColumn("__dev", F.abs(F.col("target") - F.col("__mid")))
        .withColumn("__mad", F.percentile("__dev", F.lit(0.5)).over(item))
        .withColumn("__n", F.count("*").over(item))
    )
    reach = F.lit(OUTLIER_SIGMAS) * (F.lit(MAD_TO_SIGMA) * F.col("__mad"))
    low, high = F.greatest(F.lit(0.0), F.col("__mid") - reach), F.col("__mid") + reach
    active = (F.col("__n") >= OUTLIER_MIN_ROWS) & ~C.is_zero(F.col("__mad"))
    outside = active & ((F.col("target") < low) | (F.col("target") > high))
    return marked.withColumns(
        {
            "was_outlier": outside,
            "target": F.when(outside, F.least(F.greatest(F.col("target"), low), high)).otherwise(F.col("target")),
        }
    ).drop("__mid", "__dev", "__mad", "__n")


def fill_drivers(panel: DataFrame, numeric: list[str] = (), text: list[str] = ()) -> DataFrame:
    """Linear fill by row position for numbers, nearest earlier then later value for text."""
    if not numeric and not text:
        return panel
    up = W.partitionBy("item_id").orderBy("ts")
    down = W.partitionBy("item_id").orderBy(F.desc("ts"))
    work = panel.withColumn("__i", F.row_number().over(up))
    back = {}
    for c in [*numeric, *text]:
        back[f"__pv_{c}"] = F.last(c, ignorenulls=True).over(up)
    for c in numeric:
        back[f"__pi_{c}"] = F.last(F.when(F.col(c).isNotNull(), F.col("__i")), ignorenulls=True).over(up)
    work = work.withColumns(back)
    ahead = {}
    for c in [*numeric, *text]:
        ahead[f"__nv_{c}"] = F.last(c, ignorenulls=True).over(down)
    for c in numeric:
        ahead[f"__ni_{c}"] = F.last(F.when(F.col(c).isNotNull(), F.col("__i")), ignorenulls=True).over(down)
    work = work.withColumns(ahead)
    filled = {}
    for c in numeric:
        pv, nv, pi, ni = (F.col(f"__{k}_{c}") for k in ("pv", "nv", "pi", "ni"))
        between = pv + (nv - pv) * (F.col("__i") - pi) / F.nullif(ni - pi, F.lit(0))
        filled[c] = F.coalesce(F.col(c).cast("double"), between, pv, nv)
    for c in text:
        filled[c] = F.coalesce(F.col(c), F.col(f"__pv_{c}"), F.col(f"__nv_{c}"), F.lit("Unknown"))
    return work.withColumns(filled).select(*panel.columns)


def prepare_history(
    df: DataFrame,
    *,
    date_col: str,
    target_col: str,
    item_col: str | None = None,
    drivers: list[str] = (),
    order_by: list[str] = (),
    freq: str = "monthly",
    missing: str = "auto",
    outliers: str = "winsorize",
) -> DataFrame:
    """The whole cleaning path; check the result with ``length_gate``."""
    if outliers not in ("none", "winsorize"):
        raise ValueError("outliers must be none or winsorize")
    raw = canonicalize(
        only_actuals(df), date_col=date_col, target_col=target_col, item_col=item_col,
        drivers=drivers, order_by=order_by,
    )
    typed, numeric, text = coerce_drivers(drop_invalid(raw), list(drivers))
    rolled = whole_items(clip_negative(period_rollup(typed, freq, numeric, text)))
    panel = regularize(rolled, freq, missing, [*numeric, *text])
    panel = winsorize(panel) if outliers == "winsorize" else panel.withColumn("was_outlier", F.lit(False))
    return fill_drivers(panel, numeric, text)


def cleaning_notes(
    df: DataFrame, *, date_col: str, target_col: str, item_col: str | None = None, freq: str = "monthly",
    missing: str = "auto", outliers: str = "winsorize",
) -> DataFrame:
    """What cleaning changed, as rows ``(scope, note, n)``; no item list reaches the driver."""
    raw = canonicalize(only_actuals(df), date_col=date_col, target_col=target_col, item_col=item_col)
    rolled = period_rollup(drop_invalid(raw), freq)
    panel = regularize(clip_negative(rolled), freq, missing)
    panel = winsorize(panel) if outliers == "winsorize" else panel.withColumn("was_outlier", F.lit(False))
    everything = F.lit("all").alias("scope")
    parts = [
        invalid_rows(raw).select(everything, F.lit("invalid rows removed").alias("note"), F.col("invalid_rows").alias("n")),
        duplicate_rows(rolled).select(everything, F.lit("rows combined within a period").alias("note"), F.col("duplicate_rows").alias("n")),
        negative_rows(rolled).select(everything, F.lit("negative values clipped").alias("note"), F.col("negative_rows").alias("n")),
        panel.groupBy("item_id").agg(F.count_if("was_imputed").alias("n"), F.max("strategy_used").alias("s"))
        .select(F.col("item_id").alias("scope"), F.concat(F.lit("missing periods repaired by "), "s").alias("note"), "n"),
        panel.groupBy("item_id").agg(F.count_if("was_outlier").alias("n"))
        .select(F.col("item_id").alias("scope"), F.lit("extreme values capped").alias("note"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("n > 0")


def history_summary(panel: DataFrame) -> DataFrame:
    """One row on size, span, gaps and the data quality score."""
    flag = lambda name: F.count_if(name) if name in panel.columns else F.lit(0).cast("bigint")
    per_item = panel.groupBy("item_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.sum("target").alias("total"), F.count_if(F.col("target") == 0).alias("zeros"),
        flag("was_imputed").alias("imputed"), flag("was_outlier").alias("outliers"),
    )
    total = per_item.agg(
        F.count("*").alias("series"), F.sum("n").alias("rows"),
        F.min("first").alias("start"), F.max("last").alias("end"),
        F.sum("total").alias("total_demand"), (F.sum("zeros") / F.sum("n")).alias("zero_share"),
        F.sum("imputed").cast("bigint").alias("imputed_periods"),
        F.sum("outliers").cast("bigint").alias("outliers_adjusted"),
        F.min("n").alias("shortest_series"),
    )
    penalty = F.least(
        F.lit(35.0),
        F.col("imputed_periods") / F.col("rows") * 160.0 + F.col("outliers_adjusted") / F.col("rows") * 80.0,
    ) + F.when(F.col("shortest_series") < SHORT_PERIODS, 12.0).otherwise(0.0)
    return total.withColumn("data_quality_score", F.bround(F.greatest(F.lit(0.0), 100.0 - penalty), 1))


def length_gate(panel: DataFrame) -> DataFrame:
    """``error`` below 6 periods, ``warning`` below 12, judged by the shortest series."""
    shortest = panel.groupBy("item_id").count().agg(F.min("count").alias("shortest_series"))
    n = F.col("shortest_series")
    return shortest.withColumn(
        "level", F.when(n < MIN_PERIODS, "error").when(n < SHORT_PERIODS, "warning").otherwise("ok")
    )


def _typed(df: DataFrame, name: str) -> Column:
    return C.to_day(F.col(name), df.schema[name].dataType)


def quality_gate(df: DataFrame, settings: dict) -> DataFrame:
    """Strict input gate: one row ``(rule, violations)`` per rule, from one pass."""
    df = only_actuals(df)
    date_col, target_col, item_col = (settings.get(k) for k in ("date_col", "target_col", "item_col"))
    chosen = [c for c in (date_col, target_col, item_col) if c]
    drivers = list(settings.get("drivers", []))
    static = {
        "roles_missing": int(not date_col or not target_col) + sum(c not in df.columns for c in chosen),
        "roles_overlap": len(chosen) - len(set(chosen)),
        "drivers_missing": sum(c not in df.columns for c in drivers),
        "drivers_overlap_roles": len(set(drivers) & set(chosen)),
        "frequency_domain": int(settings.get("frequency", "monthly") not in ("monthly", "weekly", "daily")),
        "horizon_domain": int(not 1 <= int(settings.get("horizon", 6)) <= 24),
    }
    if settings.get("operations"):
        static["operations_monthly"] = int(settings.get("frequency", "monthly") != "monthly")
        static["operations_unit"] = int(settings.get("unit") != "tonnes")
        static["operations_line_missing"] = int("production_line" not in df.columns)
    counts = {name: F.lit(n).cast("bigint") for name, n in static.items()}
    if date_col in df.columns:
        counts["unreadable_dates"] = F.count_if(_typed(df, date_col).isNull())
    if target_col in df.columns:
        value = C.number(df, target_col)
        counts["missing_quantities"] = F.count_if(value.isNull())
        counts["negative_quantities"] = F.count_if(value < 0)
        counts["infinite_quantities"] = F.count_if(value == F.lit(float("inf")))
    if item_col in df.columns:
        counts["blank_items"] = F.count_if(F.coalesce(F.trim(F.col(item_col).cast("string")), F.lit("")) == "")
    if settings.get("operations") and "production_line" in df.columns:
        counts["operations_line_blank"] = F.count_if(F.col("production_line").isNull())
    one = df.agg(*[c.alias(name) for name, c in counts.items()])
    return one.unpivot([], list(counts), "rule", "violations")


def canonical_head(panel: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` cleaned rows, as a review shows them."""
    return panel.select("item_id", "ts", "target").orderBy("item_id", "ts").limit(n)
