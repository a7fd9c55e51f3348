"""Period arithmetic and calendar columns for monthly, weekly and daily panels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .fixed import PERIOD_UNIT, SEASON_LENGTH


def check_frequency(freq: str) -> str:
    if freq not in PERIOD_UNIT:
        raise ValueError(f"frequency must be one of {sorted(PERIOD_UNIT)}, got {freq!r}")
    return freq


def season_length(freq: str) -> int:
    return SEASON_LENGTH[check_frequency(freq)]


def align_period(col: Column, freq: str) -> Column:
    """Start of the period as DATE; weeks start on Monday."""
    unit = PERIOD_UNIT[check_frequency(freq)]
    return col.cast("date") if unit == "day" else F.trunc(col.cast("date"), unit)


def shift_period(col: Column, freq: str, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    unit = PERIOD_UNIT[check_frequency(freq)]
    if unit == "month":
        return F.add_months(col, n)
    return F.date_add(col, n * (7 if unit == "week" else 1))


def period_range(start: Column, end: Column, freq: str) -> Column:
    unit = PERIOD_UNIT[check_frequency(freq)]
    return F.sequence(start, end, F.expr(f"interval 1 {unit}"))


def lag_set(freq: str, n_points: int) -> list[int]:
    """Lags usable for a training panel whose shortest series has ``n_points`` rows."""
    season = season_length(freq)
    wanted = {1: 0, 2: 0, 3: 0, 4: 8, 6: 8, season: season + 6, 2 * season: 2 * season + 4}
    return sorted(lag for lag, need in wanted.items() if n_points >= need and lag < n_points)


def calendar_columns(freq: str, ts: str = "ts") -> dict[str, Column]:
    day = F.col(ts)

    def waves(prefix: str, phase: Column, length: float, harmonics=(1, 2)) -> dict[str, Column]:
        out = {}
        for h in harmonics:
            angle = F.lit(2.0 * math.pi * h) * phase / F.lit(length)
            out[f"{prefix}sin_{h}"] = F.sin(angle)
            out[f"{prefix}cos_{h}"] = F.cos(angle)
        return out

    month = F.month(day).cast("double")
    if check_frequency(freq) == "monthly":
        return {
            **waves("calendar_", month, 12.0),
            "calendar_month": month,
            "calendar_quarter": F.quarter(day).cast("double"),
            "calendar_days_in_period": F.dayofmonth(F.last_day(day)).cast("double"),
        }
    if freq == "weekly":
        week = F.weekofyear(day).cast("double")
        return {**waves("calendar_", week, 52.0), "calendar_week": week, "calendar_month": month}
    weekday = F.weekday(day).cast("double")
    turn = F.lit(2.0 * math.pi) * weekday / F.lit(7.0)
    return {
        **waves("calendar_year_", F.dayofyear(day).cast("double"), 365.25),
        "calendar_week_sin": F.sin(turn),
        "calendar_week_cos": F.cos(turn),
        "calendar_is_weekend": (weekday >= 5).cast("double"),
        "calendar_month": month,
    }


def add_calendar(df: DataFrame, freq: str, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar_columns(freq, ts))


def working_days(months: DataFrame, holidays: DataFrame, weekend=(4,)) -> DataFrame:
    """Working days per month. ``weekend`` lists weekdays, Monday = 0; Friday by default."""
    month = F.trunc(F.col("month").cast("date"), "month")
    days = months.select(month.alias("month")).distinct().select(
        "month", F.explode(F.sequence("month", F.last_day("month"))).alias("day")
    )
    open_days = days.filter(~F.weekday("day").isin(list(weekend)))
    closed = holidays.select(F.col("holiday").cast("date").alias("day")).distinct()
    kept = open_days.join(closed, "day", "left_anti")
    counted = kept.groupBy("month").agg(F.count("*").alias("working_days"))
    return (
        days.select("month").distinct().join(counted, "month", "left")
        .select("month", F.coalesce("working_days", F.lit(0)).cast("bigint").alias("working_days"))
    )
