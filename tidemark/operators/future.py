"""Future rows of every item: next periods, driver values and where they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..functions.fixed import MAX_HORIZON, NUMERIC_SHARE
from ..functions.periods import add_calendar, align_period, shift_period
from .cleaning import coerce_drivers

POLICIES = ("require", "carry", "median")


def future_spine(history: DataFrame, freq: str, horizon: int, *extra) -> DataFrame:
    """``horizon`` periods after each item's own last date; ``step`` starts at 1."""
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {MAX_HORIZON}")
    last = history.groupBy("item_id").agg(F.max("ts").alias("__last"), *extra)
    stepped = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return stepped.withColumn("ts", shift_period(F.col("__last"), freq, F.col("step"))).drop("__last")


def _given(future: DataFrame, date_col: str, item_col: str | None, drivers: list[str], freq: str) -> tuple[DataFrame, list[str]]:
    """Provided rows under canonical keys; a period may occur once per key."""
    for name in [date_col, item_col]:
        if name and name not in future.columns:
            raise ValueError(f"future table has no column {name!r}")
    day = C.to_day(F.col(date_col), future.schema[date_col].dataType)
    keys = ["ts"] + (["item_id"] if item_col else [])
    rows = future.withColumn("__ts", align_period(day, freq))
    if item_col:
        rows = rows.withColumn("__item", F.col(item_col).cast("string"))
    kept = [c for c in drivers if c in future.columns]
    rows, _numeric, _text = coerce_drivers(rows, kept)
    rows = rows.select(
        F.col("__ts").alias("ts"), *([F.col("__item").alias("item_id")] if item_col else []),
        *[F.col(c).alias(f"__given_{c}") for c in kept],
    )
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    problems = counted.agg(
        F.coalesce(F.max(F.col("ts").isNull()), F.lit(False)).alias("unreadable"),
        F.coalesce(F.max(F.col("n") > 1), F.lit(False)).alias("repeated"),
    ).first()
    if problems["unreadable"]:
        raise ValueError("future factors contain unreadable dates")
    if drivers and problems["repeated"]:
        raise ValueError("future factors need one row per item and period")
    return rows, keys


def future_covariates(
    history: DataFrame,
    future: DataFrame | None = None,
    *,
    drivers: list[str] = (),
    freq: str = "monthly",
    horizon: int = 6,
    policy: str = "require",
    date_col: str | None = None,
    item_col: str | None = None,
    known_ahead: list[str] | None = None,
    calendar: bool = True,
) -> DataFrame:
    """Next periods with drivers; ``<driver>_source`` says provided, assumed or missing.

    ``require`` accepts no gaps, ``carry`` repeats the last observation and ``median`` uses
    the item's median, or its most frequent value for text. ``known_ahead`` names the drivers whose given
    values count; names that are not among ``drivers`` are passed over, and None stands for all of them.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    drivers = list(dict.fromkeys(drivers))
    known = [c for c in drivers if c in history.columns]
    facts = []
    for c in known:
        value = F.col(c)
        if policy == "carry":
            facts.append(F.max_by(value, F.when(value.isNotNull(), F.col("ts"))).alias(f"__fill_{c}"))
        elif policy == "median":
            number = C.number(history, c)
            middle = F.percentile(number, F.lit(0.5))
            common = F.expr(f"mode() WITHIN GROUP (ORDER BY `{c}`)")
            if C.is_text(history.schema[c].dataType):
                middle = middle.cast("string")
            share = F.avg(number.isNotNull().cast("double"))
            facts.append(F.when(share >= NUMERIC_SHARE, middle).otherwise(common).alias(f"__fill_{c}"))
    spine = future_spine(history, freq, horizon, *facts)
    given: list[str] = []
    if future is not None and date_col:
        taken = drivers if known_ahead is None else [c for c in drivers if c in known_ahead]
        rows, keys = _given(future, date_col, item_col, taken, freq)
        given = [c.removeprefix("__given_") for c in rows.columns if c.startswith("__given_")]
        spine = spine.join(rows, keys, "left")
    out = {}
    for c in drivers:
        dtype = history.schema[c].dataType if c in known else None
        provided = F.col(f"__given_{c}") if c in given else F.lit(None)
        if dtype is not None:
            provided = provided.cast(dtype)
        fill = F.lit(None)
        if policy != "require":
            zero = F.lit(0.0) if dtype is None else F.lit(0).cast(dtype)
            fill = F.coalesce(F.col(f"__fill_{c}"), zero) if c in known else zero
        out[c] = F.coalesce(provided, fill) if dtype is None else F.coalesce(provided, fill.cast(dtype))
        out[f"{c}_source"] = F.when(provided.isNotNull(), "provided").otherwise(
            "missing" if policy == "require" else "assumed"
        )
    rows = spine.withColumns(out) if out else spine
    rows = rows.select("item_id", "ts", "step", *out)
    if policy == "require" and drivers:
        _refuse_missing(rows, drivers)
    return add_calendar(rows, freq) if calendar else rows


def _refuse_missing(rows: DataFrame, drivers: list[str]) -> None:
    gaps = rows.select("item_id", "ts", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"{c}_source") == "missing", F.lit(c)) for c in drivers
    ]))).alias("driver"))
    some = gaps.orderBy("item_id", "ts", "driver").limit(8).collect()
    if some:
        examples = "; ".join(f"{r.driver} · {r.item_id} · {r.ts}" for r in some)
        raise ValueError(
            "Future values are missing for selected drivers. Provide them, choose an assumption "
            f"policy or remove the drivers. Examples: {examples}"
        )


def driver_coverage(future: DataFrame, drivers: list[str], policy: str) -> DataFrame:
    """Expected, provided and assumed values per driver, from one pass."""
    counts = [F.count("*").alias("expected")]
    for c in drivers:
        for word in ("provided", "assumed"):
            counts.append(F.count_if(F.col(f"{c}_source") == word).alias(f"{word}_{c}"))
    one = future.agg(*counts)
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("driver"), F.col(f"provided_{c}").alias("provided"), F.col(f"assumed_{c}").alias("assumed"))
        for c in drivers
    ]))
    rows = one.select("expected", each.alias("d")).select("d.driver", "expected", "d.provided", "d.assumed")
    pct = F.bround(F.col("provided") / F.greatest("expected", F.lit(1)) * 100.0, 1)
    return rows.withColumns({"policy": F.lit(policy), "coverage_pct": pct})


def lowest_coverage(coverage: DataFrame) -> DataFrame:
    """The coverage of the driver that is given least; null without drivers."""
    return coverage.agg(F.min("coverage_pct").alias("lowest_coverage_pct"))


def export_rows(forecast: DataFrame, future: DataFrame, drivers: list[str]) -> DataFrame:
    """Forecast rows with the driver values they assumed."""
    return forecast.join(future.select("item_id", "ts", *drivers), ["item_id", "ts"], "left")
