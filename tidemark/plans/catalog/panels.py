"""Panels derived from the given tables, on both sides: DataFrames and SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...operators import cleaning as K
from .registry import table, view

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


def brand_rolled(spark, sf_dir) -> DataFrame:
    """Months of brands: lines are rolled up by part before parts bring in the brand."""
    raw = K.canonicalize(
        table(spark, sf_dir, "lineitem"), date_col="l_shipdate", target_col="l_quantity", item_col="l_partkey",
        drivers=["l_discount", "l_returnflag"], order_by=ORDER,
    )
    states = K.rollup_states(K.drop_invalid(raw), "monthly", ["l_discount"], ["l_returnflag"])
    return K.merge_states(by_part(spark, sf_dir, states, "p_brand"), ["l_discount"], ["l_returnflag"])


def by_part(spark, sf_dir, states: DataFrame, column: str) -> DataFrame:
    """States of parts under a column of the part table; a part without one is unassigned."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.coalesce(column, F.lit("Unassigned")).alias("group")
    )
    return states.join(parts, "item_id").drop("item_id").withColumnRenamed("group", "item_id")


def line_raw(spark, sf_dir, item: str) -> DataFrame:
    return K.canonicalize(
        table(spark, sf_dir, "lineitem"), date_col="l_shipdate", target_col="l_quantity", item_col=item, order_by=ORDER
    )


def rolled(spark, sf_dir, item: str, freq: str = "monthly") -> DataFrame:
    return K.clip_negative(K.period_rollup(K.drop_invalid(line_raw(spark, sf_dir, item)), freq))


def part_panel(spark, sf_dir) -> DataFrame:
    return K.winsorize(K.regularize(K.whole_items(rolled(spark, sf_dir, "l_partkey")), "monthly", "auto"))


def supplier_panel(spark, sf_dir) -> DataFrame:
    return K.winsorize(K.regularize(K.whole_items(rolled(spark, sf_dir, "l_suppkey")), "monthly", "auto"))


def brand_panel(spark, sf_dir) -> DataFrame:
    """Clean brand-month history with one numeric and one text driver."""
    full = K.regularize(brand_rolled(spark, sf_dir), "monthly", "auto", ["l_discount", "l_returnflag"])
    return K.fill_drivers(K.winsorize(full), ["l_discount"], ["l_returnflag"])


def event_panel(spark, sf_dir, item: str = "user_id") -> DataFrame:
    raw = K.canonicalize(
        table(spark, sf_dir, "events"), date_col="ts", target_col="value", item_col=item, order_by=["ts", "event_id"]
    )
    return K.regularize(K.whole_items(K.clip_negative(K.period_rollup(K.drop_invalid(raw), "daily"))), "daily", "auto")


# --- the same panels in SQL ---------------------------------------------------

view("brand_rolled", """
    SELECT p.p_brand AS item_id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS ts,
           sum(l.l_quantity) AS target, avg(l.l_discount) AS l_discount,
           last(l.l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_returnflag,
           count(*) AS source_rows
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
for _name, _col in (("part", "l_partkey"), ("supplier", "l_suppkey")):
    view(f"{_name}_rolled", f"""
    SELECT CAST({_col} AS VARCHAR) AS item_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
           greatest(sum(l_quantity), 0) AS target, count(*) AS source_rows
    FROM lineitem GROUP BY 1, 2""")
view("event_rolled", """
    SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(ts AS DATE) AS ts, greatest(sum(value), 0) AS target
    FROM events GROUP BY 1, 2""")


def _panel_views(name: str, unit: str, strategy: str, suffix: str) -> None:
    """Gap filling by calendar join, on purpose another way than the Spark side."""
    ways = {
        "zero": "CAST(0 AS DOUBLE)",
        "carry": "before_y",
        "interpolate": "before_y + (after_y - before_y) * (date_diff('day', before_ts, ts)::DOUBLE / date_diff('day', before_ts, after_ts))",
    }
    if strategy == "auto":
        gap = f"CASE WHEN zero_share >= 0.2 THEN {ways['zero']} ELSE {ways['interpolate']} END"
        used = "CASE WHEN zero_share >= 0.2 THEN 'zero' ELSE 'interpolate' END"
    else:
        gap, used = ways[strategy], f"'{strategy}'"
    base = f"{name}{suffix}"
    view(f"{base}_spine", f"""
    SELECT item_id, zero_share, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 {unit})) AS DATE) AS ts
    FROM (SELECT item_id, min(ts) AS lo, max(ts) AS hi,
                 avg(CASE WHEN target <= 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_share
          FROM {name}_rolled GROUP BY item_id)""", f"{name}_rolled")
    view(f"{base}_near", f"""
    SELECT s.item_id, s.ts, s.zero_share, r.target AS y,
           last_value(r.target IGNORE NULLS) OVER up AS before_y,
           last_value(r.ts IGNORE NULLS) OVER up AS before_ts,
           first_value(r.target IGNORE NULLS) OVER dn AS after_y,
           first_value(r.ts IGNORE NULLS) OVER dn AS after_ts,
           count(*) OVER (PARTITION BY s.item_id) > count(r.target) OVER (PARTITION BY s.item_id) AS any_gap
    FROM {base}_spine s LEFT JOIN {name}_rolled r ON s.item_id = r.item_id AND s.ts = r.ts
    WINDOW up AS (PARTITION BY s.item_id ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           dn AS (PARTITION BY s.item_id ORDER BY s.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
         f"{base}_spine", f"{name}_rolled")
    view(f"{base}_regular", f"""
    SELECT item_id, ts, CASE WHEN y IS NOT NULL THEN y ELSE {gap} END AS target,
           y IS NULL AS was_imputed, CASE WHEN any_gap THEN {used} END AS strategy_used
    FROM {base}_near""", f"{base}_near")


for _name, _unit in (("brand", "MONTH"), ("part", "MONTH"), ("supplier", "MONTH"), ("event", "DAY")):
    _panel_views(_name, _unit, "auto", "")
for _strategy in ("zero", "carry", "interpolate"):
    _panel_views("part", "MONTH", _strategy, f"_{_strategy}")

for _name in ("brand", "part", "supplier"):
    view(f"{_name}_mid", f"""
    SELECT item_id, quantile_cont(target, 0.5) AS mid, count(*) AS n FROM {_name}_regular GROUP BY item_id""", f"{_name}_regular")
    view(f"{_name}_mad", f"""
    SELECT m.item_id, m.mid, m.n, quantile_cont(abs(r.target - m.mid), 0.5) AS mad
    FROM {_name}_regular r JOIN {_name}_mid m USING (item_id) GROUP BY ALL""", f"{_name}_mid")
    view(f"{_name}_panel", f"""
    SELECT r.item_id, r.ts, r.was_imputed, r.strategy_used,
           CASE WHEN out THEN least(greatest(target, lo), hi) ELSE target END AS target, out AS was_outlier
    FROM (SELECT r.*, greatest(mid - 6.0 * (1.4826 * mad), 0) AS lo, mid + 6.0 * (1.4826 * mad) AS hi,
                 n >= 8 AND mad > 1e-9 AND (target < greatest(mid - 6.0 * (1.4826 * mad), 0) OR target > mid + 6.0 * (1.4826 * mad)) AS out
          FROM {_name}_regular r JOIN {_name}_mad USING (item_id)) r""", f"{_name}_mad")
