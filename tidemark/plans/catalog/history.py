"""Queries on cleaning, calendar and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.periods import add_calendar, working_days
from ...operators import cleaning as K
from . import panels as P
from .registry import query, sql, table, view


@query("period_rollup", sql("SELECT * FROM brand_rolled", "brand_rolled", doubles="target l_discount"))
def _(spark, d):
    return P.brand_rolled(spark, d)


@query("duplicate_rows", sql(
    "SELECT CAST(sum(CASE WHEN source_rows > 1 THEN source_rows ELSE 0 END) AS BIGINT) AS duplicate_rows FROM brand_rolled",
    "brand_rolled"))
def _(spark, d):
    return K.duplicate_rows(P.brand_rolled(spark, d))


for _strategy in ("auto", "carry", "zero", "interpolate"):
    _suffix = "" if _strategy == "auto" else f"_{_strategy}"

    def _fill(spark, d, _s=_strategy):
        return K.regularize(P.rolled(spark, d, "l_partkey"), "monthly", _s)

    query(f"gap_fill_{_strategy}", sql(
        f"SELECT item_id, ts, target, was_imputed, strategy_used FROM part{_suffix}_regular",
        f"part{_suffix}_regular", doubles="target"))(_fill)


@query("winsorize", sql(
    "SELECT item_id, ts, target, was_imputed, strategy_used, was_outlier FROM part_panel", "part_panel", doubles="target"))
def _(spark, d):
    return P.part_panel(spark, d)


view("driver_rolled", """
    SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
           avg(l_tax) AS tax, last(l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS status
    FROM lineitem GROUP BY 1, 2""")
view("driver_spine", """
    SELECT item_id, CAST(unnest(generate_series(CAST(min(ts) AS TIMESTAMP), CAST(max(ts) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ts
    FROM driver_rolled GROUP BY item_id""", "driver_rolled")
view("driver_near", """
    SELECT s.item_id, s.ts, s.i, r.tax, r.status,
           last_value(r.tax IGNORE NULLS) OVER up AS pv, first_value(r.tax IGNORE NULLS) OVER dn AS nv,
           last_value(CASE WHEN r.tax IS NOT NULL THEN s.i END IGNORE NULLS) OVER up AS pi,
           first_value(CASE WHEN r.tax IS NOT NULL THEN s.i END IGNORE NULLS) OVER dn AS ni,
           coalesce(last_value(r.status IGNORE NULLS) OVER up, first_value(r.status IGNORE NULLS) OVER dn, 'Unknown') AS st
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts) AS i FROM driver_spine) s
    LEFT JOIN driver_rolled r ON s.item_id = r.item_id AND s.ts = r.ts
    WINDOW up AS (PARTITION BY s.item_id ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           dn AS (PARTITION BY s.item_id ORDER BY s.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
     "driver_spine", "driver_rolled")


@query("driver_fill", sql("""
    SELECT item_id, ts, CASE WHEN tax IS NOT NULL THEN tax WHEN ni > pi THEN pv + (nv - pv) * (i - pi) / (ni - pi)
                             ELSE coalesce(pv, nv) END AS l_tax, st AS l_linestatus FROM driver_near""",
    "driver_near", doubles="l_tax", digits=10), digits=10)
def _(spark, d):
    raw = K.canonicalize(
        table(spark, d, "lineitem"), date_col="l_shipdate", target_col="l_quantity", item_col="l_partkey",
        drivers=["l_tax", "l_linestatus"], order_by=P.ORDER,
    )
    rolled = K.period_rollup(K.drop_invalid(raw), "monthly", ["l_tax"], ["l_linestatus"])
    full = K.regularize(K.whole_items(rolled), "monthly", "auto", ["l_tax", "l_linestatus"])
    return K.fill_drivers(full, ["l_tax"], ["l_linestatus"]).select("item_id", "ts", "l_tax", "l_linestatus")


@query("driver_types", sql("""
    SELECT 'value_text' AS driver, avg(CASE WHEN try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.8 AS is_numeric, count(*) AS rows FROM events
    UNION ALL
    SELECT 'event_type', avg(CASE WHEN try_cast(event_type AS DOUBLE) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.8, count(*) FROM events"""))
def _(spark, d):
    ev = table(spark, d, "events").select(F.regexp_extract("props", "[0-9]+", 0).alias("value_text"), "event_type")
    typed, numeric, _text = K.coerce_drivers(ev, ["value_text", "event_type"])
    return typed.agg(F.count("*").alias("rows")).select(
        F.explode(F.array(F.lit("value_text"), F.lit("event_type"))).alias("driver"), "rows"
    ).withColumn("is_numeric", F.col("driver").isin(numeric))


@query("history_summary", sql("""
    SELECT count(DISTINCT item_id) AS series, count(*) AS rows, min(ts) AS start, max(ts) AS "end", sum(target) AS total_demand,
           avg(CASE WHEN target = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero_share,
           CAST(sum(CASE WHEN was_imputed THEN 1 ELSE 0 END) AS BIGINT) AS imputed_periods,
           CAST(sum(CASE WHEN was_outlier THEN 1 ELSE 0 END) AS BIGINT) AS outliers_adjusted,
           (SELECT min(c) FROM (SELECT count(*) AS c FROM part_panel GROUP BY item_id)) AS shortest_series,
           round_even(greatest(0, 100.0::DOUBLE - least(35.0::DOUBLE,
               avg(CASE WHEN was_imputed THEN 160.0::DOUBLE ELSE 0.0::DOUBLE END) + avg(CASE WHEN was_outlier THEN 80.0::DOUBLE ELSE 0.0::DOUBLE END))
             - CASE WHEN (SELECT min(c) FROM (SELECT count(*) AS c FROM part_panel GROUP BY item_id)) < 12 THEN 12 ELSE 0 END), 1) AS data_quality_score
    FROM part_panel""", "part_panel", doubles="total_demand zero_share data_quality_score", digits=4), digits=4)
def _(spark, d):
    return K.history_summary(P.part_panel(spark, d))


@query("length_gate", sql("""
    SELECT n AS shortest_series, CASE WHEN n < 6 THEN 'error' WHEN n < 12 THEN 'warning' ELSE 'ok' END AS level
    FROM (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM part_panel GROUP BY item_id))""", "part_panel"))
def _(spark, d):
    return K.length_gate(P.part_panel(spark, d))


@query("cleaning_notes", sql("""
    SELECT 'all' AS scope, 'rows combined within a period' AS note, CAST(sum(source_rows) AS BIGINT) AS n FROM part_rolled WHERE source_rows > 1 HAVING count(*) > 0
    UNION ALL
    SELECT item_id, 'missing periods repaired by ' || max(strategy_used), CAST(sum(CASE WHEN was_imputed THEN 1 ELSE 0 END) AS BIGINT)
    FROM part_panel GROUP BY item_id HAVING bool_or(was_imputed)
    UNION ALL
    SELECT item_id, 'extreme values capped', CAST(sum(CASE WHEN was_outlier THEN 1 ELSE 0 END) AS BIGINT)
    FROM part_panel GROUP BY item_id HAVING bool_or(was_outlier)""", "part_panel", "part_rolled"))
def _(spark, d):
    return K.cleaning_notes(
        table(spark, d, "lineitem"), date_col="l_shipdate", target_col="l_quantity", item_col="l_partkey"
    )


_MONTH = "2 * pi() * {h} * month(ts) / 12.0"
_WEEK = "2 * pi() * {h} * week(ts) / 52.0"
_DAY = "2 * pi() * {h} * dayofyear(ts) / 365.25"


def _waves(angle: str, prefix: str) -> str:
    return ", ".join(
        f"{fn}({angle.format(h=h)}) AS {prefix}{fn}_{h}" for h in (1, 2) for fn in ("sin", "cos")
    )


def _wave_names(prefix: str) -> str:
    return " ".join(f"{prefix}{fn}_{h}" for h in (1, 2) for fn in ("sin", "cos"))


@query("calendar_monthly", sql(f"""
    SELECT item_id, ts, {_waves(_MONTH, 'calendar_')}, month(ts) AS calendar_month, quarter(ts) AS calendar_quarter,
           day(last_day(ts)) AS calendar_days_in_period FROM supplier_rolled""", "supplier_rolled",
    doubles=_wave_names("calendar_") + " calendar_month calendar_quarter calendar_days_in_period"))
def _(spark, d):
    return add_calendar(P.rolled(spark, d, "l_suppkey").select("item_id", "ts"), "monthly")


@query("calendar_weekly", sql(f"""
    SELECT item_id, ts, target, {_waves(_WEEK, 'calendar_')}, week(ts) AS calendar_week, month(ts) AS calendar_month FROM (
      SELECT CAST(l_suppkey AS VARCHAR) AS item_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, sum(l_quantity) AS target
      FROM lineitem GROUP BY 1, 2)""",
    doubles="target " + _wave_names("calendar_") + " calendar_week calendar_month"))
def _(spark, d):
    return add_calendar(P.rolled(spark, d, "l_suppkey", "weekly").select("item_id", "ts", "target"), "weekly")


@query("calendar_daily", sql(f"""
    SELECT item_id, ts, {_waves(_DAY, 'calendar_year_')}, sin(2 * pi() * (isodow(ts) - 1) / 7.0) AS calendar_week_sin,
           cos(2 * pi() * (isodow(ts) - 1) / 7.0) AS calendar_week_cos, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS calendar_is_weekend,
           month(ts) AS calendar_month FROM event_rolled""", "event_rolled",
    doubles=_wave_names("calendar_year_") + " calendar_week_sin calendar_week_cos calendar_is_weekend calendar_month"))
def _(spark, d):
    raw = K.canonicalize(table(spark, d, "events"), date_col="ts", target_col="value", item_col="user_id", order_by=["ts"])
    return add_calendar(K.period_rollup(K.drop_invalid(raw), "daily").select("item_id", "ts"), "daily")


# an order sheet as it might arrive: text dates, text quantities, some of them broken
view("gate_rows", """
    SELECT CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day,
           CASE WHEN l_tax = 0 THEN '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                WHEN l_tax = 0.08 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
           CASE WHEN l_discount = 0.1 THEN ' ' ELSE l_returnflag END AS item
    FROM lineitem""")


def _gate_rows(spark, d):
    qty = F.col("l_quantity").cast("bigint").cast("string")
    return table(spark, d, "lineitem").select(
        F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0), "n/a")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("l_tax") == 0, F.concat(F.lit("-"), qty)).when(F.col("l_tax") == 0.08, None).otherwise(qty).alias("qty"),
        F.when(F.col("l_discount") == 0.1, " ").otherwise(F.col("l_returnflag")).alias("item"),
    )


@query("quality_gate", sql("""
    SELECT 'unreadable_dates' AS rule, count(*) FILTER (WHERE try_cast(day AS DATE) IS NULL) AS violations FROM gate_rows
    UNION ALL SELECT 'missing_quantities', count(*) FILTER (WHERE qty IS NULL) FROM gate_rows
    UNION ALL SELECT 'negative_quantities', count(*) FILTER (WHERE try_cast(qty AS DOUBLE) < 0) FROM gate_rows
    UNION ALL SELECT 'infinite_quantities', 0 FROM (SELECT count(*) FROM gate_rows)
    UNION ALL SELECT 'blank_items', count(*) FILTER (WHERE trim(item) = '') FROM gate_rows
    UNION ALL SELECT unnest(['roles_missing', 'roles_overlap', 'drivers_missing', 'drivers_overlap_roles', 'frequency_domain', 'horizon_domain']), 0""",
    "gate_rows", bigints="violations"))
def _(spark, d):
    return K.quality_gate(_gate_rows(spark, d), {"date_col": "day", "target_col": "qty", "item_col": "item", "horizon": 6})


@query("invalid_rows", sql("""
    SELECT count(*) FILTER (WHERE try_cast(day AS DATE) IS NULL OR qty IS NULL) AS invalid_rows, count(*) AS rows FROM gate_rows""",
    "gate_rows"))
def _(spark, d):
    return K.invalid_rows(K.canonicalize(_gate_rows(spark, d), date_col="day", target_col="qty", item_col="item"))


@query("clip_negative", sql("""
    SELECT item_id, ts, greatest(sum(q), 0) AS target, sum(q) < 0 AS was_negative FROM (
      SELECT CASE WHEN trim(item) = '' THEN ' ' ELSE item END AS item_id, CAST(date_trunc('month', try_cast(day AS DATE)) AS DATE) AS ts,
             try_cast(qty AS DOUBLE) AS q FROM gate_rows WHERE try_cast(day AS DATE) IS NOT NULL AND qty IS NOT NULL) GROUP BY 1, 2""",
    "gate_rows", doubles="target"))
def _(spark, d):
    raw = K.canonicalize(_gate_rows(spark, d), date_col="day", target_col="qty", item_col="item")
    summed = K.period_rollup(K.drop_invalid(raw), "monthly").withColumn("was_negative", F.col("target") < 0)
    return K.clip_negative(summed).select("item_id", "ts", "target", "was_negative")


@query("only_actuals", sql("""
    SELECT l_linestatus AS status, count(*) AS n, sum(l_quantity) AS qty FROM (
      SELECT *, CASE WHEN l_linestatus = 'O' THEN 'Actual' ELSE 'forecast' END AS record_type FROM lineitem)
    WHERE lower(record_type) = 'actual' GROUP BY 1""", doubles="qty"))
def _(spark, d):
    marked = table(spark, d, "lineitem").withColumn(
        "record_type", F.when(F.col("l_linestatus") == "O", "Actual").otherwise("forecast")
    )
    return K.only_actuals(marked).groupBy(F.col("l_linestatus").alias("status")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty")
    )


@query("working_days", sql("""
    SELECT month, count(*) FILTER (WHERE isodow(day) <> 5 AND h.holiday IS NULL) AS working_days FROM (
      SELECT month, CAST(unnest(generate_series(CAST(month AS TIMESTAMP), CAST(last_day(month) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)) d
    LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS holiday FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderpriority = '1-URGENT') = 0) h
      ON d.day = h.holiday GROUP BY month"""))
def _(spark, d):
    orders = table(spark, d, "orders")
    months = orders.select(F.trunc("o_orderdate", "month").alias("month"))
    quiet = (
        orders.groupBy(F.col("o_orderdate").cast("date").alias("holiday"))
        .agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u")).filter("u = 0")
    )
    return working_days(months, quiet)
