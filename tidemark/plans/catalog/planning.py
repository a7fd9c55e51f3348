"""Queries on future rows, hierarchy, supply, scenarios, monitoring and the plan ledger.

The operations tables, runs, plans and overrides are derived from the given tables, so they
grow with them.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ...functions.fixed import PLAN_STATES
from ...operators import baselines as B
from ...operators import cleaning as K
from ...operators import exceptions as Q
from ...operators import folds as D
from ...operators import future as U
from ...operators import ledger as L
from ...operators import metrics as M
from ...operators import monitoring as O
from ...operators import profiles as R
from ...operators import rollups as V
from ...operators import scenarios as C
from ...operators import supply as Y
from ...session import stage
from ...sources.sinks import run_list
from . import panels as P
from .modelling import H, S, _METRICS, forecast_views, fold_views
from .registry import query, sql, table, view

NAIVE = {"Seasonal naive": B.EXACT["Seasonal naive"]}

# --- derived inputs ------------------------------------------------------------------


def plain_forecast(spark, d, item: str = "part"):
    """Next six months by the seasonal naive rule with a flat range."""
    panel = P.part_panel(spark, d) if item == "part" else P.supplier_panel(spark, d)
    made = B.predict_series(D.final_histories(panel.select("item_id", "ts", "target"), "monthly", H), S, NAIVE)
    mean = F.col("pred")
    return made.select(
        "item_id", "ts", mean.alias("baseline_mean"), mean.alias("mean"), (mean * 0.75).alias("p10"),
        mean.alias("p50"), (mean * 1.5).alias("p90"),
    )


fold_views("supplier", H)
view("supplierf_hist", f"SELECT 0 AS fold, item_id, list(target ORDER BY ts) AS y, {H} AS m, max(ts) AS last FROM supplier_panel GROUP BY item_id", "supplier_panel")
view("supplierf_valid", f"""
    SELECT 0 AS fold, item_id, CAST(CAST(last AS TIMESTAMP) + to_months(CAST(k AS INTEGER)) AS DATE) AS ts, NULL::DOUBLE AS actual, k
    FROM (SELECT *, unnest(range(1, {H + 1})) AS k FROM supplierf_hist)""", "supplierf_hist")
from .modelling import model_views  # noqa: E402

model_views("supplierf")
for _n in ("part", "supplier"):
    view(f"{_n}_plain", f"""
    SELECT v.item_id, v.ts, greatest(n.pred, 0) AS baseline_mean, greatest(n.pred, 0) AS mean, greatest(n.pred, 0) * 0.75::DOUBLE AS p10,
           greatest(n.pred, 0) AS p50, greatest(n.pred, 0) * 1.5::DOUBLE AS p90
    FROM {_n}f_valid v JOIN {_n}f_naive n USING (fold, item_id, k)""", f"{_n}f_valid", f"{_n}f_naive")


_LAST = ["l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity"]


def item_rows(spark, d):
    """The last line of every part with the part's own columns."""
    last = V.last_rows(table(spark, d, "lineitem"), "l_partkey", P.ORDER, _LAST)
    parts = table(spark, d, "part")
    return last.join(parts, last.l_partkey == parts.p_partkey).select(
        "*", F.col("p_type").alias("production_line"), F.col("l_returnflag").alias("warehouse"),
        (F.col("l_extendedprice") / 512).alias("inventory_on_hand_tonnes"),
        (F.col("p_size") * 0.5).alias("safety_stock_tonnes"),
        (F.col("l_quantity") * 1.25).alias("monthly_capacity_tonnes"),
        F.col("p_retailprice").alias("unit_cost_irr"),
    )


def metadata(spark, d):
    return V.series_metadata(
        item_rows(spark, d), item_col="l_partkey", sku_col="p_brand", category_col="p_type",
        customer_col="l_linestatus", order_by=["l_partkey"],
    )


view("part_meta", """
    SELECT CAST(l_partkey AS VARCHAR) AS item_id, p_brand AS sku, p_type AS category, l_linestatus AS customer, l_returnflag AS warehouse,
           p_type AS production_line, l_extendedprice / 512 AS inventory_on_hand_tonnes, p_size * 0.5::DOUBLE AS safety_stock_tonnes,
           l_quantity * 1.25::DOUBLE AS monthly_capacity_tonnes, p_retailprice AS unit_cost_irr
    FROM lineitem JOIN part ON l_partkey = p_partkey
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
_META_DOUBLES = "inventory_on_hand_tonnes safety_stock_tonnes monthly_capacity_tonnes unit_cost_irr"


def operations(spark, d):
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    material = F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("material_id")
    bom = part.groupBy(F.col("p_brand").alias("sku"), material).agg(
        (F.avg("p_retailprice") / 1024).alias("quantity_per_tonne"), F.count("*").cast("double").alias("scrap_pct")
    )
    materials = part.groupBy(material, "p_size").agg(
        F.concat(F.lit("Material "), F.col("p_size").cast("string")).alias("material_name"),
        F.max("p_type").alias("supplier"), F.lit("kg").alias("unit"),
        (F.sum("p_retailprice") / 16).alias("inventory_on_hand"), F.avg("p_retailprice").alias("safety_stock"),
        (F.col("p_size") + 0.5).alias("lead_time_days"),
        F.when(F.col("p_size") < 10, 0.0).otherwise(F.col("p_size") * 16.0).alias("moq"),
        F.count("*").cast("double").alias("quality_hold_qty"),
    ).drop("p_size")
    status = F.when(F.col("o_orderstatus") == "F", "Received").when(F.col("o_orderstatus") == "P", "open")
    open_pos = orders.select(
        F.concat(F.lit("M"), (F.floor(F.col("o_totalprice")) % 50 + 1).cast("string")).alias("material_id"),
        status.alias("status"), F.add_months(F.col("o_orderdate").cast("date"), 36).alias("due_date"),
        (F.col("o_totalprice") / 65536).alias("quantity"),
    )
    month = F.trunc("l_shipdate", "month").alias("month")
    shipped = table(spark, d, "lineitem").groupBy("l_partkey", month).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    capacity = shipped.join(part, shipped.l_partkey == part.p_partkey).groupBy(
        F.col("p_type").alias("production_line"), F.add_months("month", 12).alias("period")
    ).agg((F.sum("quantity") * 0.875).alias("available_tonnes"), F.sum("lines").cast("double").alias("planned_downtime_hours"))
    return {"bom": bom, "materials": materials, "open_pos": open_pos, "capacity": capacity}


view("bom", "SELECT p_brand AS sku, 'M' || p_size AS material_id, avg(p_retailprice) / 1024 AS quantity_per_tonne, count(*)::DOUBLE AS scrap_pct FROM part GROUP BY 1, 2")
view("materials", """
    SELECT 'M' || p_size AS material_id, 'Material ' || p_size AS material_name, max(p_type) AS supplier, 'kg' AS unit,
           sum(p_retailprice) / 16 AS inventory_on_hand, avg(p_retailprice) AS safety_stock, p_size + 0.5::DOUBLE AS lead_time_days,
           CASE WHEN p_size < 10 THEN 0 ELSE p_size * 16.0::DOUBLE END AS moq, count(*)::DOUBLE AS quality_hold_qty FROM part GROUP BY p_size""")
view("open_pos", """
    SELECT 'M' || (CAST(floor(o_totalprice) AS BIGINT) % 50 + 1) AS material_id,
           CASE o_orderstatus WHEN 'F' THEN 'Received' WHEN 'P' THEN 'open' END AS status,
           CAST(o_orderdate + to_months(36) AS DATE) AS due_date, o_totalprice / 65536 AS quantity FROM orders""")
view("capacity", """
    SELECT p_type AS production_line, CAST(date_trunc('month', l_shipdate) + to_months(12) AS DATE) AS period,
           sum(l_quantity) * 0.875::DOUBLE AS available_tonnes, count(*)::DOUBLE AS planned_downtime_hours
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")

# --- future rows -------------------------------------------------------------------------

view("future_facts", """
    SELECT item_id, max(ts) AS last, last(l_discount ORDER BY ts) AS c_discount, quantile_cont(l_discount, 0.5) AS m_discount,
           last(l_returnflag ORDER BY ts) AS c_flag, mode(l_returnflag ORDER BY l_returnflag) AS m_flag FROM brand_rolled GROUP BY item_id""", "brand_rolled")
view("future_given", """
    SELECT CAST(date_trunc('month', l_shipdate) + to_months(1) AS DATE) AS ts, p_brand AS item_id, avg(l_tax) AS l_discount
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '2001-09-01' GROUP BY 1, 2""")
view("future_steps", f"""
    SELECT *, CAST(CAST(last AS TIMESTAMP) + to_months(CAST(step AS INTEGER)) AS DATE) AS ts FROM (
      SELECT *, unnest(range(1, {H + 1})) AS step FROM future_facts)""", "future_facts")


def _given(spark, d):
    late = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= "2001-09-01")
    raw = K.canonicalize(late, date_col="l_shipdate", target_col="l_quantity", item_col="l_partkey", drivers=["l_tax"])
    merged = K.merge_states(P.by_part(spark, d, K.rollup_states(raw, "monthly", ["l_tax"]), "p_brand"), ["l_tax"])
    return merged.select(F.add_months("ts", 1).alias("day"), F.col("item_id").alias("brand"), F.col("l_tax").alias("l_discount"))


def _future(spark, d, policy, **more):
    return U.future_covariates(
        P.brand_panel(spark, d), _given(spark, d), drivers=["l_discount", "l_returnflag"], freq="monthly", horizon=H,
        policy=policy, date_col="day", item_col="brand", calendar=False, **more,
    )


for _policy, _p in (("carry", "c"), ("median", "m")):
    query(f"future_{_policy}", sql(f"""
    SELECT s.item_id, s.ts, s.step, coalesce(g.l_discount, s.{_p}_discount) AS l_discount,
           CASE WHEN g.l_discount IS NULL THEN 'assumed' ELSE 'provided' END AS l_discount_source,
           s.{_p}_flag AS l_returnflag, 'assumed' AS l_returnflag_source
    FROM future_steps s LEFT JOIN future_given g USING (item_id, ts)""", "future_steps", "future_given", doubles="l_discount", digits=10),
          digits=10)(lambda spark, d, _q=_policy: _future(spark, d, _q))


@query("future_known", sql("""
    SELECT item_id, ts, step, c_discount AS l_discount, 'assumed' AS l_discount_source, c_flag AS l_returnflag, 'assumed' AS l_returnflag_source
    FROM future_steps""", "future_steps", doubles="l_discount", digits=10), digits=10)
def _(spark, d):
    """A given driver that is not named as known is assumed, and a name that is no driver changes nothing."""
    return _future(spark, d, "carry", known_ahead=["l_returnflag", "l_tax"])


@query("lowest_coverage", sql("""
    SELECT least(avg(0.0::DOUBLE), round_even(count(g.l_discount) * 100.0::DOUBLE / count(*), 1)) AS lowest_coverage_pct
    FROM future_steps s LEFT JOIN future_given g USING (item_id, ts)""", "future_steps", "future_given"))
def _(spark, d):
    return U.lowest_coverage(U.driver_coverage(_future(spark, d, "carry"), ["l_discount", "l_returnflag"], "carry"))


@query("driver_coverage", sql(f"""
    SELECT driver, count(*) AS expected, count(*) FILTER (WHERE ok) AS provided, count(*) FILTER (WHERE NOT ok) AS assumed, 'carry' AS policy,
           round_even(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*), 1) AS coverage_pct FROM (
      SELECT 'l_discount' AS driver, g.l_discount IS NOT NULL AS ok FROM future_steps s LEFT JOIN future_given g USING (item_id, ts)
      UNION ALL SELECT 'l_returnflag', false FROM future_steps) GROUP BY driver""", "future_steps", "future_given"))
def _(spark, d):
    return U.driver_coverage(_future(spark, d, "carry"), ["l_discount", "l_returnflag"], "carry")


@query("export_rows", sql("""
    SELECT f.*, CAST(g.c_discount AS DOUBLE) AS l_discount FROM (
      SELECT v.item_id, v.ts, sum(n.pred) AS mean FROM brandf_valid v JOIN brandf_naive n USING (fold, item_id, k) GROUP BY 1, 2) f
    JOIN (SELECT s.item_id, s.ts, coalesce(g.l_discount, s.c_discount) AS c_discount FROM future_steps s LEFT JOIN future_given g USING (item_id, ts)) g USING (item_id, ts)""",
    "brandf_valid", "brandf_naive", "future_steps", "future_given", doubles="mean l_discount"))
def _(spark, d):
    panel = P.brand_panel(spark, d).select("item_id", "ts", "target")
    made = B.predict_series(D.final_histories(panel, "monthly", H), S, NAIVE).select("item_id", "ts", F.col("pred").alias("mean"))
    return U.export_rows(made, _future(spark, d, "carry"), ["l_discount"])


# --- hierarchy ----------------------------------------------------------------------------


@query("series_metadata", sql("SELECT * FROM part_meta", "part_meta", doubles=_META_DOUBLES))
def _(spark, d):
    return metadata(spark, d)


@query("dimensions", sql("""
    SELECT DISTINCT * FROM (SELECT 'category' AS dimension, category AS member FROM part_meta
      UNION ALL SELECT 'customer', customer FROM part_meta UNION ALL SELECT 'sku', sku FROM part_meta)""", "part_meta"))
def _(spark, d):
    return V.dimensions(metadata(spark, d))


def supplier_meta(spark, d):
    sup, nat, reg = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = sup.join(nat, sup.s_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
    return joined.select(F.col("s_suppkey").cast("string").alias("item_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


view("supplier_meta", """
    SELECT CAST(s_suppkey AS VARCHAR) AS item_id, n_name AS nation, r_name AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
_SUMS = "sum(baseline_mean) AS baseline_mean, sum(mean) AS mean, sum(p10) AS p10, sum(p50) AS p50, sum(p90) AS p90"


@query("hierarchy_rollup", sql(f"""
    SELECT 'nation' AS level, nation AS member, ts, {_SUMS} FROM supplier_plain JOIN supplier_meta USING (item_id) GROUP BY nation, ts
    UNION ALL SELECT 'region', region, ts, {_SUMS} FROM supplier_plain JOIN supplier_meta USING (item_id) GROUP BY region, ts
    UNION ALL SELECT 'all', NULL, ts, {_SUMS} FROM supplier_plain GROUP BY ts""", "supplier_plain", "supplier_meta",
    doubles="baseline_mean mean p10 p50 p90"))
def _(spark, d):
    return V.rollup(plain_forecast(spark, d, "supplier"), supplier_meta(spark, d), ["nation", "region"])


@query("view_kpis", sql("""
    SELECT f.*, p.prior_total, CASE WHEN prior_total <> 0 THEN (forecast_total / prior_total - 1) * 100 ELSE 0 END AS change_pct FROM (
      SELECT region, sum(mean) AS forecast_total, sum(p10) AS forecast_low, sum(p90) AS forecast_high, count(DISTINCT ts) AS periods
      FROM supplier_plain JOIN supplier_meta USING (item_id) GROUP BY region) f
    JOIN (SELECT h.region, sum(h.target) AS prior_total FROM (
        SELECT region, ts, sum(target) AS target, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS r FROM supplier_panel JOIN supplier_meta USING (item_id) GROUP BY region, ts) h
      JOIN (SELECT region, count(DISTINCT ts) AS n FROM supplier_plain JOIN supplier_meta USING (item_id) GROUP BY region) n ON n.region = h.region AND h.r <= n.n GROUP BY h.region) p USING (region)""",
    "supplier_plain", "supplier_meta", "supplier_panel", doubles="forecast_total forecast_low forecast_high prior_total change_pct"))
def _(spark, d):
    meta = supplier_meta(spark, d)
    ahead = V.rollup(plain_forecast(spark, d, "supplier"), meta, ["region"]).filter("level = 'region'").withColumnRenamed("member", "region")
    past = V.rollup(P.supplier_panel(spark, d), meta, ["region"], ["target"]).filter("level = 'region'").withColumnRenamed("member", "region")
    return V.view_kpis(past, ahead, ["region"])


@query("nested_export", sql("""
    SELECT h.item_id, history_n, history_total, forecast_n, forecast_first, methods_n FROM (
      SELECT item_id, count(*) AS history_n, sum(target) AS history_total FROM (
        SELECT item_id, target FROM part_panel QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) <= 48) GROUP BY item_id) h
    JOIN (SELECT item_id, count(*) AS forecast_n, min(ts) AS forecast_first FROM part_plain GROUP BY item_id) f USING (item_id)
    JOIN (SELECT item_id, count(*) AS methods_n FROM part_plain GROUP BY item_id) m USING (item_id)""", "part_panel", "part_plain",
    doubles="history_total"))
def _(spark, d):
    panel = P.part_panel(spark, d).select("item_id", "ts", "target")
    made = B.predict_series(D.final_histories(panel, "monthly", H), S, NAIVE)
    nested = V.nest_run(panel, plain_forecast(spark, d), made)
    return nested.select(
        "item_id", F.size("history").cast("bigint").alias("history_n"),
        F.aggregate("history", F.lit(0.0), lambda a, r: a + r["target"]).alias("history_total"),
        F.size("forecast").cast("bigint").alias("forecast_n"), F.col("forecast")[0]["ts"].alias("forecast_first"),
        F.size(F.col("methods")["Seasonal naive"]).cast("bigint").alias("methods_n"),
    )


# --- supply -------------------------------------------------------------------------------

view("sku_need", "SELECT sku, CAST(date_trunc('month', ts) AS DATE) AS period, sum(mean) AS demand FROM part_plain JOIN part_meta USING (item_id) GROUP BY 1, 2", "part_plain", "part_meta")
view("line_need", "SELECT production_line, CAST(date_trunc('month', ts) AS DATE) AS period, sum(mean) AS demand FROM part_plain JOIN part_meta USING (item_id) GROUP BY 1, 2", "part_plain", "part_meta")
view("gross_need", "SELECT material_id, period, sum(demand * quantity_per_tonne * (1 + scrap_pct / 100)) AS gross FROM sku_need JOIN bom USING (sku) GROUP BY 1, 2", "sku_need", "bom")
view("po_receipts", """
    SELECT material_id, CAST(date_trunc('month', due_date) AS DATE) AS period, sum(quantity) AS receipts FROM open_pos
    WHERE lower(coalesce(status, 'open')) NOT IN ('cancelled', 'closed', 'received') GROUP BY 1, 2""", "open_pos")


@query("sku_demand", sql("SELECT * FROM sku_need", "sku_need", doubles="demand"))
def _(spark, d):
    return Y.sku_demand(plain_forecast(spark, d), metadata(spark, d))


@query("line_load", sql("SELECT * FROM line_need", "line_need", doubles="demand"))
def _(spark, d):
    return Y.line_load(plain_forecast(spark, d), metadata(spark, d))


@query("receipts", sql("SELECT * FROM po_receipts", "po_receipts", doubles="receipts"))
def _(spark, d):
    return Y.receipts(operations(spark, d)["open_pos"])


@query("bom_explosion", sql("SELECT * FROM gross_need", "gross_need", doubles="gross"))
def _(spark, d):
    return Y.bom_explosion(Y.sku_demand(plain_forecast(spark, d), metadata(spark, d)), operations(spark, d)["bom"])


# row by row, on purpose another way than the running maximum of the Spark side
view("mrp_flow", """
    SELECT f.*, m.material_name, m.supplier, m.unit, m.inventory_on_hand - m.quality_hold_qty AS start, m.quality_hold_qty AS hold, m.safety_stock AS safety, m.moq,
           CAST(round_even(m.lead_time_days, 0) AS INTEGER) AS lead, row_number() OVER (PARTITION BY f.material_id ORDER BY f.period) AS k
    FROM (SELECT material_id, period, coalesce(gross, 0) AS gross, coalesce(receipts, 0) AS receipts FROM gross_need FULL JOIN po_receipts USING (material_id, period)) f
    JOIN materials m USING (material_id)""", "gross_need", "po_receipts", "materials")
view("mrp_walk", """
    SELECT material_id, 0::BIGINT AS k, NULL::DATE AS period, any_value(start)::DOUBLE AS balance, any_value(start)::DOUBLE AS planned, 0.0::DOUBLE AS opening, 0.0::DOUBLE AS ordered FROM mrp_flow GROUP BY material_id
    UNION ALL
    SELECT material_id, k, period, balance, planned + ordered, opening, ordered FROM (
      SELECT w.material_id, f.k, f.period, w.balance + (f.receipts - f.gross) AS balance, w.planned + (f.receipts - f.gross) AS planned, w.balance AS opening,
             CASE WHEN f.safety - (w.planned + (f.receipts - f.gross)) > 1e-9 * f.moq THEN
               CASE WHEN f.moq > 0 THEN ceil((f.safety - (w.planned + (f.receipts - f.gross))) / f.moq - 1e-9::DOUBLE) * f.moq ELSE f.safety - (w.planned + (f.receipts - f.gross)) END
             ELSE 0 END AS ordered
      FROM mrp_walk w JOIN mrp_flow f ON f.material_id = w.material_id AND f.k = w.k + 1)""", "mrp_flow")
view("mrp_rows", """
    SELECT f.material_id, material_name, supplier, f.period, round_even(opening, 3) AS opening, round_even(gross, 3) AS gross_requirement, round_even(receipts, 3) AS scheduled_receipts,
           round_even(hold, 3) AS quality_hold_qty, round_even(balance, 3) AS projected_balance, round_even(planned, 3) AS balance_with_proposed_orders, round_even(safety, 3) AS safety_stock,
           round_even(greatest(0, safety - balance), 3) AS shortage, round_even(ordered, 3) AS recommended_order,
           CASE WHEN ordered > 0 THEN CAST(f.period - to_days(lead) AS DATE) END AS planned_release_date, lead AS lead_time_days, moq, unit,
           CASE WHEN safety - balance > 0 THEN 'shortage' ELSE 'covered' END AS status
    FROM mrp_walk w JOIN mrp_flow f ON f.material_id = w.material_id AND f.k = w.k""", "mrp_walk", "mrp_flow")
_MRP = "opening gross_requirement scheduled_receipts quality_hold_qty projected_balance balance_with_proposed_orders safety_stock shortage recommended_order moq"


def material_rows(spark, d):
    ops = operations(spark, d)
    gross = Y.bom_explosion(Y.sku_demand(plain_forecast(spark, d), metadata(spark, d)), ops["bom"])
    return Y.material_plan(gross, ops["materials"], Y.receipts(ops["open_pos"]))


def capacity_rows(spark, d):
    return Y.capacity_plan(Y.line_load(plain_forecast(spark, d), metadata(spark, d)), operations(spark, d)["capacity"])


@query("mrp", sql("SELECT * FROM mrp_rows", "mrp_rows", doubles=_MRP, bigints="lead_time_days"))
def _(spark, d):
    return material_rows(spark, d)


view("capacity_rows", """
    SELECT production_line, period, round_even(demand, 3) AS forecast_tonnes, round_even(available_tonnes, 3) AS available_tonnes,
           round_even(CASE WHEN available_tonnes > 0 THEN demand / available_tonnes * 100 END, 2) AS utilisation_pct,
           round_even(planned_downtime_hours, 2) AS planned_downtime_hours, 0.0::DOUBLE AS working_days, 0.0::DOUBLE AS oee_target,
           round_even(available_tonnes - demand, 3) AS gap_tonnes,
           CASE WHEN demand > available_tonnes THEN 'bottleneck' WHEN available_tonnes > 0 AND demand / available_tonnes * 100 > 90 THEN 'watch' ELSE 'available' END AS status
    FROM (SELECT c.*, coalesce(n.demand, 0) AS demand FROM capacity c LEFT JOIN line_need n USING (production_line, period))""", "capacity", "line_need")


@query("capacity_plan", sql("SELECT * FROM capacity_rows", "capacity_rows",
                            doubles="forecast_tonnes available_tonnes utilisation_pct planned_downtime_hours working_days oee_target gap_tonnes"))
def _(spark, d):
    return capacity_rows(spark, d)


view("action_rows", """
    SELECT CASE WHEN balance < 0 THEN 'high' ELSE 'medium' END AS priority, 'material_shortage' AS type, material_name AS subject, f.period,
           'Release ' || format('{:,.1f}', ordered) || ' ' || unit || ' by ' || CAST(CAST(f.period - to_days(lead) AS DATE) AS VARCHAR) AS action, 'Procurement' AS owner
    FROM mrp_walk w JOIN mrp_flow f ON f.material_id = w.material_id AND f.k = w.k WHERE ordered > 1e-9::DOUBLE
    UNION ALL
    SELECT CASE WHEN demand > available_tonnes THEN 'high' ELSE 'medium' END, 'capacity', production_line, period,
           CASE WHEN demand > available_tonnes THEN 'Resolve ' || format('{:,.1f}', demand - available_tonnes) || ' tonne capacity gap' ELSE 'Review sequence and planned downtime' END, 'Production planning'
    FROM (SELECT c.*, coalesce(n.demand, 0) AS demand FROM capacity c LEFT JOIN line_need n USING (production_line, period))
    WHERE demand > available_tonnes OR (available_tonnes > 0 AND demand / available_tonnes * 100 > 90)""", "mrp_walk", "mrp_flow", "capacity", "line_need")


def plans_of_supply(spark, d, rounded: bool = True):
    """Material and capacity plan from a forecast and item metadata that are made once."""
    ahead = stage(plain_forecast(spark, d).select("item_id", "ts", "mean"), "forecast")
    meta = stage(metadata(spark, d), "metadata")
    ops = operations(spark, d)
    gross = Y.bom_explosion(Y.sku_demand(ahead, meta), ops["bom"])
    return (
        Y.material_plan(gross, ops["materials"], Y.receipts(ops["open_pos"]), rounded),
        Y.capacity_plan(Y.line_load(ahead, meta), ops["capacity"], rounded),
    )


@query("actions", sql("SELECT * FROM action_rows", "action_rows"))
def _(spark, d):
    return Y.action_list(*plans_of_supply(spark, d, rounded=False))


@query("top_evidence", sql("""
    SELECT * FROM (SELECT * FROM action_rows WHERE type = 'material_shortage' ORDER BY priority <> 'high', period, subject LIMIT 5)""", "action_rows"))
def _(spark, d):
    return Y.top_evidence(Y.action_list(*plans_of_supply(spark, d, rounded=False)), "material")


@query("supply_filter", sql("""
    SELECT material_id, material_name, supplier, period, status, shortage FROM mrp_rows
    WHERE status = 'shortage' AND contains(lower(material_name || ' ' || supplier), 'material 1')""", "mrp_rows", doubles="shortage"))
def _(spark, d):
    rows = Y.filter_supply(material_rows(spark, d), risk_only=True, search="Material 1")
    return rows.select("material_id", "material_name", "supplier", "period", "status", "shortage")


@query("supply_periods", sql("SELECT DISTINCT period FROM (SELECT period FROM mrp_rows UNION ALL SELECT period FROM capacity_rows)", "mrp_rows", "capacity_rows"))
def _(spark, d):
    return Y.supply_periods(*plans_of_supply(spark, d))


@query("operations_summary", sql("""
    SELECT count(*) FILTER (WHERE status = 'shortage') AS material_shortages, count(DISTINCT material_id) FILTER (WHERE status = 'shortage') AS materials_at_risk,
           (SELECT count(*) FROM capacity_rows WHERE status = 'bottleneck') AS capacity_bottlenecks, (SELECT count(*) FROM capacity_rows WHERE status = 'watch') AS capacity_watches,
           (SELECT count(*) FROM open_pos) AS open_purchase_orders, (SELECT round_even(sum(quality_hold_qty), 3) FROM materials) AS quality_hold_total FROM mrp_rows""",
    "mrp_rows", "capacity_rows", "open_pos", "materials", doubles="quality_hold_total"))
def _(spark, d):
    ops = operations(spark, d)
    return Y.operations_summary(*plans_of_supply(spark, d), ops["open_pos"], ops["materials"])


def _dirty(spark, d):
    """The operations tables with blanks, repeats and negatives that the data decides."""
    ops = operations(spark, d)
    part = table(spark, d, "part")
    ops["bom"] = part.select(
        F.col("p_brand").alias("sku"), F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("material_id"),
        F.when(F.col("p_size") == 7, None).otherwise(F.col("p_retailprice") - 1000).alias("quantity_per_tonne"),
    )
    ops["open_pos"] = ops["open_pos"].withColumn(
        "due_date", F.when(F.col("quantity") > 4, "soon").otherwise(F.col("due_date").cast("string"))
    )
    return ops


@query("ops_gates", sql("""
    SELECT 'bom_columns_missing' AS rule, 0 AS violations
    UNION ALL SELECT 'bom_blank_values', count(*) FILTER (WHERE p_size = 7) FROM part
    UNION ALL SELECT 'bom_quantity_per_tonne_invalid', count(*) FILTER (WHERE p_size = 7 OR p_retailprice < 1000) FROM part
    UNION ALL SELECT unnest(['materials_columns_missing', 'materials_blank_values', 'materials_inventory_on_hand_invalid', 'materials_safety_stock_invalid', 'materials_lead_time_days_invalid', 'materials_moq_invalid', 'capacity_columns_missing', 'capacity_blank_values', 'capacity_available_tonnes_invalid', 'capacity_period_unreadable', 'open_pos_columns_missing', 'open_pos_quantity_invalid', 'materials_repeated', 'capacity_repeated']), 0
    UNION ALL SELECT 'open_pos_due_date_unreadable', count(*) FILTER (WHERE quantity > 4) FROM open_pos
    UNION ALL SELECT 'bom_repeated', count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_size HAVING count(*) > 1)""", "open_pos", bigints="violations"))
def _(spark, d):
    return Y.operations_gate(_dirty(spark, d))


view("late_need", "SELECT production_line, CAST(period + to_months(6) AS DATE) AS period FROM line_need", "line_need")


@query("referential_gates", sql("""
    SELECT DISTINCT 'missing_bom' AS rule, sku AS key FROM sku_need WHERE sku NOT IN (SELECT sku FROM bom WHERE scrap_pct >= 2)
    UNION ALL SELECT DISTINCT 'missing_capacity', production_line || ' · ' || CAST(period AS VARCHAR) FROM late_need ANTI JOIN capacity USING (production_line, period)
    UNION ALL SELECT DISTINCT 'unknown_material', material_id FROM bom WHERE scrap_pct >= 2 AND material_id NOT IN (SELECT material_id FROM materials WHERE moq > 160)""",
    "sku_need", "late_need", "bom", "materials", "capacity"))
def _(spark, d):
    ops, ahead, meta = operations(spark, d), plain_forecast(spark, d), metadata(spark, d)
    load = Y.line_load(ahead, meta).withColumn("period", F.add_months("period", 6))
    return Y.referential_gates(
        Y.sku_demand(ahead, meta), load, ops["bom"].filter("scrap_pct >= 2"), ops["materials"].filter("moq > 160"), ops["capacity"]
    )


@query("supply_position", sql("""
    SELECT item_id, demand, inventory, projected, CASE WHEN demand > 0 THEN greatest(0, projected) / (demand / 30) END AS days_cover, safety, capacity_use_pct,
           projected < safety OR coalesce(capacity_use_pct, 0) > 90 AS risk,
           CASE WHEN projected < 0 AND capacity_use_pct > 100 THEN 'Expedite + add capacity' WHEN projected < 0 THEN 'Expedite supply'
                WHEN projected < safety AND capacity_use_pct > 100 THEN 'Capacity + stock review' WHEN capacity_use_pct > 100 THEN 'Resolve capacity'
                WHEN projected < safety THEN 'Replenish stock' WHEN capacity_use_pct > 90 THEN 'Review schedule' ELSE 'No action' END AS action
    FROM (SELECT item_id, demand, inventory_on_hand_tonnes AS inventory, inventory_on_hand_tonnes - demand AS projected, safety_stock_tonnes AS safety,
                 CASE WHEN monthly_capacity_tonnes > 0 THEN demand / monthly_capacity_tonnes * 100 END AS capacity_use_pct
          FROM part_meta JOIN (SELECT item_id, arg_min(mean, ts) AS demand FROM part_plain GROUP BY item_id) USING (item_id))""",
    "part_meta", "part_plain", doubles="demand inventory projected days_cover safety capacity_use_pct"))
def _(spark, d):
    return Y.supply_position(plain_forecast(spark, d), metadata(spark, d))


view("related", """
    SELECT p_brand AS sku, p_type AS related_sku, CASE WHEN p_size < 10 THEN 'new_product_analog' ELSE 'substitute' END AS relationship_type,
           p_retailprice / 100 AS expected_effect_pct, p_partkey AS row_id FROM part""")


def _related(spark, d):
    return Y.relationships(table(spark, d, "part").select(
        F.col("p_brand").alias("sku"), F.col("p_type").alias("related_sku"),
        F.when(F.col("p_size") < 10, "new_product_analog").otherwise("substitute").alias("relationship_type"),
        (F.col("p_retailprice") / 100).alias("expected_effect_pct"), F.col("p_partkey").alias("row_id"),
    ))


view("life_rows", """
    SELECT l.item_id, m.sku, l.lifecycle AS stage, l.history_points, a.analog FROM part_life l JOIN part_meta m USING (item_id)
    LEFT JOIN (SELECT sku, arg_min(related_sku, row_id) AS analog FROM related WHERE relationship_type = 'new_product_analog' GROUP BY sku) a USING (sku)""", "part_life", "part_meta", "related")


def _life(spark, d):
    return Y.product_lifecycle(R.lifecycle(P.part_panel(spark, d), "monthly"), metadata(spark, d), _related(spark, d), "row_id")


@query("product_lifecycle", sql("SELECT * FROM life_rows", "life_rows"))
def _(spark, d):
    return _life(spark, d)


@query("intelligence_table", sql("""
    SELECT sku AS product, relationship_type AS type, related_sku AS related, expected_effect_pct AS effect, 'master-data relationship' AS evidence FROM related
    UNION ALL SELECT sku, stage || ' lifecycle', analog, NULL, history_points || ' history points' FROM life_rows WHERE stage <> 'mature' OR analog IS NOT NULL""",
    "related", "life_rows", doubles="effect"))
def _(spark, d):
    return Y.intelligence_table(_related(spark, d), _life(spark, d))


# --- scenarios ------------------------------------------------------------------------------


@query("scenario", sql("""
    SELECT item_id, ts, mean AS baseline_mean, mean * 1.1::DOUBLE AS mean, p10 * 1.1::DOUBLE AS p10, p50 * 1.1::DOUBLE AS p50, p90 * 1.1::DOUBLE AS p90,
           10.0::DOUBLE AS scenario_adjustment_pct, 'Higher demand' AS scenario_name FROM part_plain""", "part_plain",
    doubles="baseline_mean mean p10 p50 p90 scenario_adjustment_pct"))
def _(spark, d):
    return C.quantity_scenario(plain_forecast(spark, d), 10.0, "Higher demand")


@query("scenario_compare", sql("""
    SELECT 'base' AS run_id, NULL::VARCHAR AS base_run_id, NULL::VARCHAR AS scenario_name, sum(mean) AS total, sum(mean) AS baseline, NULL::DOUBLE AS change_pct FROM part_plain
    UNION ALL SELECT 'up', 'base', 'Up', sum(mean) * 1.25::DOUBLE, sum(mean), 25.0 FROM part_plain
    UNION ALL SELECT 'down', 'base', 'Down', sum(mean) * 0.5::DOUBLE, sum(mean), -50.0 FROM part_plain""", "part_plain",
    doubles="total baseline change_pct", digits=4), digits=4)
def _(spark, d):
    base = stage(plain_forecast(spark, d), "plain")  # three runs start from it
    rows = base.withColumns({"run_id": F.lit("base"), "base_run_id": F.lit(None).cast("string"), "scenario_name": F.lit(None).cast("string")})
    for name, pct in (("Up", 25.0), ("Down", -50.0)):
        more = C.quantity_scenario(base, pct, name).withColumns({"run_id": F.lit(name.lower()), "base_run_id": F.lit("base")})
        rows = rows.unionByName(more.drop("scenario_adjustment_pct"))
    return C.compare_scenarios(rows)


@query("scenario_summary", sql("""
    SELECT sum(inventory_on_hand_tonnes - nxt) AS closing_stock, count(*) FILTER (WHERE inventory_on_hand_tonnes - nxt < safety_stock_tonnes) AS stock_risks,
           count(*) FILTER (WHERE monthly_capacity_tonnes > 0 AND nxt / monthly_capacity_tonnes > 0.9) AS capacity_risks, sum(total * unit_cost_irr) AS cost_exposure,
           (SELECT sum(mean) FROM part_plain) AS total, (SELECT sum(p10) FROM part_plain) AS low, (SELECT sum(p90) FROM part_plain) AS high
    FROM (SELECT item_id, arg_min(mean, ts) AS nxt, sum(mean) AS total FROM part_plain GROUP BY item_id) JOIN part_meta USING (item_id)""",
    "part_plain", "part_meta", doubles="closing_stock cost_exposure total low high", digits=2), digits=2)
def _(spark, d):
    ahead = stage(plain_forecast(spark, d), "plain")  # read for the totals, the items and the portfolio
    totals = V.rollup(ahead, metadata(spark, d), [])
    return C.scenario_summary(ahead, totals, metadata(spark, d))


# --- monitoring -------------------------------------------------------------------------------


def runs(spark, d):
    """One run per month: how well last year's value would have predicted it."""
    w = W.partitionBy("item_id").orderBy("ts")
    pairs = P.part_panel(spark, d).withColumn("pred", F.lag("target", S).over(w)).filter("pred IS NOT NULL")
    pairs = pairs.withColumnRenamed("target", "actual")
    quality = pairs.groupBy("ts").agg((100.0 - 100.0 * F.avg(F.col("was_imputed").cast("double"))).alias("data_quality_score"))
    month = F.date_format("ts", "yyyy-MM")
    return M.metrics(pairs, ["ts"]).join(quality, "ts").select(
        F.concat(F.lit("run-"), month).alias("run_id"), F.col("ts").alias("created_at"), F.last_day("ts").alias("data_end"),
        "wape_pct", "bias_pct", "data_quality_score", F.lit(80.0).alias("interval_coverage_pct"),
        F.lit("Seasonal naive").alias("best_model"), F.lit("strong").alias("evidence_level"),
    )


view("month_runs", f"""
    SELECT 'run-' || strftime(ts, '%Y-%m') AS run_id, ts AS created_at, last_day(ts) AS data_end, wape_pct, bias_pct, q AS data_quality_score,
           80.0::DOUBLE AS interval_coverage_pct, 'Seasonal naive' AS best_model, 'strong' AS evidence_level FROM (
      SELECT ts, {_METRICS}, 100 - 100.0::DOUBLE * avg(CASE WHEN was_imputed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q FROM (
        SELECT item_id, ts, was_imputed, target AS actual, lag(target, {S}) OVER (PARTITION BY item_id ORDER BY ts) AS pred FROM part_panel) WHERE pred IS NOT NULL GROUP BY ts)""", "part_panel")
_RUN_DOUBLES = "wape_pct bias_pct data_quality_score interval_coverage_pct"


@query("run_list", sql("SELECT * FROM month_runs", "month_runs", doubles=_RUN_DOUBLES))
def _(spark, d):
    return run_list(runs(spark, d))


@query("run_history", sql("""
    SELECT run_id, data_end, wape_pct, bias_pct, interval_coverage_pct AS coverage_pct, best_model, evidence_level AS evidence FROM month_runs""",
    "month_runs", doubles="wape_pct bias_pct coverage_pct"))
def _(spark, d):
    return O.run_history(runs(spark, d))


@query("drift", sql("""
    SELECT * EXCLUDE (first), len(why) > 0 OR first AS retrain,
           CASE WHEN len(why) > 0 THEN array_to_string(why, ' ') WHEN first THEN 'Initial production baseline should be established.' ELSE 'No retraining threshold was crossed.' END AS reasons
    FROM (SELECT *, list_filter([
             CASE WHEN wape_drift > 3 THEN 'Validation WAPE worsened by ' || format('{:,.1f}', abs(wape_drift)) || ' points.' END,
             CASE WHEN quality_drift < -5 THEN 'Data quality fell by ' || format('{:,.1f}', abs(quality_drift)) || ' points.' END,
             CASE WHEN abs(bias_pct) > 10 THEN 'Absolute validation bias is above 10%.' END], lambda x: x IS NOT NULL) AS why
      FROM (SELECT run_id, created_at, wape_pct, bias_pct, data_quality_score, wape_pct - lag(wape_pct) OVER (ORDER BY created_at) AS wape_drift,
                   data_quality_score - lag(data_quality_score) OVER (ORDER BY created_at) AS quality_drift, row_number() OVER (ORDER BY created_at) = 1 AS first
            FROM (SELECT * FROM month_runs ORDER BY created_at DESC LIMIT 12)))""", "month_runs",
    doubles="wape_pct bias_pct data_quality_score wape_drift quality_drift").replace("SELECT * REPLACE", "SELECT * EXCLUDE (why) REPLACE"))
def _(spark, d):
    rows = O.drift(O.recent_runs(runs(spark, d)))
    return rows.select("run_id", "created_at", "wape_pct", "bias_pct", "data_quality_score", "wape_drift", "quality_drift", "retrain", "reasons")


# --- plan ledger ------------------------------------------------------------------------------


def plan_events(spark, d):
    """Requested plan states from the event stream: one plan per user, one state per type."""
    kind = F.col("event_type")
    status = F.when((kind == "error") & (F.col("value") >= 90), "archived")
    for name, state in zip(_KINDS, PLAN_STATES):
        status = status.when(kind == name, state)
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("plan_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"),
        status.otherwise(kind).alias("status"),
    )


_KINDS = ["view", "click", "purchase", "signup"]


def plan_facts(spark, d):
    """Evidence per plan from how often it was touched."""
    n = F.count("*")
    return table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("plan_id")).agg(
        F.when(F.sum("value") > F.lit(50.0) * n, "strong").otherwise("limited").alias("evidence_level")
    )


_CASE = "CASE WHEN event_type = 'error' AND value >= 90 THEN 'archived' " + " ".join(
    f"WHEN event_type = '{k}' THEN '{s}'" for k, s in zip(_KINDS, PLAN_STATES)
) + " ELSE event_type END"
view("plan_log", f"""
    SELECT CAST(e.user_id AS VARCHAR) AS plan_id, e.event_id AS seq, e.ts AS "at", {_CASE} AS status, p.limited,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS k
    FROM events e JOIN (SELECT user_id, NOT sum(value) > 50.0::DOUBLE * count(*) AS limited FROM events GROUP BY user_id) p USING (user_id)""")
view("plan_moves", "SELECT * FROM (VALUES ('draft', 'review'), ('draft', 'archived'), ('review', 'draft'), ('review', 'approved'), ('review', 'archived'), ('approved', 'review'), ('approved', 'published'), ('approved', 'archived'), ('published', 'archived')) AS t(a, b)")
view("plan_verdict", """
    SELECT plan_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS status, NULL::VARCHAR AS before, NULL::VARCHAR AS reason, 'draft' AS state FROM plan_log GROUP BY plan_id
    UNION ALL
    SELECT plan_id, k, seq, status, before, reason, CASE WHEN reason IS NULL THEN status ELSE before END FROM (
      SELECT v.plan_id, l.k, l.seq, l.status, v.state AS before,
             CASE WHEN l.status NOT IN ('draft', 'review', 'approved', 'published', 'archived') THEN 'unknown status'
                  WHEN (v.state || '>' || l.status) NOT IN (SELECT a || '>' || b FROM plan_moves) THEN 'transition not allowed'
                  WHEN l.status IN ('approved', 'published') AND l.limited THEN 'limited evidence' END AS reason
      FROM plan_verdict v JOIN plan_log l ON l.plan_id = v.plan_id AND l.k = v.k + 1)""", "plan_log", "plan_moves")


@query("plan_audit", sql("SELECT plan_id, seq, status, before, reason, reason IS NULL AS valid FROM plan_verdict WHERE k > 0", "plan_verdict"))
def _(spark, d):
    return L.audit_transitions(plan_events(spark, d), plan_facts(spark, d))


@query("plan_counts", sql("""
    SELECT state AS status, count(*) AS plans FROM (SELECT plan_id, arg_max(state, k) AS state FROM plan_verdict GROUP BY plan_id)
    WHERE state <> 'archived' GROUP BY state""", "plan_verdict"))
def _(spark, d):
    return L.plan_counts(L.plan_status(L.audit_transitions(plan_events(spark, d), plan_facts(spark, d))))


def overrides(spark, d):
    """Every order line as an edit of its part and month by its supplier's plan."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("plan_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_extendedprice").alias("id"),
        F.col("l_partkey").cast("string").alias("item_id"), F.trunc("l_shipdate", "month").alias("period"),
        (F.col("l_quantity") * 2 - 10).alias("value"), F.when(F.col("l_tax") == 0, " ").otherwise("demand note").alias("reason"),
        F.col("l_shipdate").cast("date").alias("at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("date")).alias("reverted_at"),
        F.lit("entered twice").alias("revert_reason"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.05), "approved").otherwise("review").alias("status_at"),
    )


def plans(spark, d):
    return table(spark, d, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("plan_id"),
        F.concat(F.lit("R"), (F.col("s_nationkey") % 3 + 1).cast("string")).alias("run_id"),
        F.when(F.col("s_acctbal") > 0, "approved").otherwise("draft").alias("status"), F.col("s_acctbal").alias("created_at"),
    )


def run_forecast(spark, d):
    """Backtest rows of the naive rule; each fold stands for one run."""
    panel = stage(P.part_panel(spark, d).select("item_id", "ts", "target"), "panel")
    folds = D.rolling_folds(panel, "monthly", "deep", H)
    made = B.predict_series(D.fold_histories(panel, folds), S, NAIVE)
    return made.select(
        F.concat(F.lit("R"), F.col("fold").cast("string")).alias("run_id"), "item_id", "ts", "actual",
        F.col("pred").alias("baseline_mean"), F.col("pred").alias("mean"),
    )


view("edits", """
    SELECT 'P' || l_suppkey AS plan_id, l_orderkey || '-' || l_linenumber || '-' || CAST(l_extendedprice AS VARCHAR) AS id, CAST(l_partkey AS VARCHAR) AS item_id,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_quantity * 2 - 10 AS value, l_tax = 0 AS blank, CAST(l_shipdate AS DATE) AS "at",
           l_returnflag = 'R' AS undone, l_linestatus = 'F' AND l_discount > 0.05 AS locked FROM lineitem""")
view("run_rows", """
    SELECT 'R' || fold AS run_id, item_id, ts, actual, pred AS baseline_mean FROM part_records WHERE model = 'Seasonal naive'""", "part_records")
view("edit_plans", "SELECT 'P' || s_suppkey AS plan_id, 'R' || (s_nationkey % 3 + 1) AS run_id, CASE WHEN s_acctbal > 0 THEN 'approved' ELSE 'draft' END AS status, s_acctbal AS created_at FROM supplier")
view("edit_audit", """
    SELECT e.*, CASE WHEN blank THEN 'reason required' WHEN locked THEN 'plan locked' WHEN r.item_id IS NULL THEN 'unknown item or period' END AS rejected
    FROM edits e JOIN edit_plans p USING (plan_id) LEFT JOIN run_rows r ON r.run_id = p.run_id AND r.item_id = e.item_id AND r.ts = e.period""", "edits", "edit_plans", "run_rows")
view("edit_live", """
    SELECT plan_id, item_id, period, greatest(0, value) AS value FROM edit_audit WHERE NOT undone AND rejected IS NULL
    QUALIFY row_number() OVER (PARTITION BY plan_id, item_id, period ORDER BY "at" DESC, id DESC) = 1""", "edit_audit")
view("edit_approved", """
    SELECT r.*, coalesce(v.value, r.baseline_mean) AS approved FROM run_rows r LEFT JOIN (
      SELECT d.run_id, l.item_id, l.period, l.value FROM edit_live l JOIN (
        SELECT run_id, arg_min(plan_id, (created_at, plan_id)) AS plan_id FROM edit_plans WHERE status = 'approved' GROUP BY run_id) d USING (plan_id)) v
    ON v.run_id = r.run_id AND v.item_id = r.item_id AND v.period = r.ts""", "edit_live", "edit_plans", "run_rows")


def audited(spark, d):
    ahead = stage(run_forecast(spark, d), "runs")
    checked = L.audit_overrides(overrides(spark, d), plans(spark, d), ahead)
    return checked, ahead


@query("override_audit", sql("SELECT coalesce(rejected, 'accepted') AS verdict, undone AS reverted, count(*) AS n FROM edit_audit GROUP BY 1, 2", "edit_audit"))
def _(spark, d):
    checked, _ahead = audited(spark, d)
    return checked.groupBy(
        F.coalesce("rejected", F.lit("accepted")).alias("verdict"), F.col("reverted_at").isNotNull().alias("reverted")
    ).agg(F.count("*").alias("n"))


view("plan_edits", """
    SELECT CAST(user_id AS VARCHAR) AS plan_id, event_id AS seq, ts AS "at", value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events""")
view("plan_overrides", "SELECT plan_id, k AS id, \"at\", value FROM plan_edits WHERE k % 3 = 0 AND value >= 5", "plan_edits")
view("plan_reversals", """
    SELECT plan_id, seq, "at", k - k % 3 - 3 * (k % 2) AS override_id, CASE WHEN value < 10 THEN ' ' ELSE 'entered twice' END AS reason
    FROM plan_edits WHERE k % 3 <> 0""", "plan_edits")
view("reversal_states", """
    SELECT r.plan_id, r.seq, r."at", r.override_id, r.reason, coalesce(arg_max(v.status, (v."at", v.seq)), 'draft') AS status_at
    FROM plan_reversals r LEFT JOIN (SELECT p.plan_id, p.seq, p.status, l."at" FROM plan_verdict p JOIN plan_log l USING (plan_id, seq) WHERE p.reason IS NULL) v
      ON v.plan_id = r.plan_id AND v."at" <= r."at" GROUP BY 1, 2, 3, 4, 5""", "plan_reversals", "plan_verdict", "plan_log")
view("reversal_rows", """
    SELECT r.*, CASE WHEN trim(r.reason) = '' THEN 'reason required' WHEN status_at IN ('approved', 'published', 'archived') THEN 'plan locked'
                     WHEN o.id IS NULL OR o."at" > r."at" THEN 'unknown override' END AS early
    FROM reversal_states r LEFT JOIN plan_overrides o ON o.plan_id = r.plan_id AND o.id = r.override_id""", "reversal_states", "plan_overrides")
view("reversal_verdicts", """
    SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY plan_id, override_id, early IS NULL ORDER BY "at", seq) > 1
                   THEN 'already reversed' END AS rejected FROM reversal_rows""", "reversal_rows")


def plan_edits(spark, d):
    """Every third event of a plan as an override, the two after it as reversals of it or of the one before."""
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("plan_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), "value",
        F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("k"),
    )
    edits = rows.filter("k % 3 = 0 AND value >= 5").select("plan_id", F.col("k").alias("id"), "at", "value")
    undone = rows.filter("k % 3 <> 0").select(
        "plan_id", "seq", "at", (F.col("k") - F.col("k") % 3 - 3 * (F.col("k") % 2)).alias("override_id"),
        F.when(F.col("value") < 10, " ").otherwise("entered twice").alias("reason"),
    )
    return edits, undone


def reversal_verdicts(spark, d):
    events = plan_events(spark, d)
    audit = L.audit_transitions(events, plan_facts(spark, d)).join(events.select("plan_id", "seq", "at"), ["plan_id", "seq"])
    edits, undone = plan_edits(spark, d)
    return edits, L.audit_reversals(undone, edits, audit)


@query("reversal_audit", sql(
    "SELECT plan_id, seq, override_id, status_at, coalesce(rejected, 'accepted') AS verdict FROM reversal_verdicts", "reversal_verdicts",
    bigints="seq override_id"))
def _(spark, d):
    rows = reversal_verdicts(spark, d)[1]
    return rows.select("plan_id", "seq", "override_id", "status_at", F.coalesce("rejected", F.lit("accepted")).alias("verdict"))


@query("reversed_overrides", sql("""
    SELECT o.plan_id, o.id, o.value, r.rejected IS NULL AND r.seq IS NOT NULL AS reversed
    FROM plan_overrides o LEFT JOIN (SELECT * FROM reversal_verdicts WHERE rejected IS NULL) r ON r.plan_id = o.plan_id AND r.override_id = o.id""",
    "plan_overrides", "reversal_verdicts", doubles="value", bigints="id"))
def _(spark, d):
    edits, verdicts = reversal_verdicts(spark, d)
    return L.reversed_overrides(edits, verdicts).select("plan_id", "id", "value", F.col("reverted_at").isNotNull().alias("reversed"))


@query("override_ledger", sql("SELECT * FROM edit_live", "edit_live", doubles="value"))
def _(spark, d):
    return L.active_overrides(audited(spark, d)[0])


@query("approved_plan", sql("SELECT run_id, item_id, ts, baseline_mean, approved FROM edit_approved", "edit_approved", doubles="baseline_mean approved"))
def _(spark, d):
    checked, ahead = audited(spark, d)
    rows = L.approved_plan(ahead, L.active_overrides(checked), plans(spark, d))
    return rows.select("run_id", "item_id", "ts", "baseline_mean", "approved")


@query("overlay_rollup", sql("SELECT run_id, ts, sum(baseline_mean) AS mean, sum(approved) AS approved FROM edit_approved GROUP BY 1, 2", "edit_approved", doubles="mean approved"))
def _(spark, d):
    checked, ahead = audited(spark, d)
    return L.overlay_rollup(L.approved_plan(ahead, L.active_overrides(checked), plans(spark, d)), ["run_id", "ts"])


@query("fva", sql("""
    SELECT item_id, sum(abs(actual - baseline_mean)) / greatest(sum(abs(actual)), 1e-9::DOUBLE) * 100 AS baseline_wape_pct,
           sum(abs(actual - approved)) / greatest(sum(abs(actual)), 1e-9::DOUBLE) * 100 AS approved_wape_pct, count(*) AS observations,
           (sum(abs(actual - baseline_mean)) - sum(abs(actual - approved))) / greatest(sum(abs(actual)), 1e-9::DOUBLE) * 100 AS fva_points
    FROM edit_approved GROUP BY ROLLUP (item_id)""", "edit_approved", doubles="baseline_wape_pct approved_wape_pct fva_points", digits=4), digits=4)
def _(spark, d):
    checked, ahead = audited(spark, d)
    rows = L.approved_plan(ahead, L.active_overrides(checked), plans(spark, d))
    return O.forecast_value_add(ahead.select("item_id", "ts", "actual"), rows.drop("actual"))


@query("plan_timeline", sql("""
    SELECT plan_id, kind, count(*) AS n, min("at") AS first_at, min(note) AS first_note FROM (
      SELECT v.plan_id, CAST(l."at" AS DATE) AS "at", 'status' AS kind, v.status AS note FROM plan_verdict v JOIN plan_log l USING (plan_id, k) WHERE v.k > 0 AND v.reason IS NULL
      UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(ts AS DATE), 'comment', 'Comment: ' || trim(props) FROM events
      UNION ALL SELECT plan_id, "at", 'override', 'Override added for ' || item_id || ' · ' || CAST(period AS VARCHAR) || ': ' || CASE WHEN blank THEN '' ELSE 'demand note' END FROM edits
      UNION ALL SELECT plan_id, "at", 'reversal', 'Override ' || id || ' reversed: entered twice' FROM edits WHERE undone) GROUP BY 1, 2""",
    "plan_verdict", "plan_log", "edits"))
def _(spark, d):
    events = plan_events(spark, d)
    audit = L.audit_transitions(events, plan_facts(spark, d))
    audit = audit.join(events.select("plan_id", "seq", F.col("at").cast("date").alias("at")), ["plan_id", "seq"])
    comments = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("plan_id"), F.col("ts").cast("date").alias("at"), F.col("props").alias("text")
    )
    line = L.plan_timeline(audit, comments, overrides(spark, d))
    return line.groupBy("plan_id", "kind").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.min("note").alias("first_note"))


# --- exceptions ---------------------------------------------------------------------------------

view("diag", f"""
    SELECT c.item_id, m.sku, c.demand_class, l.structural_break, z.isolated_zero_periods, q.bias_pct,
           round_even(greatest(0, 100 - least(70, wape_pct * 2) - least(15, abs(bias_pct) * 0.5::DOUBLE) - CASE WHEN c.history_points < {2 * S} THEN 12 ELSE 0 END), 1) AS quality_score
    FROM (SELECT *, CASE WHEN average_demand_interval < 1.32 THEN CASE WHEN squared_coefficient_variation < 0.49 THEN 'smooth' ELSE 'erratic' END
                    ELSE CASE WHEN squared_coefficient_variation < 0.49 THEN 'intermittent' ELSE 'lumpy' END END AS demand_class FROM part_class) c
    JOIN part_life l USING (item_id) JOIN part_meta m USING (item_id)
    JOIN (SELECT item_id, count(*) FILTER (WHERE target <= 1e-9 AND b > 1e-9 AND a > 1e-9) AS isolated_zero_periods FROM (
      SELECT item_id, target, lag(target) OVER (PARTITION BY item_id ORDER BY ts) AS b, lead(target) OVER (PARTITION BY item_id ORDER BY ts) AS a FROM part_idx) GROUP BY item_id) z USING (item_id)
    JOIN (SELECT item_id, {_METRICS} FROM part_records WHERE model = 'Seasonal naive' GROUP BY item_id) q USING (item_id)""",
     "part_class", "part_life", "part_meta", "part_idx", "part_records")
view("findings", """
    SELECT 3 AS section, item_id AS place, 1 AS rule, 'high' AS priority, sku AS item, 'Forecast quality is ' || format('{:,.0f}', quality_score) || ' / 100.' AS reason, 'Demand planner' AS owner FROM diag WHERE quality_score < 65
    UNION ALL SELECT 3, item_id, 2, 'medium', sku, 'Forecast bias is ' || format('{:,.1f}', bias_pct) || '%.', 'Demand planner' FROM diag WHERE quality_score >= 65 AND abs(bias_pct) > 15
    UNION ALL SELECT 3, item_id, 3, 'medium', sku, upper(demand_class[1]) || demand_class[2:] || ' demand needs an intermittent method review.', 'Demand planner' FROM diag WHERE demand_class IN ('intermittent', 'lumpy')
    UNION ALL SELECT 3, item_id, 4, 'high', sku, 'Recent demand shifted materially from the prior operating window.', 'Demand planner' FROM diag WHERE structural_break
    UNION ALL SELECT 3, item_id, 5, 'medium', sku, isolated_zero_periods || ' isolated zero period(s) may hide a stockout or lost sale.', 'Supply planner' FROM diag WHERE isolated_zero_periods > 0
    UNION ALL SELECT 4, '', 1, priority, subject, action, owner FROM action_rows""", "diag", "action_rows")


def diagnostics(spark, d):
    panel = stage(P.part_panel(spark, d).select("item_id", "ts", "target"), "panel")
    folds = D.rolling_folds(panel, "monthly", "deep", H)
    made = B.predict_series(D.fold_histories(panel, folds), S, NAIVE)
    scored = M.metrics(made, ["item_id"]).join(R.series_profile(panel, "monthly"), "item_id")
    return R.series_quality(scored, "monthly").join(metadata(spark, d).select("item_id", "sku"), "item_id")


@query("exceptions", sql("SELECT section, priority, item, reason, owner FROM findings", "findings", bigints="section"))
def _(spark, d):
    return Q.exceptions(diagnostics(spark, d), Y.action_list(*plans_of_supply(spark, d, rounded=False)), n=None)


@query("exception_queue", sql("""
    SELECT section, priority, item, reason, owner FROM (SELECT * FROM findings WHERE section = 3 ORDER BY place, rule LIMIT 14)""", "findings", bigints="section"))
def _(spark, d):
    return Q.exceptions(diagnostics(spark, d))


@query("quality_worst", sql("""
    SELECT item_id, sku, demand_class, quality_score, bias_pct FROM diag ORDER BY quality_score, item_id LIMIT 20""", "diag", doubles="quality_score bias_pct"))
def _(spark, d):
    return Q.worst_first(diagnostics(spark, d), 20).select("item_id", "sku", "demand_class", "quality_score", "bias_pct")
