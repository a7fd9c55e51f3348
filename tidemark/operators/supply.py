"""Material requirements, lot-sized proposals, line capacity and the actions they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as C
from ..functions.fixed import (
    ANALOG_TYPE, CLOSED_PO_STATUSES, NUMERIC_COLUMNS, OWNER_CAPACITY, OWNER_MATERIAL,
    RELATIONSHIP_EVIDENCE, REQUIRED_COLUMNS, REVIEW_SEQUENCE, UNMAPPED_LINE, ZERO,
)


def _month(df: DataFrame, name: str) -> Column:
    return F.trunc(C.to_day(F.col(name), df.schema[name].dataType), "month")


def _number(df: DataFrame, name: str) -> Column:
    return C.number_or(df, name)


def _maybe(df: DataFrame, name: str, default=None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast("string")


# --- gates ------------------------------------------------------------------------


def operations_gate(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations)`` for the content of the operations tables, one pass per table."""
    out = None
    for name, needed in REQUIRED_COLUMNS.items():
        if name not in tables:
            continue
        df = tables[name]
        lacking = [c for c in needed if c not in df.columns]
        counts = {f"{name}_columns_missing": F.lit(len(lacking)).cast("bigint")}
        if not lacking:
            if name != "open_pos":
                blank = F.lit(False)
                for c in needed:
                    blank = blank | F.col(c).isNull()
                counts[f"{name}_blank_values"] = F.count_if(blank)
            for c in NUMERIC_COLUMNS[name]:
                value = C.number(df, c)
                counts[f"{name}_{c}_invalid"] = F.count_if(~(C.is_finite(value) & (F.coalesce(value, F.lit(-1.0)) >= 0)))
            for c in ("period", "due_date"):
                if c in needed:
                    counts[f"{name}_{c}_unreadable"] = F.count_if(_month(df, c).isNull())
        one = df.agg(*[v.alias(k) for k, v in counts.items()]).unpivot([], list(counts), "rule", "violations")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(uniqueness_gates(tables))


def uniqueness_gates(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once; capacity is judged after month alignment."""
    capacity = tables["capacity"]
    rules = {
        "materials_repeated": tables["materials"].select("material_id"),
        "bom_repeated": tables["bom"].select("sku", "material_id"),
        "capacity_repeated": capacity.select("production_line", _month(capacity, "period").alias("period")),
    }
    out = None
    for rule, keys in rules.items():
        twice = keys.groupBy(*keys.columns).count().agg(F.count_if(F.col("count") > 1).alias("violations"))
        one = twice.select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def referential_gates(
    demand: DataFrame, load: DataFrame, bom: DataFrame, materials: DataFrame, capacity: DataFrame
) -> DataFrame:
    """Forecast products without BOM, line-months without capacity, unknown materials."""
    text = lambda name: F.col(name).cast("string").alias(name)
    no_bom = demand.select(text("sku")).distinct().join(bom.select(text("sku")), "sku", "left_anti")
    calendar = capacity.select(text("production_line"), _month(capacity, "period").alias("period"))
    no_line = load.select("production_line", "period").distinct().join(calendar, ["production_line", "period"], "left_anti")
    unknown = bom.select(text("material_id")).distinct().join(
        materials.select(text("material_id")), "material_id", "left_anti"
    )
    return (
        no_bom.select(F.lit("missing_bom").alias("rule"), F.col("sku").alias("key"))
        .unionByName(no_line.select(
            F.lit("missing_capacity").alias("rule"),
            F.concat_ws(" · ", "production_line", F.col("period").cast("string")).alias("key"),
        ))
        .unionByName(unknown.select(F.lit("unknown_material").alias("rule"), F.col("material_id").alias("key")))
    )


# --- demand -----------------------------------------------------------------------


def _with_meta(forecast: DataFrame, meta: DataFrame) -> DataFrame:
    wanted = [c for c in ("sku", "production_line") if c in meta.columns]
    joined = forecast.join(meta.select("item_id", *wanted), "item_id", "left")
    return joined.withColumn("period", F.trunc("ts", "month"))


def sku_demand(forecast: DataFrame, meta: DataFrame) -> DataFrame:
    """Monthly demand per product, over all items that share it."""
    sku = F.coalesce(F.nullif(_maybe(meta, "sku"), F.lit("")), F.col("item_id"))
    return _with_meta(forecast, meta).groupBy(sku.alias("sku"), "period").agg(F.sum("mean").alias("demand"))


def line_load(forecast: DataFrame, meta: DataFrame) -> DataFrame:
    line = F.coalesce(F.nullif(_maybe(meta, "production_line"), F.lit("")), F.lit(UNMAPPED_LINE))
    return _with_meta(forecast, meta).groupBy(line.alias("production_line"), "period").agg(F.sum("mean").alias("demand"))


def receipts(open_pos: DataFrame) -> DataFrame:
    """Scheduled receipts per material and month, without finished or cancelled orders."""
    status = F.lower(F.coalesce(_maybe(open_pos, "status"), F.lit("open")))
    rows = open_pos.filter(~status.isin(CLOSED_PO_STATUSES))
    return rows.groupBy(
        F.col("material_id").cast("string").alias("material_id"), _month(open_pos, "due_date").alias("period")
    ).agg(F.sum(_number(open_pos, "quantity")).alias("receipts"))


def bom_explosion(demand: DataFrame, bom: DataFrame) -> DataFrame:
    """Gross requirement per material and month. Demand has one row per product and month."""
    factor = _number(bom, "quantity_per_tonne") * (1.0 + _number(bom, "scrap_pct") / 100.0)
    parts = bom.select(
        F.col("sku").cast("string").alias("sku"), F.col("material_id").cast("string").alias("material_id"),
        factor.alias("factor"),
    )
    return (
        demand.join(parts, "sku").groupBy("material_id", "period")
        .agg(F.sum(F.col("demand") * F.col("factor")).alias("gross"))
    )


# --- material plan ------------------------------------------------------------------


def material_plan(
    gross: DataFrame, materials: DataFrame, scheduled: DataFrame | None = None, rounded: bool = True
) -> DataFrame:
    """Time-phased balance and lot-sized proposals that net earlier proposals. Decisions need the rows not ``rounded``.

    Proposals add up to the running maximum of the lot-rounded shortfall, so the balance
    needs running sums and one running maximum, and no row-by-row recursion.
    """
    flows = gross.select("material_id", "period", "gross")
    if scheduled is not None:
        flows = flows.join(scheduled, ["material_id", "period"], "full_outer")
    else:
        flows = flows.withColumn("receipts", F.lit(0.0))
    flows = flows.select(
        "material_id", "period", F.coalesce("gross", F.lit(0.0)).alias("gross"),
        F.coalesce("receipts", F.lit(0.0)).alias("receipts"),
    )
    hold = _number(materials, "quality_hold_qty")
    master = materials.select(
        F.col("material_id").cast("string").alias("material_id"), _maybe(materials, "material_name").alias("material_name"),
        _maybe(materials, "supplier").alias("supplier"),
        (_maybe(materials, "unit", "unit") if "unit" in materials.columns else F.lit("unit")).alias("unit"),
        (_number(materials, "inventory_on_hand") - hold).alias("start"), hold.alias("hold"),
        _number(materials, "safety_stock").alias("safety"),
        F.greatest(F.lit(0.0), _number(materials, "moq")).alias("moq"),
        F.greatest(F.lit(0), F.bround(_number(materials, "lead_time_days"), 0).cast("int")).alias("lead"),
    )
    w = W.partitionBy("material_id").orderBy("period")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    net = F.col("receipts") - F.col("gross")
    rows = flows.join(master, "material_id").withColumn("__flow", F.sum(net).over(run))
    rows = rows.withColumn("balance", F.col("start") + F.col("__flow"))
    rows = rows.withColumn("short", F.greatest(F.lit(0.0), F.col("safety") - F.col("balance")))
    # the small amount keeps float noise from opening another lot at an exact multiple
    lots = F.ceil(F.col("short") / F.nullif("moq", F.lit(0.0)) - F.lit(ZERO)) * F.col("moq")
    rows = rows.withColumn("__need", F.when(F.col("moq") > 0, lots).otherwise(F.col("short")))
    rows = rows.withColumn("__covered", F.max("__need").over(run))
    order = F.col("__covered") - F.coalesce(F.lag("__covered").over(w), F.lit(0.0))
    rows = rows.withColumn("order", order)
    release = F.when(F.col("order") > 0, F.date_sub("period", F.col("lead")))
    r3 = lambda c: F.bround(c, 3) if rounded else c
    return rows.select(
        "material_id", "material_name", "supplier", "period",
        r3(F.col("balance") - net).alias("opening"),
        r3(F.col("gross")).alias("gross_requirement"),
        r3(F.col("receipts")).alias("scheduled_receipts"),
        r3(F.col("hold")).alias("quality_hold_qty"),
        r3(F.col("balance")).alias("projected_balance"),
        r3(F.col("balance") + F.col("__covered")).alias("balance_with_proposed_orders"),
        r3(F.col("safety")).alias("safety_stock"),
        r3(F.col("short")).alias("shortage"),
        r3(F.col("order")).alias("recommended_order"),
        release.alias("planned_release_date"),
        F.col("lead").alias("lead_time_days"),
        "moq", "unit",
        F.when(F.col("short") > 0, "shortage").otherwise("covered").alias("status"),
    )


# --- capacity -------------------------------------------------------------------------


def capacity_plan(load: DataFrame, capacity: DataFrame, rounded: bool = True) -> DataFrame:
    rows = capacity.select(
        F.col("production_line").cast("string").alias("production_line"), _month(capacity, "period").alias("period"),
        _number(capacity, "available_tonnes").alias("available"),
        _number(capacity, "planned_downtime_hours").alias("downtime"),
        _number(capacity, "working_days").alias("days"), _number(capacity, "oee_target").alias("oee"),
    )
    joined = rows.join(load, ["production_line", "period"], "left")
    joined = joined.withColumn("demand", F.coalesce("demand", F.lit(0.0)))
    use = F.when(F.col("available") > 0, F.col("demand") / F.col("available") * 100.0)
    joined = joined.withColumn("use", use)
    status = (
        F.when(F.col("demand") > F.col("available"), "bottleneck")
        .when(F.col("use") > 90, "watch")
        .otherwise("available")
    )
    shown = lambda c, digits: F.bround(c, digits) if rounded else F.col(c)
    joined = joined.withColumn("gap", F.col("available") - F.col("demand"))
    return joined.select(
        "production_line", "period",
        shown("demand", 3).alias("forecast_tonnes"), shown("available", 3).alias("available_tonnes"),
        shown("use", 2).alias("utilisation_pct"), shown("downtime", 2).alias("planned_downtime_hours"),
        shown("days", 1).alias("working_days"), shown("oee", 3).alias("oee_target"),
        shown("gap", 3).alias("gap_tonnes"), status.alias("status"),
    )


# --- actions and summaries ---------------------------------------------------------------


def action_list(material: DataFrame, capacity: DataFrame) -> DataFrame:
    """Orders to release and line months to resolve, high priority first, then by period.

    Both plans must not be rounded: a balance a little below zero is one. Orders of less than the amount
    that keeps float noise from opening a lot are none.
    """
    order = F.col("recommended_order")
    buy = material.filter(order > ZERO).select(
        F.when(F.col("projected_balance") < 0, "high").otherwise("medium").alias("priority"),
        F.lit("material_shortage").alias("type"),
        F.coalesce("material_name", "material_id").alias("subject"),
        "period",
        F.concat(
            F.lit("Release "), F.format_number(order, 1), F.lit(" "), F.coalesce("unit", F.lit("units")),
            F.lit(" by "), F.col("planned_release_date").cast("string"),
        ).alias("action"),
        F.lit(OWNER_MATERIAL).alias("owner"),
    )
    tight = F.col("status") == "bottleneck"
    gap = F.format_number(F.greatest(F.lit(0.0), -F.col("gap_tonnes")), 1)
    resolve = capacity.filter(F.col("status").isin("bottleneck", "watch")).select(
        F.when(tight, "high").otherwise("medium").alias("priority"),
        F.lit("capacity").alias("type"), F.col("production_line").alias("subject"), "period",
        F.when(tight, F.concat(F.lit("Resolve "), gap, F.lit(" tonne capacity gap"))).otherwise(REVIEW_SEQUENCE).alias("action"),
        F.lit(OWNER_CAPACITY).alias("owner"),
    )
    return buy.unionByName(resolve).orderBy(F.col("priority") != "high", "period", "type", "subject")


def operations_summary(
    material: DataFrame, capacity: DataFrame, open_pos: DataFrame | None, materials: DataFrame
) -> DataFrame:
    short = F.col("status") == "shortage"
    one = material.agg(
        F.count_if(short).alias("material_shortages"),
        F.count_distinct(F.when(short, F.col("material_id"))).alias("materials_at_risk"),
    )
    lines = capacity.agg(
        F.count_if(F.col("status") == "bottleneck").alias("b"), F.count_if(F.col("status") == "watch").alias("w")
    ).select(F.struct("b", "w").alias("s")).scalar()
    orders = open_pos.agg(F.count("*")).scalar() if open_pos is not None else F.lit(0).cast("bigint")
    hold = materials.agg(F.bround(F.sum(_number(materials, "quality_hold_qty")), 3)).scalar()
    return one.withColumns({
        "capacity_bottlenecks": lines["b"], "capacity_watches": lines["w"],
        "open_purchase_orders": orders, "quality_hold_total": hold,
    })


def supply_periods(material: DataFrame, capacity: DataFrame) -> DataFrame:
    return material.select("period").union(capacity.select("period")).distinct()


def filter_supply(rows: DataFrame, *, risk_only: bool = False, period=None, search: str = "") -> DataFrame:
    """Rows at risk, of one period, whose name, line or supplier contains a text."""
    if risk_only:
        rows = rows.filter(~F.col("status").isin("covered", "available"))
    if period is not None:
        rows = rows.filter(F.col("period") == F.lit(period).cast("date"))
    names = [F.coalesce(F.col(c), F.lit("")) for c in ("material_name", "production_line", "supplier") if c in rows.columns]
    return rows.filter(F.lower(F.concat_ws(" ", *names)).contains(search.lower())) if search else rows


def top_evidence(rows: DataFrame, kind: str, n: int = 5) -> DataFrame:
    """Rows behind an answer: material shortages, lines past the watch level, or drivers."""
    if kind == "material":
        return rows.filter("type = 'material_shortage'").orderBy(F.col("priority") != "high", "period", "subject").limit(n)
    if kind == "capacity":
        return rows.filter("status <> 'available'").orderBy("period", "production_line").limit(n)
    return rows.orderBy(F.desc("importance"), "feature").limit(n)


# --- item supply position -----------------------------------------------------------------


def supply_position(forecast: DataFrame, meta: DataFrame) -> DataFrame:
    """Stock after the next period, days of cover, capacity use, risk and what to do."""
    next_period = forecast.groupBy("item_id").agg(F.min_by("mean", "ts").alias("demand"))
    joined = meta.join(next_period, "item_id")
    stock, safety = _number(meta, "inventory_on_hand_tonnes"), _number(meta, "safety_stock_tonnes")
    room = _number(meta, "monthly_capacity_tonnes")
    joined = joined.withColumns({
        "inventory": stock, "safety": safety, "projected": stock - F.col("demand"),
        "capacity_use_pct": F.when(room > 0, F.col("demand") / room * 100.0),
    })
    use = F.coalesce("capacity_use_pct", F.lit(0.0))
    gone, low = F.col("projected") < 0, F.col("projected") < F.col("safety")
    action = (
        F.when(gone & (use > 100), "Expedite + add capacity")
        .when(gone, "Expedite supply")
        .when(low & (use > 100), "Capacity + stock review")
        .when(use > 100, "Resolve capacity")
        .when(low, "Replenish stock")
        .when(use > 90, "Review schedule")
        .otherwise("No action")
    )
    cover = F.when(F.col("demand") > 0, F.greatest(F.lit(0.0), "projected") / (F.col("demand") / 30.0))
    return joined.select(
        "item_id", "demand", "inventory", "projected", cover.alias("days_cover"), "safety",
        "capacity_use_pct", (low | (use > 90)).alias("risk"), action.alias("action"),
    )


# --- relationships and lifecycle -------------------------------------------------------------


def relationships(df: DataFrame) -> DataFrame:
    evidence, causality = RELATIONSHIP_EVIDENCE
    return df.withColumns({"evidence": F.lit(evidence), "causality": F.lit(causality)})


def product_lifecycle(diagnostics: DataFrame, meta: DataFrame, related: DataFrame, order_col: str) -> DataFrame:
    """Stage per item and the first known analog of its product."""
    analog = (
        related.filter(F.col("relationship_type") == ANALOG_TYPE)
        .groupBy("sku").agg(F.min_by("related_sku", order_col).alias("analog"))
    )
    rows = diagnostics.join(meta.select("item_id", "sku"), "item_id", "left")
    rows = rows.withColumn("sku", F.coalesce("sku", "item_id"))
    return rows.join(analog, "sku", "left").select(
        "item_id", "sku", F.coalesce("lifecycle", F.lit("mature")).alias("stage"), "history_points", "analog"
    )


def intelligence_table(related: DataFrame, life: DataFrame) -> DataFrame:
    """Given relationships and the lifecycle rows that say something."""
    given = related.select(
        F.col("sku").alias("product"), F.col("relationship_type").alias("type"), F.col("related_sku").alias("related"),
        F.col("expected_effect_pct").cast("double").alias("effect"), "evidence",
    )
    staged = life.filter((F.col("stage") != "mature") | F.col("analog").isNotNull()).select(
        F.col("sku").alias("product"), F.concat("stage", F.lit(" lifecycle")).alias("type"), F.col("analog").alias("related"),
        F.lit(None).cast("double").alias("effect"),
        F.concat(F.col("history_points").cast("string"), F.lit(" history points")).alias("evidence"),
    )
    return given.unionByName(staged)
