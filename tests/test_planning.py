import datetime as dt
import math
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions.fixed import PLAN_STATES, PLAN_TRANSITIONS
from tidemark.operators import exceptions as Q
from tidemark.operators import ledger as L
from tidemark.operators import monitoring as O
from tidemark.operators import rollups as V
from tidemark.operators import scenarios as C
from tidemark.operators import supply as Y
from tidemark.plans.catalog import all_oracles, all_queries


def month(i):
    return dt.date(2026 + i // 12, i % 12 + 1, 1)


FORECAST = "item_id string, ts date, mean double"


def test_netting_of_two_items_of_one_product(spark):
    ahead = spark.createDataFrame([(c, month(6 + k), 50.0) for c in ("c1", "c2") for k in range(3)], FORECAST)
    meta = spark.createDataFrame([("c1", "A", "L"), ("c2", "A", "L")], "item_id string, sku string, production_line string")
    bom = spark.createDataFrame([("A", "M", 1.0)], "sku string, material_id string, quantity_per_tonne double")
    materials = spark.createDataFrame(
        [("M", "Material", 0.0, 0.0, 10.0, 100.0)],
        "material_id string, material_name string, inventory_on_hand double, safety_stock double, lead_time_days double, moq double",
    )
    capacity = spark.createDataFrame([("L", f"2026-{m:02d}-01", 0.0) for m in (7, 8, 9)], "production_line string, period string, available_tonnes double")
    plan = Y.material_plan(Y.bom_explosion(Y.sku_demand(ahead, meta), bom), materials).orderBy("period").collect()
    assert [r.gross_requirement for r in plan] == [100, 100, 100]
    assert [r.recommended_order for r in plan] == [100, 100, 100]
    assert plan[0].planned_release_date == dt.date(2026, 6, 21)
    lines = Y.capacity_plan(Y.line_load(ahead, meta), capacity)
    first = lines.orderBy("period").first()
    assert first.forecast_tonnes == 100 and first.status == "bottleneck" and first.utilisation_pct is None
    actions = Y.action_list(Y.material_plan(Y.bom_explosion(Y.sku_demand(ahead, meta), bom), materials), lines).collect()
    assert actions[0].priority == "high" and len(actions) == 6
    assert any(a.action == "Resolve 100.0 tonne capacity gap" for a in actions)


flow = st.tuples(st.integers(0, 500), st.integers(0, 300))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(flow, min_size=1, max_size=14), st.integers(-50, 400), st.integers(0, 200), st.sampled_from([0, 1, 7, 50, 120])), min_size=1, max_size=12))
def test_running_maximum_equals_the_period_by_period_plan(spark, cases):
    gross, received, master, want = [], [], [], {}
    for i, (flows, start, safety, moq) in enumerate(cases):
        master.append((f"M{i}", "m", float(start), float(safety), 0.0, float(moq)))
        planned = float(start)
        for k, (need, got) in enumerate(flows):
            gross.append((f"M{i}", month(k), float(need)))
            received.append((f"M{i}", month(k), float(got)))
            planned += got - need
            lack = max(0.0, safety - planned)
            order = math.ceil(lack / moq) * moq if moq and lack > 0 else lack
            planned += order
            want[f"M{i}", month(k)] = (order, planned)
    plan = Y.material_plan(
        spark.createDataFrame(gross, "material_id string, period date, gross double"),
        spark.createDataFrame(master, "material_id string, material_name string, inventory_on_hand double, safety_stock double, lead_time_days double, moq double"),
        spark.createDataFrame(received, "material_id string, period date, receipts double"),
    )
    got = {(r.material_id, r.period): (r.recommended_order, r.balance_with_proposed_orders) for r in plan.collect()}
    assert got == want


def replay(log, limited):
    state, out = "draft", []
    for seq, status in log:
        if status not in PLAN_STATES:
            why = "unknown status"
        elif status not in PLAN_TRANSITIONS[state]:
            why = "transition not allowed"
        elif status in ("approved", "published") and limited:
            why = "limited evidence"
        else:
            why = None
        out.append((seq, state, why))
        state = state if why else status
    return out


def test_audit_of_one_very_busy_plan(spark):
    rng = random.Random(4)
    logs = {
        "busy": [(i, rng.choice(["draft", "review", "approved", "odd"])) for i in range(150_000)],
        "small": [(i * 1000, rng.choice(PLAN_STATES)) for i in range(40)],
        "limited": [(i, rng.choice(PLAN_STATES[:4])) for i in range(500)],
    }
    events = spark.createDataFrame([(p, s, w) for p, log in logs.items() for s, w in log], "plan_id string, seq long, status string")
    plans = spark.createDataFrame([("busy", "strong"), ("small", "strong"), ("limited", "limited")], "plan_id string, evidence_level string")
    audit = L.audit_transitions(events, plans)
    got = {}
    for r in audit.collect():
        got.setdefault(r.plan_id, []).append((r.seq, r.before, r.reason))
    for plan, log in logs.items():
        assert sorted(got[plan]) == replay(log, plan == "limited")


def test_plan_rules(spark):
    events = spark.createDataFrame([("a", 1, "published"), ("b", 1, "review"), ("b", 2, "approved")], "plan_id string, seq int, status string")
    plans = spark.createDataFrame([("a", "strong"), ("b", "limited")], "plan_id string, evidence_level string")
    audit = L.audit_transitions(events, plans)
    found = {(r.plan_id, r.seq): r.reason for r in audit.collect()}
    assert found == {("a", 1): "transition not allowed", ("b", 1): None, ("b", 2): "limited evidence"}
    assert {(r.plan_id, r.status) for r in L.plan_status(audit).collect()} == {("a", "draft"), ("b", "review")}


OVERRIDES = "plan_id string, id string, item_id string, period date, value double, reason string, at int, reverted_at int, revert_reason string, status_at string"


def test_overrides_and_approved_plan(spark):
    rows = [
        ("p1", "o1", "A", month(8), 110.0, "why", 1, None, None, "draft"),
        ("p1", "o2", "A", month(8), 118.0, "why", 2, None, None, "draft"),
        ("p1", "o3", "A", month(8), 130.0, "why", 3, 4, "oops", "draft"),
        ("p1", "o4", "A", month(8), 150.0, " ", 5, None, None, "draft"),
        ("p1", "o5", "A", month(8), 160.0, "late", 6, None, None, "approved"),
        ("p1", "o6", "Z", month(8), 1.0, "who", 7, None, None, "draft"),
        ("p1", "o7", "B", month(8), -5.0, "floor", 7, None, None, "draft"),
        ("p2", "o8", "A", month(8), 1.0, "other plan", 9, None, None, "draft"),
    ]
    overrides = spark.createDataFrame(rows, OVERRIDES)
    plans = spark.createDataFrame([("p1", "r", "published", 1), ("p2", "r", "approved", 2)], "plan_id string, run_id string, status string, created_at int")
    ahead = spark.createDataFrame([("r", "A", month(8), 100.0, 100.0), ("r", "B", month(8), 7.0, 7.0)], "run_id string, item_id string, ts date, baseline_mean double, mean double")
    checked = L.audit_overrides(overrides, plans, ahead)
    assert {r.id: r.rejected for r in checked.collect() if r.rejected} == {"o4": "reason required", "o5": "plan locked", "o6": "unknown item or period"}
    approved = L.approved_plan(ahead, L.active_overrides(checked), plans)
    assert {r.item_id: r.approved for r in approved.collect()} == {"A": 118.0, "B": 0.0}
    actual = spark.createDataFrame([("A", month(8), 120.0)], "item_id string, ts date, actual double")
    fva = {r.item_id: r for r in O.forecast_value_add(actual, approved).collect()}
    assert fva[None].fva_points == pytest.approx(15.0) and fva["A"].observations == 1
    line = L.plan_timeline(
        spark.createDataFrame([("p1", "review", 1, True)], "plan_id string, status string, at int, valid boolean"),
        spark.createDataFrame([("p1", " checked ", 2)], "plan_id string, text string, at int"), overrides,
    ).collect()
    notes = [r.note for r in line if r.plan_id == "p1"]
    assert "Comment: checked" in notes and any("reversed: oops" in n for n in notes)
    assert L.overlay_rollup(approved, ["ts"]).first().approved == 118.0


def test_scenario_scales_and_leaves_the_base(spark):
    base = spark.createDataFrame([("A", month(8), 100.0, 100.0, 80.0, 100.0, 120.0)], "item_id string, ts date, baseline_mean double, mean double, p10 double, p50 double, p90 double")
    up = C.quantity_scenario(base, 10.0, "Higher demand")
    assert up.first()["mean"] == pytest.approx(110.0) and base.first()["mean"] == 100.0
    with pytest.raises(ValueError):
        C.quantity_scenario(up, 5.0, "twice")
    with pytest.raises(ValueError):
        C.quantity_scenario(base, -95.0, "too low")
    with pytest.raises(ValueError):
        C.quantity_scenario(base, 5.0, " ")


def test_drift_reasons(spark):
    rows = [("r1", 1, 10.0, 0.0, 95.0), ("r2", 2, 14.5, 12.0, 89.0), ("r3", 3, 14.0, 1.0, 89.0)]
    runs = spark.createDataFrame(rows, "run_id string, created_at int, wape_pct double, bias_pct double, data_quality_score double")
    out = {r.run_id: r for r in O.drift(O.recent_runs(runs)).collect()}
    assert out["r1"].retrain and "Initial" in out["r1"].reasons
    assert out["r2"].retrain and out["r2"].reasons.count(".") >= 3 and "4.5 points" in out["r2"].reasons
    assert not out["r3"].retrain


def test_run_list_holds_every_run(spark, tmp_path):
    """Thirty months of one part: the eighteen after the first year are runs."""
    lines = [(k, 1, 7, 3, 10.0 + k % 5, 100.0, month(k)) for k in range(30)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = all_queries()["run_list"](spark, str(tmp_path))
    wanted = [f"run-{month(k):%Y-%m}" for k in reversed(range(12, 30))]
    assert [r.run_id for r in out.collect()] == wanted
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        cur = con.execute(all_oracles()["run_list"])
        at = [c[0] for c in cur.description].index("run_id")
        assert sorted(r[at] for r in cur.fetchall()) == sorted(wanted)


def test_gates(spark):
    bom = spark.createDataFrame([("A", "M", 1.0), ("A", "M", -1.0), ("B", "X", None)], "sku string, material_id string, quantity_per_tonne double")
    materials = spark.createDataFrame([("M", "m", 1.0, 1.0, 1.0, float("inf"))], "material_id string, material_name string, inventory_on_hand double, safety_stock double, lead_time_days double, moq double")
    capacity = spark.createDataFrame([("L", "2026-07-01", 1.0), ("L", "2026-07-20", 1.0), ("L", "soon", 1.0)], "production_line string, period string, available_tonnes double")
    found = {r.rule: r.violations for r in Y.operations_gate({"bom": bom, "materials": materials, "capacity": capacity}).collect()}
    assert found["bom_repeated"] == 1 and found["capacity_repeated"] == 1 and found["materials_repeated"] == 0
    assert found["bom_quantity_per_tonne_invalid"] == 2 and found["bom_blank_values"] == 1
    assert found["materials_moq_invalid"] == 1 and found["capacity_period_unreadable"] == 1
    need = spark.createDataFrame([("C", month(6), 1.0)], "sku string, period date, demand double")
    load = spark.createDataFrame([("L", month(7), 1.0)], "production_line string, period date, demand double")
    refs = {(r.rule, r.key) for r in Y.referential_gates(need, load, bom, materials, capacity).collect()}
    assert refs == {("missing_bom", "C"), ("missing_capacity", "L · 2026-08-01"), ("unknown_material", "X")}


def test_receipts_skip_closed_orders(spark):
    pos = spark.createDataFrame(
        [("M", "open", "2026-07-03", 5.0), ("M", "Cancelled", "2026-07-03", 7.0), ("M", None, "2026-07-30", 2.0)],
        "material_id string, status string, due_date string, quantity double",
    )
    assert Y.receipts(pos).first().receipts == 7.0


def test_hierarchy_adds_up_with_a_hot_category(spark):
    items = [(f"i{k}", "hot" if k % 3 else f"c{k}") for k in range(60)]
    ahead = spark.createDataFrame([(i, month(k), 1.0, 1.0, 0.5, 1.0, 2.0) for i, _ in items for k in range(2)], "item_id string, ts date, baseline_mean double, mean double, p10 double, p50 double, p90 double")
    meta = spark.createDataFrame(items, "item_id string, category string")
    rows = V.rollup(ahead, meta, ["category"]).collect()
    assert sum(r["mean"] for r in rows if r.level == "category") == sum(r["mean"] for r in rows if r.level == "all") == 120.0
    assert {r["mean"] for r in rows if r.member == "hot"} == {40.0}


def test_metadata_keeps_the_last_row(spark):
    df = spark.createDataFrame([(1, "A", "s1", " nan ", 5.0), (3, "A", "s2", "food", None), (2, "B", "s3", "", 1.0)], "n int, item string, sku string, cat string, lead_time_days double")
    meta = {r.item_id: r for r in V.series_metadata(df, item_col="item", sku_col="sku", category_col="cat", order_by=["n"]).collect()}
    assert meta["A"].sku == "s2" and meta["A"].category == "food" and meta["A"].lead_time_days is None
    assert meta["B"].category is None
    assert {(r.dimension, r.member) for r in V.dimensions(V.series_metadata(df, item_col="item", category_col="cat", order_by=["n"])).collect()} >= {("category", "food")}


def test_exception_queue_order_and_length(spark):
    diag = spark.createDataFrame(
        [(f"i{k:02d}", 50.0 if k % 2 else 90.0, 20.0, "lumpy", True, 1, True) for k in range(10)],
        "item_id string, quality_score double, bias_pct double, demand_class string, structural_break boolean, isolated_zero_periods int, stockout_suspected boolean",
    )
    evidence = spark.createDataFrame([("limited", "few windows")], "evidence_level string, evidence_reason string")
    warnings = spark.createDataFrame([(f"w{k}: missing future",) for k in range(5)], "warning string")
    queue = Q.exceptions(diag, None, evidence, warnings).collect()
    assert len(queue) == 14 and queue[0].item == "Whole plan"
    assert sum(r.item == "Data input" for r in queue) == 3
    assert Q.exceptions(diag, n=None).count() == 40
    assert Q.worst_first(diag).first().quality_score == 50.0


def test_supply_position_actions(spark):
    meta = spark.createDataFrame(
        [("a", 10.0, 5.0, 100.0), ("b", 0.0, 5.0, 10.0), ("c", 100.0, 5.0, 21.0), ("d", 22.0, 5.0, 100.0), ("e", 100.0, 5.0, None)],
        "item_id string, inventory_on_hand_tonnes double, safety_stock_tonnes double, monthly_capacity_tonnes double",
    )
    ahead = spark.createDataFrame([(i, month(k), 20.0 + k) for i in "abcde" for k in range(2)], FORECAST)
    out = {r.item_id: r for r in Y.supply_position(ahead, meta).collect()}
    assert {k: r.action for k, r in out.items()} == {
        "a": "Expedite supply", "b": "Expedite + add capacity", "c": "Review schedule", "d": "Replenish stock", "e": "No action"}
    assert out["c"].days_cover == pytest.approx(80 / (20 / 30)) and out["e"].capacity_use_pct is None


def test_scenarios_are_read_from_one_written_forecast(spark, monkeypatch):
    from tidemark.plans.catalog import planning as N
    from tidemark.plans.catalog.registry import RAW

    columns = "item_id string, ts date, baseline_mean double, mean double, p10 double, p50 double, p90 double"
    rows = spark.createDataFrame([(i, month(k), 4.0, 4.0, 3.0, 4.0, 6.0) for i in ("a", "b") for k in range(3)], columns)
    written = []
    monkeypatch.setattr(N, "plain_forecast", lambda *_: rows)
    monkeypatch.setattr(N, "metadata", lambda *_: spark.createDataFrame([("a", 9.0), ("b", 1.0)], "item_id string, inventory_on_hand_tonnes double"))
    monkeypatch.setattr(N, "stage", lambda df, name: (written.append(name), df)[1])
    got = {r["run_id"]: (r["total"], r["baseline"], r["change_pct"]) for r in RAW["scenario_compare"](spark, "").collect()}
    assert got == {"base": (24.0, 24.0, None), "up": (30.0, 24.0, 25.0), "down": (12.0, 24.0, -50.0)}
    one = RAW["scenario_summary"](spark, "").first()
    assert (one["closing_stock"], one["total"], one["low"], one["high"]) == (2.0, 24.0, 18.0, 36.0)
    assert written == ["plain", "plain"]
