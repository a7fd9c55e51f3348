import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.periods import add_calendar, lag_set, working_days
from tidemark.operators import cleaning as K


def month(i, year=2025):
    return dt.date(year + i // 12, i % 12 + 1, 1)


def panel_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, ts date, target double")


def test_gap_is_repaired_and_outlier_flagged(spark):
    days = [(1, 10), (2, 11), (4, 13), (5, 12), (6, 11), (7, 12), (8, 400), (9, 12)]
    raw = spark.createDataFrame([(f"2025-{m:02d}-01", "A", float(v)) for m, v in days], "date string, item string, demand double")
    clean = K.prepare_history(raw, date_col="date", target_col="demand", item_col="item")
    rows = {r.ts: r for r in clean.collect()}
    assert abs(rows[dt.date(2025, 3, 1)].target - (11 + 2 * 28 / 59)) < 1e-9
    assert sum(r.was_imputed for r in rows.values()) == 1
    assert sum(r.was_outlier for r in rows.values()) == 1


def test_midmonth_rows_align(spark):
    raw = spark.createDataFrame([(dt.date(2025, m, 15), m * 10.0) for m in range(1, 7)], "date date, qty double")
    clean = K.prepare_history(raw, date_col="date", target_col="qty", outliers="none").orderBy("ts").collect()
    assert [r.target for r in clean] == [10, 20, 30, 40, 50, 60]
    assert all(r.ts.day == 1 and r.item_id == "Total demand" for r in clean)


def test_merged_states_equal_the_rollup_of_joined_rows(spark):
    rows = [
        (n, f"k{n % 7}", f"2025-{n % 3 + 1:02d}-{n % 27 + 1:02d}", float(n % 5), None if n % 11 == 0 else n / 100, None if n % 13 == 0 else f"t{n % 4}")
        for n in range(200)
    ] + [(900, "k1", "2026-01-01", 1.0, None, "t"), (901, "k2", "2026-01-02", 1.0, None, None), (902, "k3", "2026-02-01", 1.0, 1e-15, "t"), (903, "k4", "2026-02-01", 1.0, 1e19, "t")]
    raw = spark.createDataFrame(rows, "n long, key string, d string, q double, price double, flag string")
    groups = spark.createDataFrame([(f"k{i}", f"g{i % 2}") for i in range(6)], "key string, g string")  # k6 has no group
    named = dict(date_col="d", target_col="q", drivers=["price", "flag"], order_by=["n"])
    want = K.period_rollup(K.canonicalize(raw.join(groups, "key"), item_col="g", **named), "monthly", ["price"], ["flag"])
    states = K.rollup_states(K.canonicalize(raw, item_col="key", **named), "monthly", ["price"], ["flag"])
    joined = states.join(groups, F.col("item_id") == F.col("key")).withColumn("item_id", F.col("g")).drop("g", "key")
    got = K.merge_states(joined, ["price"], ["flag"])
    assert got.columns == want.columns
    key = lambda r: (r.item_id, r.ts)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) > 8 and {r.price for r in b if r.ts == dt.date(2026, 2, 1)} == {1e-15, 1e19}
    for x, y in zip(a, b):
        assert (x.item_id, x.ts, x.target, x.flag, x.source_rows) == (y.item_id, y.ts, y.target, y.flag, y.source_rows)
        assert x.price == (None if y.price is None else pytest.approx(y.price, rel=1e-12))
    assert K.merge_states(K.rollup_states(K.canonicalize(raw.limit(0), item_col="key", **named), "monthly", ["price"], ["flag"]), ["price"], ["flag"]).count() == 0


def test_negatives_are_clipped_after_summing(spark):
    raw = spark.createDataFrame(
        [("2025-01-03", "5"), ("2025-01-09", "-8"), ("2025-02-01", "-2"), ("2025-02-02", "7"), ("bad", "1"), ("2025-02-03", "x")],
        "d string, q string",
    )
    rolled = K.clip_negative(K.period_rollup(K.drop_invalid(K.canonicalize(raw, date_col="d", target_col="q")), "monthly"))
    assert {r.ts.month: r.target for r in rolled.collect()} == {1: 0.0, 2: 5.0}
    assert K.invalid_rows(K.canonicalize(raw, date_col="d", target_col="q")).first().invalid_rows == 2


def test_strategies_and_text_driver(spark):
    raw = spark.createDataFrame(
        [("A", dt.date(2025, 1, 1), 0.0, "x", 1.0), ("A", dt.date(2025, 2, 1), 4.0, None, None), ("A", dt.date(2025, 5, 1), 6.0, "z", 4.0)],
        "i string, d date, q double, t string, n double",
    )
    base = K.canonicalize(raw, date_col="d", target_col="q", item_col="i", drivers=["t", "n"])
    rolled = K.period_rollup(base, "monthly", ["n"], ["t"])
    auto = K.regularize(rolled, "monthly", "auto", ["n", "t"])
    values = [r.target for r in auto.orderBy("ts").collect()]
    assert values == [0, 4, 0, 0, 6]
    assert {r.strategy_used for r in auto.collect()} == {"zero"}
    carried = [r.target for r in K.regularize(rolled, "monthly", "carry").orderBy("ts").collect()]
    assert carried == [0, 4, 4, 4, 6]
    filled = K.fill_drivers(auto, ["n"], ["t"]).orderBy("ts").collect()
    assert [r.n for r in filled] == [1.0, 1.75, 2.5, 3.25, 4.0]
    assert [r.t for r in filled] == ["x", "x", "x", "x", "z"]


def test_weekly_and_daily_periods(spark):
    raw = spark.createDataFrame([("A", dt.date(2025, 1, 1), 1.0), ("A", dt.date(2025, 1, 22), 2.0)], "i string, d date, q double")
    base = K.canonicalize(raw, date_col="d", target_col="q", item_col="i")
    weeks = K.regularize(K.period_rollup(base, "weekly"), "weekly", "carry").orderBy("ts").collect()
    assert [r.ts for r in weeks] == [dt.date(2024, 12, 30) + dt.timedelta(7 * k) for k in range(4)]
    assert K.regularize(K.period_rollup(base, "daily"), "daily", "zero").count() == 22


def test_only_actuals(spark):
    df = spark.createDataFrame([("Actual", 1), ("forecast", 2)], "record_type string, v int")
    assert [r.v for r in K.only_actuals(df).collect()] == [1]
    assert K.only_actuals(df.filter("v = 2")).count() == 1


def test_driver_types_count_nulls_as_not_numeric(spark):
    df = spark.createDataFrame([("1", "1"), ("2", None), ("3", "3"), ("4", "x"), ("5", "5")], "a string, b string")
    typed, numeric, text = K.coerce_drivers(df, ["a", "b"])
    assert (numeric, text) == (["a"], ["b"])
    assert typed.filter("b = 'Unknown'").count() == 1


def test_quality_gate_reports_every_rule(spark):
    df = spark.createDataFrame(
        [("2025-01-01", "-1", "A"), ("bad", "inf", " "), ("2025-01-02", None, None)], "d string, q string, i string"
    )
    gate = K.quality_gate(df, {"date_col": "d", "target_col": "q", "item_col": "i", "drivers": ["q", "zz"], "horizon": 30})
    found = {r.rule: r.violations for r in gate.collect()}
    assert found["unreadable_dates"] == 1 and found["negative_quantities"] == 1 and found["missing_quantities"] == 1
    assert found["infinite_quantities"] == 1 and found["blank_items"] == 2
    assert found["drivers_missing"] == 1 and found["drivers_overlap_roles"] == 1 and found["horizon_domain"] == 1


def test_length_gate_and_summary(spark):
    panel = panel_of(spark, [("A", month(i), float(i)) for i in range(8)])
    assert K.length_gate(panel).first().level == "warning"
    one = K.history_summary(panel.withColumns({"was_imputed": F.lit(False), "was_outlier": F.lit(False)})).first()
    assert one.shortest_series == 8 and one.data_quality_score == 88.0 and one.zero_share == 0.125


def test_calendar_names(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, 3),)], "ts date")
    row = add_calendar(days, "daily").first()
    assert row.calendar_is_weekend == 1.0 and "calendar_year_sin_2" in row and "calendar_week_sin" in row
    assert "calendar_quarter" in add_calendar(days, "monthly").columns


def test_lags_follow_length():
    assert lag_set("monthly", 7) == [1, 2, 3]
    assert lag_set("monthly", 17) == [1, 2, 3, 4, 6]
    assert lag_set("monthly", 28) == [1, 2, 3, 4, 6, 12, 24]
    assert lag_set("monthly", 3) == [1, 2]


def test_working_days_without_friday(spark):
    months = spark.createDataFrame([(dt.date(2026, 3, 1),)], "month date")
    closed = spark.createDataFrame([(dt.date(2026, 3, 2),), (dt.date(2026, 3, 6),)], "holiday date")
    assert working_days(months, closed).first().working_days == 31 - 4 - 1


def test_unknown_arguments_are_refused(spark):
    df = panel_of(spark, [("A", month(0), 1.0)])
    with pytest.raises(ValueError):
        K.regularize(df, "monthly", "guess")
    with pytest.raises(ValueError):
        K.period_rollup(df, "yearly")
    with pytest.raises(ValueError):
        K.canonicalize(df, date_col="nope", target_col="target")


def test_more_rows_make_more_tasks_of_whole_items(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK_ROWS", 20)
    rows = [(f"i{i}", dt.date(2000, 1, 1) + dt.timedelta(days=3 * d), float(d)) for i in range(100) for d in range(10)]
    rolled = K.whole_items(spark.createDataFrame(rows, "item_id string, ts date, target double"))
    assert rolled.rdd.getNumPartitions() == 50
    panel = K.winsorize(K.regularize(rolled, "daily")).withColumn("task", F.spark_partition_id())
    places = panel.groupBy("item_id").agg(F.count_distinct("task").alias("n"), F.count("*").alias("rows")).collect()
    assert len(places) == 100 and {(p["n"], p["rows"]) for p in places} == {(1, 28)}
    assert panel.select("task").distinct().count() > 30
