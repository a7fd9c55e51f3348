import datetime as dt
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.functions.periods import calendar_columns
from tidemark.functions.quantiles import exact_quantile
from tidemark.functions import series_fits
from tidemark.functions.fixed import CROSTON_ALPHA, TSB_ALPHA, TSB_BETA
from tidemark.functions.series_fits import forecast_batch
from tidemark.operators import baselines as B
from tidemark.operators import ensemble as E
from tidemark.operators import features as X
from tidemark.operators import folds as D
from tidemark.operators import future as U
from tidemark.operators import learners as G
from tidemark.operators import metrics as M
from tidemark.operators import profiles as R
from tidemark.plans.forecast_run import Settings, forecast_run, run_tables
from tidemark.session import stage
from tidemark.sources import sinks


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


def panel_of(spark, series):
    rows = [(k, month(i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "item_id string, ts date, target double")


def test_three_folds_of_six(spark):
    folds = D.rolling_folds(panel_of(spark, {"A": range(36)}), "monthly", "deep", 6).orderBy("fold").collect()
    assert [f.fold_h for f in folds] == [6, 6, 6]
    assert folds[0].val_start == month(18) and folds[2].val_end == month(35)


@pytest.mark.parametrize("n, profile, horizon, starts, fold_h", [
    (5, "deep", 6, [4], 1), (10, "deep", 6, [8], 2), (15, "deep", 3, [9, 12], 3), (20, "fast", 3, [17], 3), (30, "fast", 3, [24, 27], 3),
])
def test_folds_of_short_histories(spark, n, profile, horizon, starts, fold_h):
    folds = D.rolling_folds(panel_of(spark, {"A": range(n)}), "monthly", profile, horizon).orderBy("fold").collect()
    assert [f.val_start for f in folds] == [month(i) for i in starts]
    assert folds[-1].val_end == month(n - 1) and folds[0].fold_h == fold_h


def test_metrics(spark):
    rows = spark.createDataFrame([(10.0, 11.0), (20.0, 21.0), (30.0, 31.0)], "actual double, pred double")
    one = M.metrics(rows.withColumn("k", F.lit(1)), ["k"]).first()
    assert abs(one.wape_pct - 5.0) < 1e-9 and one.bias_pct > 0 and one.rmse == 1.0
    none = spark.createDataFrame([(0.0, 2.0), (0.0, 0.0)], "actual double, pred double").withColumn("k", F.lit(1))
    flat = M.metrics(none, ["k"]).first()
    assert flat.wape_pct == 100.0 and flat.bias_pct == 0.0 and flat.smape_pct == 200.0


def test_profiles(spark):
    lumpy = {"A": [0, 0, 8, 0, 0, 0, 7, 0, 0, 6]}
    assert R.demand_class(panel_of(spark, lumpy)).first().demand_class in ("intermittent", "lumpy")
    grown = {"A": [10, 11, 10, 12, 11, 10, 12, 11, 10, 11, 10, 12, 21, 0, 23, 22, 24, 23]}
    row = R.series_profile(panel_of(spark, grown), "monthly", season=6).first()
    assert row.lifecycle == "growth" and row.structural_break and row.isolated_zero_periods == 1 and row.stockout_suspected


def test_short_lifecycle_windows_overlap(spark):
    row = R.lifecycle(panel_of(spark, {"A": [1, 2, 3, 4]}), "monthly").first()
    assert row.earlier_mean == 2.0 and row.recent_mean == 3.0
    assert abs(row.structural_break_score - 1 / np.std([1, 2, 3, 2, 3, 4])) < 1e-9


def naive(y, steps, season):
    seen = list(y)
    for _ in range(steps):
        seen.append(seen[-season] if len(seen) >= season else np.mean(seen[-3:]) if len(seen) >= 3 else seen[-1])
    return seen[len(y):]


def test_exact_models(spark):
    series = {"long": list(range(15)), "short": [4, 9], "ten": [3, 0, 0, 5, 0, 1, 0, 0, 2, 7], "none": [0, 0, 0, 0, 0, 0]}
    made = B.predict_series(D.final_histories(panel_of(spark, series), "monthly", 8), 12).collect()
    got = {(r.item_id, r.model, r.step): r.pred for r in made}
    for name, y in series.items():
        assert [got[name, "Seasonal naive", k] for k in range(8)] == pytest.approx(naive(y, 8, 12))
    assert got["none", "Croston", 0] == 0 and got["none", "TSB intermittent", 5] == 0
    z, p, gap = 3.0, 1.0, 1.0
    for v in series["ten"][1:]:
        if v > 0:
            z, p, gap = 0.12 * v + 0.88 * z, 0.12 * gap + 0.88 * p, 1.0
        else:
            gap += 1
    assert got["ten", "Croston", 3] == pytest.approx(z / p)


def test_statistical_models_follow_clear_patterns():
    t = np.arange(60)
    wave = 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 12)
    ahead = np.arange(60, 66)
    want = 100 + 0.5 * ahead + 20 * np.sin(2 * np.pi * ahead / 12)
    assert np.abs(forecast_batch("AutoETS", [wave], [6], 12)[0] - want).max() < 3
    assert np.abs(forecast_batch("Theta", [wave], [6], 12)[0] - want).mean() < 8
    walk = np.cumsum(np.random.default_rng(1).normal(0, 1, 80)) + 50
    assert np.abs(forecast_batch("AutoARIMA", [walk], [6], 12)[0] - walk[-1]).max() < 6
    for kind, least in (("AutoETS", 5), ("AutoARIMA", 8), ("Theta", 8)):
        short = np.arange(1.0, least)
        assert forecast_batch(kind, [short], [3], 12)[0] == pytest.approx(naive(short, 3, 12))


def test_batches_do_not_mix_series():
    rng = np.random.default_rng(2)
    many = [np.abs(rng.normal(50, 10, n)) for n in (9, 25, 40, 60)]
    for kind in ("AutoETS", "AutoARIMA", "Theta"):
        together = forecast_batch(kind, many, [4] * 4, 12)
        alone = [forecast_batch(kind, [y], [4], 12)[0] for y in many]
        for a, b in zip(together, alone):
            assert a == pytest.approx(b, rel=1e-6)


def test_fits_before_the_search_take_all_series_together(monkeypatch):
    rng = np.random.default_rng(5)
    many = [np.abs(rng.normal(50, 10, 30)) for _ in range(20)]
    slopes = series_fits._slopes(np.array(many))
    assert slopes == pytest.approx([np.polyfit(np.arange(30), y, 1)[0] for y in many])

    def one_by_one(*_args):
        raise AssertionError("a fit for a single series")

    monkeypatch.setattr(np, "polyfit", one_by_one)
    monkeypatch.setattr(np, "convolve", one_by_one)
    for kind in ("AutoETS", "Theta"):
        assert all(np.isfinite(v).all() for v in forecast_batch(kind, many, [4] * 20, 12))


@pytest.mark.parametrize("order", [(1, 1, 0), (1, 1, 1), (2, 1, 0), (1, 0, 1), (0, 1, 2)])
def test_grid_errors_equal_those_of_each_candidate(order):
    rng = np.random.default_rng(6)
    first = np.array([0, 0, 4, 9])
    w = np.where(np.arange(30)[None] >= first[:, None], rng.normal(0, 3, (4, 30)), 0.0)
    w[1, :-1] = 0.0  # every candidate is as good as any other
    k = order[0] + order[2]
    grid = np.stack(np.meshgrid(*[np.linspace(-0.95, 0.95, 7)] * k, indexing="ij"), -1).reshape(-1, k)
    cand = np.broadcast_to(grid[None], (4, *grid.shape))
    each, _, _ = series_fits._arma_sse(w, first, *series_fits._split(cand, order))
    want = np.where(series_fits._stable(cand, order), each, np.inf)
    got = series_fits._grid_sse(w, first, cand, order)
    assert got == pytest.approx(want, rel=1e-9)
    assert (got.argmin(axis=1) == want.argmin(axis=1)).all() and (got[1] == want[1]).all()


def test_recursions_of_a_batch_keep_gaps_and_lengths(spark):
    series = {"null": None, "empty": [], "gap": [0.0, 4.0, None, 0.0, 2.0, None, 0.0], "one": [3.0], "none": [0.0, None], "long": [0.0, 5.0] * 9}
    rows = spark.createDataFrame([(k, v) for k, v in series.items()], "item string, y array<double>").coalesce(1)
    made = rows.select("item", B.croston_values(F.col("y"), F.lit(2)).alias("c"), B.tsb_values(F.col("y"), F.lit(2)).alias("t"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    got = {r.item: r for r in made.collect()}
    for name, y in series.items():
        z, p, gap, y = None, 1.0, 1.0, y or []
        sales = [v for v in y if v]
        size, share = (sales or [0.0])[0], min(1.0, max(0.01, len(sales) / max(len(y), 1)))
        for v in y:
            if v and z is not None:
                z, p = CROSTON_ALPHA * v + (1 - CROSTON_ALPHA) * z, CROSTON_ALPHA * gap + (1 - CROSTON_ALPHA) * p
            elif v:
                z = v
            elif z is None:
                p += 1
            gap = gap + 1 if z is not None and v == 0 else 1.0
            size = TSB_ALPHA * v + (1 - TSB_ALPHA) * size if v else size
            share = (TSB_BETA if v else 0.0) + (1 - TSB_BETA) * share
        assert got[name].c == pytest.approx([(z or 0.0) / p] * 2), name
        assert got[name].t == pytest.approx([size * share] * 2), name


def test_worker_functions_need_no_installed_package(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(forecast_batch))
    code = (
        "import pickle, numpy as np; f = pickle.load(open('f.pkl', 'rb'));"
        "print(len(f('Theta', [np.arange(20.0)], [4], 12)[0]))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("4"), done.stderr


@pytest.mark.parametrize("n", [3, 57, 25_000])
def test_exact_quantile_with_a_hot_value(spark, n):
    rng = random.Random(n)
    rows = [(i % 3, 7.25 if rng.random() < 0.4 else rng.random() * 10) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v double")
    whole = exact_quantile(df, [], "v", 0.8, "q").first()
    assert whole.n == n and whole.q == pytest.approx(float(np.quantile([v for _, v in rows], 0.8)), abs=1e-12)
    for r in exact_quantile(df, ["k"], "v", 0.8, "q").collect():
        assert r.q == pytest.approx(float(np.quantile([v for k, v in rows if k == r.k], 0.8)), abs=1e-12)


def test_direct_frame_reaches_the_horizon(spark):
    panel = X.with_position(panel_of(spark, {"A": 100 + np.sin(np.arange(36)) * 10}))
    frame = X.direct_frame(panel, [1, 2, 3, 6, 12], 6)
    steps = {int(r.forecast_step): r["count"] for r in frame.groupBy("forecast_step").count().collect()}
    assert steps == {k: 24 - k + 1 for k in range(1, 7)}


def test_weights_sum_to_one_and_gate_picks_the_best(spark):
    rows = []
    for i in range(6):
        rows += [("A", month(i), i, "Seasonal naive", 10.0, 10.0), ("A", month(i), i, "Croston", 10.0, 11.0)]
        rows += [("B", month(i), i, "Seasonal naive", 10.0, 11.0), ("B", month(i), i, "Croston", 10.0, 9.0)]
    records = spark.createDataFrame(rows, "item_id string, ts date, step int, model string, actual double, pred double")
    weights = E.series_weights(records).collect()
    by_item = {i: [w for w in weights if w.item_id == i] for i in "AB"}
    assert [(w.model, w.weight, w.gated) for w in by_item["A"]] == [("Seasonal naive", 1.0, True)]
    assert sum(w.weight for w in by_item["B"]) == pytest.approx(1.0) and len(by_item["B"]) == 2
    with pytest.raises(ValueError):
        E.series_weights(records, "astrology")


def history_with_driver(spark):
    rows = [("A", month(i), float(i), 50.0 + i) for i in range(12)]
    return spark.createDataFrame(rows, "item_id string, ts date, target double, rate double")


def test_future_policies(spark):
    history = history_with_driver(spark)
    with pytest.raises(ValueError, match="Future values are missing"):
        U.future_covariates(history, drivers=["rate"], horizon=3)
    carried = U.future_covariates(history, drivers=["rate"], horizon=3, policy="carry")
    assert [r.rate for r in carried.collect()] == [61.0] * 3
    assert U.driver_coverage(carried, ["rate"], "carry").first().assumed == 3
    assert U.future_covariates(history, drivers=["rate"], horizon=1, policy="median").first().rate == 55.5
    twice = spark.createDataFrame([("2021-01-02", 2.0), ("2021-01-20", 3.0)], "date string, rate double")
    with pytest.raises(ValueError, match="one row"):
        U.future_covariates(history, twice, drivers=["rate"], horizon=1, date_col="date")
    given = spark.createDataFrame([("2021-01-02", 2.0)], "date string, rate double")
    row = U.future_covariates(history, given, drivers=["rate"], horizon=2, policy="carry", date_col="date").orderBy("ts").collect()
    assert [(r.rate, r.rate_source) for r in row] == [(2.0, "provided"), (61.0, "assumed")]


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) * [3.0, 0.5] + [10, -2]
    y = x @ [1.5, -4.0] + rng.normal(size=60)
    rows = [("A", float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    frame = stage(spark.createDataFrame(rows, "item_id string, lag_1 double, lag_2 double, y double"), "ridge")
    model = G.fit_global(frame, "fast", ["Ridge + drivers"])["Ridge + drivers"]
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(60)]
    # one item gives one constant column, which the intercept absorbs
    beta = np.linalg.solve(z.T @ z + np.diag([2.0, 2.0, 0.0]), z.T @ y)
    got = [r.pred for r in model.transform(frame).select("lag_1", "lag_2", "pred").collect()]
    assert sorted(got) == pytest.approx(sorted(z @ beta), abs=1e-9)


def test_learners_need_rows(spark):
    frame = spark.createDataFrame([("A", 1.0, 2.0)] * 5, "item_id string, lag_1 double, y double")
    assert G.fit_global(frame, "fast") == {}


def test_whole_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    t = np.arange(48)
    series = {f"I{k}": np.maximum(0, 50 + 10 * k + 15 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 3, 48)) for k in range(4)}
    series["sparse"] = np.where(rng.random(48) < 0.3, 20.0, 0.0)
    panel = panel_of(spark, series).withColumn("price", F.month("ts").cast("double"))
    ahead = U.future_covariates(panel, drivers=["price"], horizon=6, policy="carry", calendar=False)
    settings = Settings(profile="fast", horizon=6, drivers=["price"], learners=["Ridge + drivers"], adjustment_pct=10.0)
    run = forecast_run(panel, ahead, settings)
    rows = run.forecast.collect()
    assert len(rows) == 5 * 6
    assert all(0 <= r.p10 <= r.p50 <= r.p90 for r in rows)
    assert all(r["mean"] == pytest.approx(r.baseline_mean * 1.1) for r in rows)
    assert {r.model for r in run.leaderboard.collect()} == set(settings.series_methods) | {"Ridge + drivers"}
    for r in run.weights.groupBy("item_id").agg(F.sum("weight").alias("w")).collect():
        assert r.w == pytest.approx(1.0)
    total = {r.ts: r["mean"] for r in run.portfolio.collect()}
    assert sum(total.values()) == pytest.approx(sum(r["mean"] for r in rows))
    assert run.metrics.first().evidence_level == "moderate"
    assert run.drivers.first().feature == "price"
    sinks.write_run("r1", run_tables(run, panel, ahead, settings), str(tmp_path))
    assert sinks.read_run_table(spark, str(tmp_path), "forecast").filter("run_id = 'r1'").count() == 30
    with pytest.raises(Exception):
        sinks.write_run("r1", {"forecast": run.forecast}, str(tmp_path))


def test_learners_stand_aside_on_a_tiny_panel(spark):
    panel = panel_of(spark, {"A": [5, 6, 7, 8, 9, 10, 11, 12]})
    ahead = U.future_covariates(panel, horizon=2, calendar=False)
    settings = Settings(profile="fast", horizon=2, learners=["Ridge + drivers"], statistical=[])
    run = forecast_run(panel, ahead, settings)
    made = run.predictions.filter("model = 'Ridge + drivers'").orderBy("ts").collect()
    assert [r.pred for r in made] == pytest.approx([11.0, 34 / 3])
    assert run.metrics.first().evidence_level == "limited" and run.forecast.count() == 2


def test_a_method_without_fitted_models_is_an_error():
    with pytest.raises(ValueError, match="available: Seasonal naive"):
        Settings(method="model:AutoETS", statistical=[])
    assert Settings(method="model:AutoETS").method == "model:AutoETS"


@pytest.mark.parametrize("n, features", [(15, set()), (400, {"price", "noise"})])
def test_importance_counts_every_item(spark, n, features):
    # the last item by name does not react to the price, all others do
    rng = np.random.default_rng(8)
    rows = [
        ("Z" if i % 10 == 0 else f"A{i % 7}", i // 7, 1, float(p), float(q), 5.0 if i % 10 == 0 else float(p) * 3)
        for i, (p, q) in enumerate(rng.random((n, 2)) * 10)
    ]
    frame = spark.createDataFrame(rows, "item_id string, origin_idx int, forecast_step int, price double, noise double, y double")
    frame = stage(frame, "importance")
    name = "Ridge + drivers"
    found = G.driver_importance(G.fit_global(frame, "fast", [name]), frame, {name: 1.0}, ["price", "noise"]).collect()
    assert {r.feature for r in found} == features
    if found:
        assert found[0].feature == "price" and found[0].importance > 10 * found[1].importance and found[0].direction == "up"


def test_settings_are_checked():
    for bad in ({"horizon": 25}, {"profile": "slow"}, {"method": "magic"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_calendar_columns_are_features(spark):
    panel = X.with_position(panel_of(spark, {"A": range(30)}).withColumns(calendar_columns("monthly")))
    frame = X.direct_frame(panel, [1], 2, list(calendar_columns("monthly")))
    assert set(calendar_columns("monthly")) <= set(G.feature_columns(frame)[0])


def test_exponential_means_over_batches_gaps_and_nulls(spark):
    r = random.Random(4)
    rows = [(f"i{i}", dt.date(2000, 1, 1) + dt.timedelta(days=d), None if r.random() < 0.1 else r.random() * 9) for i in range(9) for d in range(i * 11)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = X.add_ewm(spark.createDataFrame(rows, "item_id string, ts date, target double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    held = {}
    for item, _, y in rows:
        held.setdefault(item, []).append(y)
    for g in got:
        for span in (3, 6, 12):
            past = [y for y in held[g["item_id"]][max(0, g["idx"] - 3 * span) : g["idx"]] if y is not None]
            want = past[0] if past else None
            for y in past[1:]:
                want = 2.0 / (span + 1.0) * y + (1.0 - 2.0 / (span + 1.0)) * want
            assert g[f"ewm_{span}"] == want
