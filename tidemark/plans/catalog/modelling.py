"""Queries on features, diagnostics, folds, exact models, weights and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.periods import season_length
from ...operators import baselines as B
from ...operators import cleaning as K
from ...operators import ensemble as E
from ...operators import features as X
from ...operators import folds as D
from ...operators import intervals as I
from ...operators import metrics as M
from ...operators import profiles as R
from ...session import stage
from . import panels as P
from .registry import query, sql, view

H = 6
S = season_length("monthly")

# --- features -----------------------------------------------------------------

view("part_idx", "SELECT item_id, ts, target, row_number() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS idx FROM part_panel", "part_panel")
view("brand_idx", "SELECT item_id, ts, target, row_number() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS idx FROM brand_panel", "brand_panel")


def _past(k: int) -> str:
    return f"(PARTITION BY item_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


_LAGS = [1, 2, 3, 4, 6, 12, 24]
_LAG_SQL = ", ".join(f"lag(target, {k}) OVER (PARTITION BY item_id ORDER BY ts) AS lag_{k}" for k in _LAGS)
_ROLL_SQL = ", ".join(
    f"avg(target) OVER {_past(k)} AS rolling_mean_{k}, median(target) OVER {_past(k)} AS rolling_median_{k}, "
    f"coalesce(avg(CASE WHEN target > 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER {_past(k)}, 0) AS nonzero_rate_{k}"
    for k in (2, 3, 6, 12)
) + ", " + ", ".join(
    f"CASE WHEN count(target) OVER {_past(k)} >= 2 THEN stddev_pop(target) OVER {_past(k)} ELSE 0 END AS rolling_std_{k}" for k in (3, 6)
)
_ROLL_NAMES = " ".join(f"rolling_mean_{k} rolling_median_{k} nonzero_rate_{k}" for k in (2, 3, 6, 12)) + " rolling_std_3 rolling_std_6"
_EWM_SQL = ", ".join(
    f"CASE WHEN idx > 0 THEN list_reduce(list(target) OVER {_past(3 * s)}, lambda a, v: {2.0 / (s + 1)!r}::DOUBLE * v + {1 - 2.0 / (s + 1)!r}::DOUBLE * a) END AS ewm_{s}"
    for s in (3, 6, 12)
)
_LEVEL_SQL = f"""
    CASE WHEN idx >= 4 AND abs(avg(target) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING)) > 1e-9
         THEN avg(target) OVER {_past(2)} / avg(target) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING) - 1 ELSE 0 END AS recent_momentum,
    idx - coalesce(max(CASE WHEN target > 1e-9 THEN idx END) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS zero_run_length,
    CASE WHEN idx >= 12 AND abs(avg(target) OVER {_past(12)}) > 1e-9 THEN avg(target) OVER {_past(3)} / avg(target) OVER {_past(12)} ELSE 1 END AS seasonal_level_ratio"""
_LEVEL_NAMES = "recent_momentum zero_run_length seasonal_level_ratio"
_KEYS = ("item_id", "ts", "idx")


def _featured(columns):
    def run(spark, d):
        base = X.with_position(P.part_panel(spark, d).select("item_id", "ts", "target"))
        return base.withColumns(columns()).drop("target")

    return run


query("lag_features", sql(f"SELECT item_id, ts, idx, {_LAG_SQL} FROM part_idx", "part_idx",
                          doubles=" ".join(f"lag_{k}" for k in _LAGS)))(_featured(lambda: X.lag_features(_LAGS)))
query("rolling_features", sql(f"SELECT item_id, ts, idx, {_ROLL_SQL} FROM part_idx", "part_idx",
                              doubles=_ROLL_NAMES))(
    lambda spark, d: X.add_rolling(X.with_position(P.part_panel(spark, d).select("item_id", "ts", "target"))).drop("target"))


# whole-number history: values that end in an exact half then round alike in both engines
view("whole_idx", "SELECT item_id, ts, target, row_number() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS idx FROM part_zero_regular", "part_zero_regular")


@query("ewm_features", sql(f"SELECT item_id, ts, idx, {_EWM_SQL} FROM whole_idx", "whole_idx", doubles="ewm_3 ewm_6 ewm_12"))
def _(spark, d):
    return X.add_ewm(K.regularize(P.rolled(spark, d, "l_partkey"), "monthly", "zero").select("item_id", "ts", "target")).drop("target")


query("level_features", sql(f"SELECT item_id, ts, idx, {_LEVEL_SQL} FROM part_idx", "part_idx",
                            doubles=_LEVEL_NAMES))(_featured(X.level_features))

view("brand_full", """
    SELECT b.item_id, b.ts, b.target, b.idx, r.l_discount FROM brand_idx b JOIN brand_rolled r USING (item_id, ts)""",
     "brand_idx", "brand_rolled")
view("brand_features", f"SELECT item_id, ts, idx, {_LAG_SQL}, {_ROLL_SQL}, {_EWM_SQL}, {_LEVEL_SQL} FROM brand_full", "brand_full")
_ALL = " ".join(f"lag_{k}" for k in _LAGS) + f" {_ROLL_NAMES} ewm_3 ewm_6 ewm_12 {_LEVEL_NAMES}"


@query("direct_frame", sql(f"""
    SELECT f.* RENAME (ts AS origin_ts, idx AS origin_idx), t.ts, CAST(t.idx - f.idx + 1 AS DOUBLE) AS forecast_step,
           CAST(t.idx AS DOUBLE) AS time_idx, t.l_discount, t.target AS y
    FROM brand_features f JOIN brand_full t ON f.item_id = t.item_id AND t.idx BETWEEN f.idx AND f.idx + {H - 1}
    WHERE f.idx >= 24""", "brand_features", "brand_full", doubles=_ALL + " l_discount y"))
def _(spark, d):
    panel = X.with_position(P.brand_panel(spark, d).select("item_id", "ts", "target", "l_discount"))
    return X.direct_frame(panel, _LAGS, H, ["l_discount"])


@query("tail_history", sql("""
    SELECT item_id, ts, target FROM part_panel QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) <= 48""",
    "part_panel", doubles="target"))
def _(spark, d):
    return X.tail_per_item(P.part_panel(spark, d)).select("item_id", "ts", "target")


@query("tail_portfolio", sql("""
    SELECT ts, sum(target) AS target FROM part_panel GROUP BY ts ORDER BY ts DESC LIMIT 48""", "part_panel", doubles="target"))
def _(spark, d):
    return X.tail_portfolio(P.part_panel(spark, d))


@query("history_head", sql("SELECT item_id, ts, target FROM part_panel ORDER BY item_id, ts LIMIT 8", "part_panel", doubles="target"))
def _(spark, d):
    return K.canonical_head(P.part_panel(spark, d))


# --- diagnostics ----------------------------------------------------------------

view("part_class", """
    SELECT item_id, count(*) AS history_points, avg(CASE WHEN target > 1e-9 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS zero_share,
           CASE WHEN count(*) FILTER (WHERE target > 1e-9) >= 2
                THEN (max(CASE WHEN target > 1e-9 THEN idx END) - min(CASE WHEN target > 1e-9 THEN idx END))::DOUBLE / (count(*) FILTER (WHERE target > 1e-9) - 1)
                ELSE count(*) END AS average_demand_interval,
           CASE WHEN count(*) FILTER (WHERE target > 1e-9) >= 2
                THEN pow(stddev_pop(target) FILTER (WHERE target > 1e-9) / greatest(avg(target) FILTER (WHERE target > 1e-9), 1e-9::DOUBLE), 2)
                ELSE 0 END AS squared_coefficient_variation
    FROM part_idx GROUP BY item_id""", "part_idx")


@query("demand_class", sql("""
    SELECT *, CASE WHEN average_demand_interval < 1.32 THEN CASE WHEN squared_coefficient_variation < 0.49 THEN 'smooth' ELSE 'erratic' END
                   ELSE CASE WHEN squared_coefficient_variation < 0.49 THEN 'intermittent' ELSE 'lumpy' END END AS demand_class
    FROM part_class""", "part_class", doubles="zero_share average_demand_interval squared_coefficient_variation"))
def _(spark, d):
    return R.demand_class(P.part_panel(spark, d))


@query("seasonality", sql(f"""
    SELECT item_id, CASE WHEN n >= {2 * S} AND isfinite(c) THEN greatest(0, least(1, c)) ELSE 0 END AS seasonality_strength FROM (
      SELECT item_id, count(*) AS n, CASE WHEN stddev_pop(CASE WHEN p IS NOT NULL THEN target END) > 1e-9 AND stddev_pop(p) > 1e-9 THEN corr(target, p) END AS c FROM (
        SELECT item_id, target, lag(target, {S}) OVER (PARTITION BY item_id ORDER BY ts) AS p FROM part_idx) GROUP BY item_id)""",
    "part_idx", doubles="seasonality_strength"))
def _(spark, d):
    return R.seasonality(P.part_panel(spark, d), "monthly")


@query("stockout_flags", sql("""
    SELECT item_id, count(*) FILTER (WHERE target <= 1e-9 AND b > 1e-9 AND a > 1e-9) AS isolated_zero_periods,
           count(*) FILTER (WHERE target <= 1e-9 AND b > 1e-9 AND a > 1e-9) > 0 AS stockout_suspected FROM (
      SELECT item_id, target, lag(target) OVER (PARTITION BY item_id ORDER BY ts) AS b, lead(target) OVER (PARTITION BY item_id ORDER BY ts) AS a FROM part_idx)
    GROUP BY item_id""", "part_idx"))
def _(spark, d):
    return R.isolated_zeros(P.part_panel(spark, d))


view("part_sides", f"""
    SELECT item_id, n, w, list_slice(v, CASE WHEN n >= 2 * w THEN n - 2 * w + 1 ELSE 1 END, CASE WHEN n >= 2 * w THEN n - w ELSE w END) AS e,
           list_slice(v, greatest(n - w + 1, 1), n) AS r FROM (
      SELECT item_id, list(target ORDER BY ts) AS v, count(*) AS n, greatest(3, least({S}, count(*) // 3)) AS w FROM part_idx GROUP BY item_id)""", "part_idx")
view("part_life", """
    SELECT item_id, n AS history_points, em AS earlier_mean, rm AS recent_mean, abs(rm - em) / greatest(sd, 1e-9::DOUBLE) AS structural_break_score,
           abs(rm - em) / greatest(sd, 1e-9::DOUBLE) >= 0.8 AND abs(rm - em) / greatest(abs(em), 1e-9::DOUBLE) >= 0.15 AS structural_break,
           CASE WHEN n < 12 THEN 'new' WHEN rm > em * 1.15::DOUBLE THEN 'growth' WHEN rm < em * 0.85::DOUBLE THEN 'decline' ELSE 'mature' END AS lifecycle
    FROM (SELECT item_id, n, list_avg(e) AS em, list_avg(r) AS rm, list_stddev_pop(e || r) AS sd FROM part_sides)""", "part_sides")


@query("lifecycle", sql("SELECT * FROM part_life", "part_life", doubles="earlier_mean recent_mean structural_break_score"))
def _(spark, d):
    return R.lifecycle(P.part_panel(spark, d), "monthly")


# --- folds and exact models --------------------------------------------------------


def fold_views(name: str, horizon: int, most: int = 3) -> None:
    """Fold windows of a monthly panel with at least twenty dates, and its training lists."""
    view(f"{name}_dates", f"SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {name}_panel)", f"{name}_panel")
    view(f"{name}_folds", f"""
    SELECT k + 1 AS fold, (SELECT ts FROM {name}_dates WHERE i = o) AS val_start, (SELECT ts FROM {name}_dates WHERE i = o + h - 1) AS val_end, h AS fold_h FROM (
      SELECT h, k, n - cnt * h + k * h AS o, mt FROM (
        SELECT n, mt, h, least({most}, greatest(1, (n - mt) // h)) AS cnt, unnest(range(least({most}, greatest(1, (n - mt) // h)))) AS k FROM (
          SELECT n, CASE WHEN n >= {S + 8} THEN {S + 4} ELSE 8 END AS mt, least({horizon}, greatest(1, n - CASE WHEN n >= {S + 8} THEN {S + 4} ELSE 8 END)) AS h
          FROM (SELECT max(n) AS n FROM {name}_dates)))) WHERE o >= mt""", f"{name}_dates")
    view(f"{name}_hist", f"""
    SELECT f.fold, p.item_id, list(p.target ORDER BY p.ts) FILTER (WHERE p.ts < f.val_start) AS y,
           count(*) FILTER (WHERE p.ts BETWEEN f.val_start AND f.val_end) AS m
    FROM {name}_panel p JOIN {name}_folds f ON p.ts <= f.val_end GROUP BY 1, 2
    HAVING count(*) FILTER (WHERE p.ts < f.val_start) > 0 AND count(*) FILTER (WHERE p.ts BETWEEN f.val_start AND f.val_end) > 0""", f"{name}_folds")
    view(f"{name}_valid", f"""
    SELECT f.fold, p.item_id, p.ts, p.target AS actual, row_number() OVER (PARTITION BY f.fold, p.item_id ORDER BY p.ts) AS k
    FROM {name}_panel p JOIN {name}_folds f ON p.ts BETWEEN f.val_start AND f.val_end""", f"{name}_folds")
    model_views(name)


def model_views(name: str) -> None:
    """Predictions of the three exact models from ``<name>_hist`` and ``<name>_valid``."""
    view(f"{name}_naive", f"""
    SELECT fold, item_id, 1 AS k, y AS seen, m,
           CASE WHEN len(y) >= {S} THEN y[len(y) - {S - 1}] WHEN len(y) >= 3 THEN (y[len(y) - 2] + y[len(y) - 1] + y[len(y)]) / 3.0::DOUBLE ELSE y[len(y)] END AS pred
    FROM {name}_hist
    UNION ALL
    SELECT fold, item_id, k + 1, s2, m,
           CASE WHEN len(s2) >= {S} THEN s2[len(s2) - {S - 1}] WHEN len(s2) >= 3 THEN (s2[len(s2) - 2] + s2[len(s2) - 1] + s2[len(s2)]) / 3.0::DOUBLE ELSE s2[len(s2)] END
    FROM (SELECT fold, item_id, k, list_append(seen, pred) AS s2, m FROM {name}_naive WHERE k < m)""", f"{name}_hist")
    view(f"{name}_croston", f"""
    SELECT fold, item_id, CASE WHEN s.z IS NULL THEN 0 ELSE s.z / greatest(s.p, 1e-9::DOUBLE) END AS pred FROM (
      SELECT fold, item_id, list_reduce(list_transform(y, lambda v: {{'v': v, 'z': NULL::DOUBLE, 'p': 0.0::DOUBLE, 'g': 1.0::DOUBLE}}),
        lambda a, b: {{'v': b.v,
          'z': CASE WHEN a.z IS NULL THEN CASE WHEN b.v > 1e-9 THEN b.v END WHEN b.v > 1e-9 THEN 0.12::DOUBLE * b.v + 0.88::DOUBLE * a.z ELSE a.z END,
          'p': CASE WHEN a.z IS NULL THEN a.p + 1 WHEN b.v > 1e-9 THEN 0.12::DOUBLE * a.g + 0.88::DOUBLE * a.p ELSE a.p END,
          'g': CASE WHEN a.z IS NULL OR b.v > 1e-9 THEN 1 ELSE a.g + 1 END}},
        {{'v': 0.0::DOUBLE, 'z': NULL::DOUBLE, 'p': 0.0::DOUBLE, 'g': 1.0::DOUBLE}}) AS s FROM {name}_hist)""", f"{name}_hist")
    view(f"{name}_tsb", f"""
    SELECT fold, item_id, CASE WHEN z0 IS NULL THEN 0 ELSE s.p * s.z END AS pred FROM (
      SELECT fold, item_id, z0, list_reduce(list_transform(y, lambda v: {{'v': v, 'z': 0.0::DOUBLE, 'p': 0.0::DOUBLE}}),
        lambda a, b: {{'v': b.v,
          'z': CASE WHEN b.v > 1e-9 THEN 0.18::DOUBLE * b.v + 0.82::DOUBLE * a.z ELSE a.z END,
          'p': CASE WHEN b.v > 1e-9 THEN 0.12::DOUBLE ELSE 0 END + 0.88::DOUBLE * a.p}},
        {{'v': 0.0::DOUBLE, 'z': z0, 'p': p0}}) AS s FROM (
          SELECT fold, item_id, y, list_filter(y, lambda v: v > 1e-9)[1] AS z0,
                 least(1, greatest(0.01, len(list_filter(y, lambda v: v > 1e-9))::DOUBLE / len(y)))::DOUBLE AS p0 FROM {name}_hist))""", f"{name}_hist")
    view(f"{name}_records", f"""
    SELECT v.fold, v.item_id, v.ts, v.k - 1 AS pos, v.actual, 'Seasonal naive' AS model, greatest(n.pred, 0) AS pred FROM {name}_valid v JOIN {name}_naive n USING (fold, item_id, k)
    UNION ALL SELECT v.fold, v.item_id, v.ts, v.k - 1, v.actual, 'Croston', greatest(c.pred, 0) FROM {name}_valid v JOIN {name}_croston c USING (fold, item_id)
    UNION ALL SELECT v.fold, v.item_id, v.ts, v.k - 1, v.actual, 'TSB intermittent', greatest(t.pred, 0) FROM {name}_valid v JOIN {name}_tsb t USING (fold, item_id)""",
         f"{name}_naive", f"{name}_croston", f"{name}_tsb", f"{name}_valid")


_METRICS = """
    CASE WHEN sum(abs(actual)) <= 1e-9 THEN avg(abs(actual - pred)) ELSE sum(abs(actual - pred)) / sum(abs(actual)) END * 100 AS wape_pct,
    avg(abs(actual - pred)) AS mae, sqrt(avg(pow(actual - pred, 2))) AS rmse,
    coalesce(avg(CASE WHEN abs(actual) + abs(pred) > 1e-9 THEN 2 * abs(actual - pred) / (abs(actual) + abs(pred)) END), 0) * 100 AS smape_pct,
    CASE WHEN sum(abs(actual)) > 1e-9 THEN sum(pred - actual) / sum(abs(actual)) ELSE 0 END * 100 AS bias_pct, count(*) AS validation_points"""
_METRIC_NAMES = "wape_pct mae rmse smape_pct bias_pct"
_WAPE = "CASE WHEN sum(abs(actual)) <= 1e-9 THEN avg(abs(actual - pred)) ELSE sum(abs(actual - pred)) / sum(abs(actual)) END"
_ORD = "CASE model WHEN 'Seasonal naive' THEN 1 WHEN 'Croston' THEN 5 ELSE 6 END"


def weight_views(name: str) -> None:
    """Steps, weights, gate, blend and residuals over ``<name>_records``."""
    view(f"{name}_steps", f"""
    SELECT r.* EXCLUDE (pos), (dense_rank() OVER (PARTITION BY item_id ORDER BY ts) - 1) % (SELECT max(fold_h) FROM {name}_folds) AS step FROM {name}_records r""",
         f"{name}_records", f"{name}_folds")
    view(f"{name}_wapes", f"SELECT item_id, model, {_ORD} AS ord, {_WAPE} AS wape FROM {name}_steps GROUP BY 1, 2", f"{name}_steps")
    view(f"{name}_raw_weights", f"""
    SELECT *, w / sum(w) OVER (PARTITION BY item_id) AS weight FROM (
      SELECT *, exp(-4 * greatest(0, wape - best)) / greatest(wape, 0.025::DOUBLE) AS w, row_number() OVER (PARTITION BY item_id ORDER BY wape, ord) AS place FROM (
        SELECT *, min(wape) OVER (PARTITION BY item_id) AS best FROM {name}_wapes)
      WHERE wape <= greatest(best * 1.75::DOUBLE, best + 0.12::DOUBLE)) WHERE place <= 6""", f"{name}_wapes")
    view(f"{name}_gates", f"""
    SELECT item_id, k > 1 AND bw >= best - 1e-12 AS gated FROM (
      SELECT item_id, any_value(best) AS best, {_WAPE} AS bw, max(k) AS k FROM (
        SELECT s.item_id, s.ts, any_value(s.actual) AS actual, sum(w.weight * s.pred) / sum(w.weight) AS pred, any_value(w.best) AS best, count(*) AS k
        FROM {name}_steps s JOIN {name}_raw_weights w USING (item_id, model) GROUP BY 1, 2) GROUP BY item_id)""", f"{name}_raw_weights")
    view(f"{name}_weights", f"""
    SELECT item_id, model, CASE WHEN gated THEN 1 ELSE weight END AS weight, gated
    FROM {name}_raw_weights JOIN {name}_gates USING (item_id) WHERE NOT gated OR place = 1""", f"{name}_gates")
    view(f"{name}_blend", f"""
    SELECT item_id, ts, any_value(step) AS step, any_value(actual) AS actual, sum(w.weight * s.pred) / sum(w.weight) AS baseline, stddev_pop(s.pred) AS disagreement
    FROM {name}_steps s JOIN {name}_weights w USING (item_id, model) GROUP BY 1, 2""", f"{name}_weights")
    view(f"{name}_residuals", f"SELECT item_id, ts, step, actual, baseline AS pred, actual - baseline AS residual FROM {name}_blend", f"{name}_blend")


for _n in ("part", "brand"):
    fold_views(_n, H)
    weight_views(_n)


def records(spark, d, panel=P.part_panel):
    """Backtest records of the exact models. Series and records are read by several later steps."""
    items = stage(D.series(panel(spark, d).select("item_id", "ts", "target")), "series")
    history = items.select("item_id", F.inline("points"))
    folds = stage(D.rolling_folds(D.dates_of(items), "monthly", "deep", H), "folds")
    made = B.predict_series(D.histories(items, folds), S)
    return stage(D.with_step(made, D.validation_horizon(folds)), "records"), folds, history


@query("folds", sql("SELECT fold, val_start, val_end, fold_h FROM part_folds", "part_folds", bigints="fold fold_h"))
def _(spark, d):
    return D.rolling_folds(P.part_panel(spark, d), "monthly", "deep", H)


@query("fold_assignment", sql("""
    SELECT f.fold, p.item_id, p.ts, p.target, CASE WHEN p.ts < f.val_start THEN 'train' ELSE 'validate' END AS role
    FROM brand_panel p JOIN brand_folds f ON p.ts <= f.val_end""", "brand_folds", "brand_panel", doubles="target", bigints="fold"))
def _(spark, d):
    panel = P.brand_panel(spark, d).select("item_id", "ts", "target")
    return D.assign_folds(panel, D.rolling_folds(panel, "monthly", "deep", H))


for _query, _model in (("naive_forecast", "Seasonal naive"), ("croston", "Croston"), ("tsb", "TSB intermittent")):

    def _one(spark, d, _m=_model):
        history = P.part_panel(spark, d).select("item_id", "ts", "target")
        folds = D.rolling_folds(history, "monthly", "deep", H)
        return B.predict_series(D.fold_histories(history, folds), S, {_m: B.EXACT[_m]}).drop("model")

    query(_query, sql(f"SELECT fold, item_id, ts, pos AS step, actual, pred FROM part_records WHERE model = '{_model}'",
                      "part_records", doubles="actual pred", bigints="fold step"))(_one)


def _short(spark, d):
    panel = P.event_panel(spark, d)
    months = panel.groupBy("item_id", F.trunc("ts", "week").alias("week")).agg(F.sum("target").alias("target"))
    start = F.date_diff(F.col("week"), F.lit("2023-12-25").cast("date")) / 7
    short = months.select("item_id", F.add_months(F.lit("2024-01-01").cast("date"), start.cast("int")).alias("ts"), "target")
    out = B.predict_series(D.final_histories(short, "monthly", 2 * S), S, {"Seasonal naive": B.EXACT["Seasonal naive"]})
    return out.drop("model", "actual")


view("short_hist", f"""
    SELECT 0 AS fold, item_id, list(target ORDER BY week) AS y, {2 * S} AS m,
           CAST(TIMESTAMP '2024-01-01' + to_months(CAST(date_diff('day', DATE '2023-12-25', max(week)) // 7 AS INTEGER)) AS DATE) AS last FROM (
      SELECT item_id, CAST(date_trunc('week', ts) AS DATE) AS week, sum(target) AS target FROM event_regular GROUP BY 1, 2) GROUP BY item_id""", "event_regular")
view("short_valid", "SELECT 0 AS fold, item_id, DATE '2024-01-01' AS ts, 0 AS actual, 1 AS k FROM short_hist", "short_hist")
model_views("short")
query("naive_short", sql("""
    SELECT 0 AS fold, h.item_id, CAST(CAST(h.last AS TIMESTAMP) + to_months(CAST(n.k AS INTEGER)) AS DATE) AS ts, n.k - 1 AS step, greatest(n.pred, 0) AS pred
    FROM short_hist h JOIN short_naive n USING (item_id)""", "short_hist", "short_naive", doubles="pred", bigints="fold step"))(_short)


@query("backtest_exact", sql("SELECT fold, item_id, ts, step, model, actual, pred FROM part_steps", "part_steps",
                             doubles="actual pred", bigints="fold step"))
def _(spark, d):
    return records(spark, d)[0]


@query("leaderboard", sql(f"""
    SELECT *, row_number() OVER (ORDER BY wape_pct, {_ORD}) AS place FROM (
      SELECT model, {_METRICS} FROM part_steps GROUP BY model)
    JOIN (SELECT model, stddev_pop(w) AS stability_pct FROM (SELECT model, step, {_WAPE} * 100 AS w FROM part_steps GROUP BY 1, 2) GROUP BY model) USING (model)""",
    "part_steps", doubles=_METRIC_NAMES + " stability_pct"))
def _(spark, d):
    return M.leaderboard(records(spark, d)[0])


@query("champion_challenger", sql(f"""
    SELECT model, wape_pct, place, CASE WHEN place = 1 THEN 'champion' ELSE 'challenger' END AS role FROM (
      SELECT model, wape_pct, row_number() OVER (ORDER BY wape_pct, {_ORD}) AS place FROM (SELECT model, {_METRICS} FROM part_steps GROUP BY model)) WHERE place <= 2""",
    "part_steps", doubles="wape_pct"))
def _(spark, d):
    return M.champion_challenger(M.leaderboard(records(spark, d)[0])).select("model", "wape_pct", "place", "role")


@query("horizon_metrics", sql(f"SELECT model, step + 1 AS step, {_METRICS} FROM part_steps GROUP BY model, step",
                              "part_steps", doubles=_METRIC_NAMES, bigints="step"))
def _(spark, d):
    return M.horizon_metrics(records(spark, d)[0])


@query("item_metrics", sql(f"""
    SELECT m.*, CASE WHEN n < {2 * S} THEN 12 ELSE 0 END AS short_penalty, n AS history_points,
           round_even(greatest(0, 100 - least(70, wape_pct * 2) - least(15, abs(bias_pct) * 0.5::DOUBLE) - CASE WHEN n < {2 * S} THEN 12 ELSE 0 END), 1) AS quality_score
    FROM (SELECT item_id, {_METRICS} FROM part_residuals GROUP BY item_id) m JOIN (SELECT item_id, count(*) AS n FROM part_panel GROUP BY item_id) USING (item_id)""",
    "part_residuals", "part_panel", doubles=_METRIC_NAMES + " quality_score", bigints="short_penalty"))
def _(spark, d):
    res, history = residual_rows(spark, d)
    counted = M.metrics(res, ["item_id"]).join(history.groupBy("item_id").agg(F.count("*").alias("history_points")), "item_id")
    short = F.when(F.col("history_points") < 2 * S, 12).otherwise(0)
    return R.series_quality(counted, "monthly").withColumn("short_penalty", short)


@query("series_weights", sql("SELECT item_id, model, weight, gated FROM part_weights", "part_weights", doubles="weight"))
def _(spark, d):
    return E.series_weights(records(spark, d)[0])


for _family in ("seasonal", "intermittent", "model:Croston"):
    _in = {"seasonal": "('Seasonal naive')", "intermittent": "('Seasonal naive', 'Croston', 'TSB intermittent')", "model:Croston": "('Croston')"}[_family]

    def _fam(spark, d, _f=_family):
        return E.global_weights(records(spark, d)[0], _f)

    query(f"method_{_family.split(':')[-1].lower()}", sql(f"""
    SELECT model, wape, row_number() OVER (ORDER BY wape, {_ORD}) AS place, w / sum(w) OVER () AS weight FROM (
      SELECT model, wape, exp(-4 * greatest(0, wape - best)) / greatest(wape, 0.025::DOUBLE) AS w FROM (
        SELECT *, min(wape) OVER () AS best FROM (SELECT model, {_WAPE} AS wape FROM part_steps WHERE model IN {_in} GROUP BY model))
      WHERE wape <= greatest(best * 1.75::DOUBLE, best + 0.12::DOUBLE))""", "part_steps", doubles="wape weight"))(_fam)


def blended(spark, d, panel=P.part_panel):
    made, folds, history = records(spark, d, panel)
    maps = stage(E.series_weight_maps(made), "weights")
    return E.ensemble(made, maps), folds, history, made, maps


def residual_rows(spark, d, panel=P.part_panel):
    blend, _folds, history, _made, _maps = blended(spark, d, panel)
    return stage(E.residuals(blend), "residuals"), history


@query("ensemble_forecast", sql("SELECT * FROM part_blend", "part_blend", doubles="actual baseline disagreement", bigints="step"))
def _(spark, d):
    return blended(spark, d)[0]


@query("interval_coverage", sql("""
    SELECT q AS interval_spread, avg(CASE WHEN abs(residual) <= q THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS interval_coverage_pct, 80.0::DOUBLE AS interval_target_pct
    FROM part_residuals, (SELECT quantile_cont(abs(residual), 0.8) AS q FROM part_residuals) GROUP BY q""",
    "part_residuals", doubles="interval_spread interval_coverage_pct", digits=4), digits=4)
def _(spark, d):
    return M.interval_coverage(residual_rows(spark, d)[0])


def forecast_views(name: str) -> None:
    """Future rows of the exact models, their blend, spread and forecast rows."""
    view(f"{name}f_hist", f"SELECT 0 AS fold, item_id, list(target ORDER BY ts) AS y, {H} AS m, max(ts) AS last FROM {name}_panel GROUP BY item_id", f"{name}_panel")
    view(f"{name}f_valid", f"""
    SELECT 0 AS fold, item_id, CAST(CAST(last AS TIMESTAMP) + to_months(CAST(k AS INTEGER)) AS DATE) AS ts, NULL::DOUBLE AS actual, k
    FROM (SELECT *, unnest(range(1, {H + 1})) AS k FROM {name}f_hist)""", f"{name}f_hist")
    model_views(f"{name}f")
    view(f"{name}_global", f"""
    SELECT model, w / sum(w) OVER () AS weight FROM (
      SELECT model, exp(-4 * greatest(0, wape - best)) / greatest(wape, 0.025::DOUBLE) AS w FROM (
        SELECT *, min(wape) OVER () AS best FROM (SELECT model, {_WAPE} AS wape FROM {name}_steps GROUP BY model))
      WHERE wape <= greatest(best * 1.75::DOUBLE, best + 0.12::DOUBLE))""", f"{name}_steps")
    view(f"{name}_active", f"""
    SELECT item_id, model, weight FROM {name}_weights
    UNION ALL SELECT h.item_id, g.model, g.weight FROM {name}f_hist h CROSS JOIN {name}_global g WHERE h.item_id NOT IN (SELECT item_id FROM {name}_weights)""",
         f"{name}_weights", f"{name}_global", f"{name}f_hist")
    view(f"{name}_future", f"""
    SELECT item_id, ts, any_value(pos) AS step, sum(weight * pred) / sum(weight) AS baseline, stddev_pop(pred) AS disagreement
    FROM {name}f_records JOIN {name}_active USING (item_id, model) GROUP BY 1, 2""", f"{name}f_records", f"{name}_active")
    view(f"{name}_spread", f"""
    SELECT f.*, greatest(0, CASE WHEN g.q > 0 OR s.q IS NOT NULL OR i.q IS NOT NULL OR t.q IS NOT NULL THEN
        (CASE WHEN g.q > 0 THEN g.q ELSE 0 END + 1.25::DOUBLE * coalesce(s.q, 0) + 1.5::DOUBLE * coalesce(i.q, 0) + 2 * coalesce(t.q, 0))
        / (CASE WHEN g.q > 0 THEN 1 ELSE 0 END + CASE WHEN s.q IS NULL THEN 0 ELSE 1.25::DOUBLE END + CASE WHEN i.q IS NULL THEN 0 ELSE 1.5::DOUBLE END + CASE WHEN t.q IS NULL THEN 0 ELSE 2 END)
        ELSE disagreement END + 0.35::DOUBLE * disagreement) AS spread
    FROM {name}_future f
    CROSS JOIN (SELECT quantile_cont(abs(residual), 0.8) AS q FROM {name}_residuals) g
    LEFT JOIN (SELECT step, quantile_cont(abs(residual), 0.8) AS q FROM {name}_residuals GROUP BY 1 HAVING count(*) >= 3) s ON s.step = f.step
    LEFT JOIN (SELECT item_id, quantile_cont(abs(residual), 0.8) AS q FROM {name}_residuals GROUP BY 1 HAVING count(*) >= 3) i ON i.item_id = f.item_id
    LEFT JOIN (SELECT item_id, step, quantile_cont(abs(residual), 0.8) AS q FROM {name}_residuals GROUP BY 1, 2 HAVING count(*) >= 2) t ON t.item_id = f.item_id AND t.step = f.step""",
         f"{name}_future", f"{name}_residuals")
    view(f"{name}_forecast", f"""
    SELECT item_id, ts, step, greatest(0, baseline) AS baseline_mean, 0.0::DOUBLE AS scenario_adjustment_pct, greatest(0, baseline) AS mean,
           greatest(0, baseline - spread) AS p10, greatest(0, baseline) AS p50, greatest(baseline, baseline + spread) AS p90 FROM {name}_spread""", f"{name}_spread")


for _n in ("part", "brand"):
    forecast_views(_n)


def spread_rows(spark, d, panel=P.part_panel):
    blend, folds, history, made, maps = blended(spark, d, panel)
    future = B.predict_series(D.final_histories(history, "monthly", H), S)
    ahead = E.ensemble(future, maps, E.global_weight_map(made))
    res = stage(E.residuals(blend), "residuals")
    return I.calibrated_spread(res, ahead.drop("actual"), D.validation_horizon(folds)), res, folds, future


def forecast(spark, d, panel=P.part_panel, pct: float = 0.0):
    return I.forecast_rows(spread_rows(spark, d, panel)[0], pct)


_FORECAST = "baseline_mean scenario_adjustment_pct mean p10 p50 p90"


@query("interval_spread", sql("SELECT * FROM part_spread", "part_spread", doubles="baseline disagreement spread", bigints="step"))
def _(spark, d):
    return spread_rows(spark, d)[0]


@query("forecast_rows", sql("SELECT * FROM brand_forecast", "brand_forecast", doubles=_FORECAST, bigints="step"))
def _(spark, d):
    return forecast(spark, d, P.brand_panel)


@query("part_forecast", sql("SELECT * FROM part_forecast", "part_forecast", doubles=_FORECAST, bigints="step"))
def _(spark, d):
    return forecast(spark, d)


view("brand_day_res", "SELECT ts, sum(residual) AS residual, max(step) AS step FROM brand_residuals GROUP BY ts", "brand_residuals")


@query("portfolio_residuals", sql("SELECT * FROM brand_day_res", "brand_day_res", doubles="residual", bigints="step"))
def _(spark, d):
    return I.portfolio_residuals(residual_rows(spark, d, P.brand_panel)[0])


@query("portfolio_forecast", sql("""
    SELECT ts, baseline_mean, scenario_adjustment_pct, mean, mean AS p50, greatest(0, mean - sp) AS p10, mean + sp AS p90 FROM (
      SELECT t.*, coalesce(s.q, a.q, t.fall) * CASE WHEN t.k + 1 > (SELECT max(fold_h) FROM brand_folds) THEN sqrt((t.k + 1) / (SELECT max(fold_h) FROM brand_folds)::DOUBLE) ELSE 1 END AS sp FROM (
        SELECT ts, sum(baseline_mean) AS baseline_mean, max(scenario_adjustment_pct) AS scenario_adjustment_pct, sum(mean) AS mean,
               sqrt(sum(pow(mean - p10, 2))) * 1.25::DOUBLE AS fall, row_number() OVER (ORDER BY ts) - 1 AS k FROM brand_forecast GROUP BY ts) t
      LEFT JOIN (SELECT step, quantile_cont(abs(residual), 0.8) AS q FROM brand_day_res GROUP BY step HAVING count(*) >= 2) s ON s.step = t.k
      CROSS JOIN (SELECT CASE WHEN count(*) >= 3 THEN quantile_cont(abs(residual), 0.8) END AS q FROM brand_day_res) a)""",
    "brand_forecast", "brand_day_res", "brand_folds", doubles="baseline_mean scenario_adjustment_pct mean p50 p10 p90"))
def _(spark, d):
    calibrated, res, folds, _f = spread_rows(spark, d, P.brand_panel)
    return I.portfolio_forecast(I.forecast_rows(calibrated), res, D.validation_horizon(folds))


@query("model_totals", sql("SELECT model, ts, sum(pred) AS mean FROM brandf_records GROUP BY 1, 2", "brandf_records", doubles="mean"))
def _(spark, d):
    history = P.brand_panel(spark, d).select("item_id", "ts", "target")
    return I.model_totals(B.predict_series(D.final_histories(history, "monthly", H), S))


@query("evidence", sql(f"""
    SELECT rolling_folds, validation_horizon, history_periods,
           CASE WHEN rolling_folds >= 3 AND validation_horizon >= {H} THEN 'strong' WHEN rolling_folds >= 2 AND validation_horizon >= {H} THEN 'moderate' ELSE 'limited' END AS evidence_level,
           NOT (rolling_folds < 2 OR validation_horizon < {H}) AS publish_allowed FROM (
      SELECT count(*) AS rolling_folds, max(fold_h) AS validation_horizon, (SELECT count(DISTINCT ts) FROM part_panel) AS history_periods FROM part_folds)""",
    "part_folds", "part_panel", bigints="validation_horizon"))
def _(spark, d):
    panel = P.part_panel(spark, d)
    return E.evidence(D.rolling_folds(panel, "monthly", "deep", H), H, panel).drop("evidence_reason")


@query("best_model_label", sql("""
    SELECT CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT item_id FROM part_weights WHERE gated)) > 0 THEN 'Recommended guarded selection'
                WHEN count(*) > 1 THEN 'Recommended ensemble' ELSE any_value(model) END AS best_model FROM part_global""", "part_weights", "part_global"))
def _(spark, d):
    made = records(spark, d)[0]
    gated = E.series_weight_maps(made).agg(F.count_if("gated")).scalar()
    return E.best_model_label(E.global_weights(made), gated)
