"""Queries on fitted models. Searches have no SQL twin; tests check them on known series. Closed forms have one."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ...functions.periods import calendar_columns, lag_set, season_length
from ...operators import baselines as B
from ...operators import features as X
from ...operators import folds as D
from ...operators import future as U
from ...operators import learners as G
from ...operators.ridge import TrainingSet, fit_ridge
from ...operators.statistical import STATISTICAL, spread
from ...session import stage
from ..forecast_run import Settings, forecast_run
from . import panels as P
from .modelling import H
from .registry import query, sql

S = season_length("monthly")

for _query, _kind in (("ets", "AutoETS"), ("arima", "AutoARIMA"), ("theta", "Theta")):

    def _fit(spark, d, _k=_kind):
        items = stage(D.series(P.part_panel(spark, d).select("item_id", "ts", "target")), "series")
        folds = D.rolling_folds(D.dates_of(items), "monthly", "deep", H)
        return B.predict_series(spread(D.histories(items, folds)), S, {_k: STATISTICAL[_k]})

    query(_query)(_fit)


def _learned(spark, d, names, profile="fast", panel=P.supplier_panel):
    """Fit on everything before the last window and predict that window."""
    panel = stage(panel(spark, d).select("item_id", "ts", "target").withColumns(calendar_columns("monthly")), "panel")
    fold = D.rolling_folds(panel, "monthly", profile, H).orderBy(F.desc("fold")).first()
    start = F.lit(fold["val_start"])
    lags = lag_set("monthly", X.shortest_series(panel, [fold["val_start"]])[1])
    frame = stage(
        X.direct_frame(X.with_position(panel), lags, H, list(calendar_columns("monthly")), warmup=1), "frame"
    )
    train = frame.filter((F.col("ts") < start) & (F.col("origin_idx") >= max(lags)))
    models = G.fit_global(train, profile, names)
    valid = frame.filter((F.col("origin_ts") == start) & F.col("lag_1").isNotNull())
    return models, train, G.predict_global(models, valid)


@query("ridge")
def _(spark, d):
    return _learned(spark, d, ["Ridge + drivers"])[2]


RIDGE_SQL = """
    WITH base AS (SELECT item_id, ts, target AS y, lag(target, 1) OVER w AS a, lag(target, 6) OVER w AS b
                  FROM part_idx WINDOW w AS (PARTITION BY item_id ORDER BY ts)),
    cuts AS (SELECT f.fold, CAST(max(ts) - to_months(f.back) AS DATE) AS cut
             FROM base, (VALUES (1, 5), (2, 2)) AS f(fold, back) GROUP BY f.fold, f.back),
    train AS (SELECT * FROM base JOIN cuts ON ts < cut WHERE b IS NOT NULL),
    level AS (SELECT fold, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM train GROUP BY fold),
    z AS (SELECT fold, item_id, y, (a - ma) / sa AS a, (b - mb) / sb AS b FROM train JOIN level USING (fold)),
    whole AS (SELECT fold, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb,
                     sum(a * y) AS ay, sum(b * y) AS yb FROM z GROUP BY fold),
    items AS (SELECT fold, item_id, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y FROM z GROUP BY fold, item_id),
    part AS (SELECT fold, sum(n * n / (n + 2)) AS n, sum(n * a / (n + 2)) AS a, sum(n * b / (n + 2)) AS b, sum(n * y / (n + 2)) AS y,
                    sum(a * a / (n + 2)) AS aa, sum(a * b / (n + 2)) AS ab, sum(b * b / (n + 2)) AS bb,
                    sum(a * y / (n + 2)) AS ay, sum(b * y / (n + 2)) AS yb FROM items GROUP BY fold),
    m AS (SELECT fold, w.n - p.n AS n, w.a - p.a AS a, w.b - p.b AS b, w.y - p.y AS y, w.aa - p.aa + 2 AS aa, w.ab - p.ab AS ab,
                 w.bb - p.bb + 2 AS bb, w.ay - p.ay AS ay, w.yb - p.yb AS yb FROM whole w JOIN part p USING (fold)),
    det AS (SELECT *, n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b) AS d FROM m),
    solved AS (SELECT fold,
        (y * (aa * bb - ab * ab) - a * (ay * bb - ab * yb) + b * (ay * ab - aa * yb)) / d AS w0,
        (n * (ay * bb - ab * yb) - y * (a * bb - ab * b) + b * (a * yb - ay * b)) / d AS w1,
        (n * (aa * yb - ay * ab) - a * (a * yb - ay * b) + y * (a * ab - aa * b)) / d AS w2 FROM det)
    SELECT b.item_id, b.ts, c.fold,
        s.w0 + s.w1 * (b.a - l.ma) / l.sa + s.w2 * (b.b - l.mb) / l.sb
        + coalesce((i.y - i.n * s.w0 - i.a * s.w1 - i.b * s.w2) / (i.n + 2), 0) AS pred
    FROM base b JOIN cuts c ON b.ts >= c.cut JOIN level l USING (fold) JOIN solved s USING (fold)
    LEFT JOIN items i ON i.fold = c.fold AND i.item_id = b.item_id
    WHERE b.b IS NOT NULL"""


@query("ridge_exact", sql(RIDGE_SQL, "part_idx", doubles="pred", bigints="fold", digits=4), digits=4)
def _(spark, d):
    """Two training sets over every part, fitted from one scan; the SQL solves the reduced system by Cramer's rule."""
    w = W.partitionBy("item_id").orderBy("ts")
    lags = {f"lag_{k}": F.lag("target", k).over(w) for k in (1, 6)}
    frame = P.part_panel(spark, d).select("item_id", "ts", F.col("target").alias("y")).withColumn("target", F.col("y"))
    frame = stage(frame.withColumns(lags).drop("target").filter(F.col("lag_6").isNotNull()), "frame")
    last = frame.agg(F.max("ts")).first()[0]
    cuts = {1: F.add_months(F.lit(last), -5), 2: F.add_months(F.lit(last), -2)}
    models = fit_ridge(frame, {f: TrainingSet(F.col("ts") < cut, F.col("ts") >= cut, list(lags)) for f, cut in cuts.items()})
    parts = [models[f].transform(frame.filter(F.col("ts") >= cut)).select("item_id", "ts", F.lit(f).alias("fold"), "pred") for f, cut in cuts.items()]
    return parts[0].unionByName(parts[1])


@query("boosted_trees")
def _(spark, d):
    return _learned(spark, d, ["Histogram gradient boosting"])[2]


@query("boosted_shallow")
def _(spark, d):
    """Trees of depth five on nine tenths of the columns each."""
    return _learned(spark, d, ["LightGBM + drivers"])[2]


@query("forest")
def _(spark, d):
    return _learned(spark, d, ["Random forest", "Extra trees"], "deep")[2]


@query("importance")
def _(spark, d):
    models, train, _made = _learned(spark, d, ["Ridge + drivers"])
    names = [*calendar_columns("monthly"), "lag_1", "lag_12", "rolling_mean_12"]
    return G.driver_importance(models, train, {"Ridge + drivers": 1.0}, names)


@query("full_run_exact", sql("SELECT * FROM brand_forecast", "brand_forecast", doubles="baseline_mean scenario_adjustment_pct mean p10 p50 p90", bigints="step"))
def _(spark, d):
    """The whole run with the exact models only: its forecast has a SQL twin."""
    panel = stage(P.brand_panel(spark, d).select("item_id", "ts", "target"), "panel")
    ahead = U.future_covariates(panel, horizon=H, calendar=False)
    return forecast_run(panel, ahead, Settings(horizon=H, profile="deep", learners=[], statistical=[])).forecast


@query("full_run_weights", sql("SELECT DISTINCT item_id, 1.0::DOUBLE AS weight, 0 AS negative, 6 AS steps, 0 AS disordered, 9 AS models FROM brand_panel", "brand_panel", doubles="weight", bigints="negative steps disordered models"))
def _(spark, d):
    """Weights, ranges and models of the whole run in numbers that must hold whatever the fits are.

    One row per item: its weights sum to one, its rows are as many as the horizon, and no range is out of order.
    """
    run = whole_run(spark, d)
    weights = run.weights.groupBy("item_id").agg(F.round(F.sum("weight"), 9).alias("weight"), F.count_if(F.col("weight") < 0).alias("negative"))
    rows = run.forecast.groupBy("item_id").agg(
        F.count("*").alias("steps"), F.count_if((F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")) | (F.col("p10") < 0)).alias("disordered")
    )
    return weights.join(rows, "item_id").withColumn("models", F.lit(run.leaderboard.count()))


def whole_run(spark, d):
    panel = stage(P.brand_panel(spark, d).select("item_id", "ts", "target", "l_discount", "l_returnflag"), "panel")
    drivers = ["l_discount", "l_returnflag"]
    ahead = U.future_covariates(panel, drivers=drivers, policy="carry", calendar=False)
    return forecast_run(panel, ahead, Settings(profile="fast", drivers=drivers))


@query("full_run")
def _(spark, d):
    return whole_run(spark, d).forecast
