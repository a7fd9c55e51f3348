"""The whole run: backtest, weights, ranges and forecasts from a clean panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import FALLBACK_MODEL, MAX_HORIZON, MODELS
from ..functions.periods import calendar_columns, lag_set, season_length
from ..operators import baselines as B
from ..operators import ensemble as E
from ..operators import features as X
from ..operators import folds as D
from ..operators import intervals as I
from ..operators import learners as G
from ..operators import metrics as M
from ..operators import profiles as R
from ..operators.ridge import TrainingSet, fit_ridge
from ..operators.statistical import STATISTICAL, spread
from ..session import stage


@dataclass
class Settings:
    freq: str = "monthly"
    horizon: int = 6
    profile: str = "deep"
    method: str = "recommended"
    adjustment_pct: float = 0.0
    drivers: list[str] = field(default_factory=list)
    roles: dict[str, str] = field(default_factory=dict)
    learners: list[str] | None = None
    statistical: list[str] | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.horizon <= MAX_HORIZON:
            raise ValueError(f"horizon must be between 1 and {MAX_HORIZON}")
        if self.profile not in ("fast", "deep"):
            raise ValueError("profile must be fast or deep")
        E.check_method(self.method, [*self.series_methods, *self.learner_names])

    @property
    def series_methods(self) -> dict:
        chosen = list(STATISTICAL) if self.statistical is None else self.statistical
        methods = {**B.EXACT, **{k: STATISTICAL[k] for k in chosen}}
        return {name: methods[name] for name in MODELS if name in methods}

    @property
    def learner_names(self) -> list[str]:
        return G.learner_names(self.profile) if self.learners is None else self.learners


@dataclass
class Run:
    folds: DataFrame
    records: DataFrame
    predictions: DataFrame
    forecast: DataFrame
    portfolio: DataFrame
    weights: DataFrame
    leaderboard: DataFrame
    diagnostics: DataFrame
    metrics: DataFrame
    drivers: DataFrame | None
    label: DataFrame


def _stand_ins(histories: DataFrame, names: list[str], models: dict, season: int) -> DataFrame | None:
    """Seasonal naive predictions under the names of learners that could not be fitted."""
    absent = [n for n in names if n not in models]
    if not absent:
        return None
    return B.predict_series(histories, season, {n: B.EXACT[FALLBACK_MODEL] for n in absent})


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    made = [p for p in parts if p is not None]
    out = made[0] if made else None
    for part in made[1:]:
        out = out.unionByName(part)
    return out


def _learner_records(
    panel: DataFrame, future: DataFrame, fold_rows: list, settings: Settings,
    fold_hist: DataFrame, final_hist: DataFrame,
) -> tuple[DataFrame | None, DataFrame | None, dict, DataFrame | None]:
    """Backtest and final predictions of the learners; features are computed once for all folds.

    Ridge is fitted for all folds and for the final origin from one scan of the frame.
    """
    names = settings.learner_names
    if names and not fold_rows:
        raise ValueError("the history is too short to validate")
    if not names:
        return None, None, {}, None
    drivers = [*settings.drivers, *calendar_columns(settings.freq)]
    known = panel.select("item_id", "ts", "target", *settings.drivers)
    ahead = future.select("item_id", "ts", F.lit(None).cast("double").alias("target"), *settings.drivers)
    whole = known.unionByName(ahead).withColumns(calendar_columns(settings.freq))
    lengths = X.shortest_series(panel, [f["val_start"] for f in fold_rows])
    all_lags = [lag_set(settings.freq, n) for n in lengths]
    every = sorted({k for lags in all_lags for k in lags})
    frame = X.direct_frame(X.with_position(whole), every, settings.horizon, drivers, keep_unlabelled=True, warmup=1)
    frame = stage(frame, "frame")

    def usable(lags: list[int]) -> DataFrame:
        return frame.drop(*[f"lag_{k}" for k in every if k not in lags])

    def labelled(lags: list[int]) -> Column:
        return F.col("y").isNotNull() & (F.col("origin_idx") >= max([*lags, 3]))

    # an origin needs at least one earlier value
    started = F.col("lag_1").isNotNull()
    season, made = season_length(settings.freq), []
    to_fit = {0: labelled(all_lags[0])}
    to_predict = {0: F.col("origin_y").isNull() & started}
    lags_of = {0: all_lags[0]}
    for fold, lags in zip(fold_rows, all_lags[1:]):
        start, end, number = F.lit(fold["val_start"]), F.lit(fold["val_end"]), int(fold["fold"])
        to_fit[number] = labelled(lags) & (F.col("ts") < start) & (F.col("forecast_step") <= fold["fold_h"])
        to_predict[number] = (F.col("origin_ts") == start) & (F.col("ts") <= end) & F.col("y").isNotNull() & started
        lags_of[number] = lags
    linear = {}
    if G.RIDGE in names:
        linear = fit_ridge(frame, {
            f: TrainingSet(to_fit[f], to_predict[f], [c for part in G.feature_columns(usable(lags_of[f])) for c in part]) for f in to_fit
        })
    others = [n for n in names if n != G.RIDGE]

    def models_of(f: int) -> dict:
        fitted = {G.RIDGE: linear[f]} if f in linear else {}
        return {**fitted, **(G.fit_global(usable(lags_of[f]).filter(to_fit[f]), settings.profile, others) if others else {})}

    for number in (f for f in to_fit if f):
        models = models_of(number)
        if models:
            made.append(G.predict_global(models, usable(lags_of[number]).filter(to_predict[number])).withColumn("fold", F.lit(number)))
        made.append(_stand_ins(fold_hist.filter(F.col("fold") == number), names, models, season))
    train = usable(all_lags[0]).filter(to_fit[0])
    final = models_of(0)
    ahead = [G.predict_global(final, usable(all_lags[0]).filter(to_predict[0])).withColumn("fold", F.lit(0)) if final else None]
    ahead.append(_stand_ins(final_hist, names, final, season))
    return _union(made), _union(ahead), final, train


def forecast_run(panel: DataFrame, future: DataFrame, settings: Settings) -> Run:
    """Fit, validate, weigh and forecast every item of a clean panel.

    Tables that several steps read are written once to the staging folder: the panel, the
    features, the backtest records and the final predictions.
    """
    season = season_length(settings.freq)
    panel = stage(panel, "panel")
    history = panel.select("item_id", "ts", "target")
    folds = stage(D.rolling_folds(history, settings.freq, settings.profile, settings.horizon), "folds")
    fold_rows = folds.orderBy("fold").collect()
    methods = settings.series_methods
    fold_hist = D.fold_histories(history, folds)
    final_hist = D.final_histories(history, settings.freq, settings.horizon)
    backtest = B.predict_series(spread(fold_hist), season, methods)
    final = B.predict_series(spread(final_hist), season, methods)
    learned, ahead, models, train = _learner_records(panel, future, fold_rows, settings, fold_hist, final_hist)
    if learned is not None:
        backtest = backtest.unionByName(learned.select(backtest.columns))
    if ahead is not None:
        final = final.unionByName(ahead.select(final.columns))
    horizon = D.validation_horizon(folds)
    records = stage(D.with_step(backtest, horizon), "records")
    predictions = stage(final, "predictions")
    maps = stage(E.series_weight_maps(records, settings.method), "weights")
    fallback = E.global_weight_map(records, settings.method)
    blended = E.ensemble(records, maps)
    res = stage(E.residuals(blended), "residuals")
    rows = E.ensemble(predictions, maps, fallback).drop("actual")
    forecast = stage(I.forecast_rows(I.calibrated_spread(res, rows, horizon), settings.adjustment_pct), "forecast")
    portfolio = I.portfolio_forecast(forecast, res, horizon)
    weights = E.global_weights(records, settings.method)
    board = M.leaderboard(records).join(weights.select("model", "weight"), "model", "left").fillna({"weight": 0.0})
    scored = R.series_profile(history, settings.freq).join(M.metrics(res, ["item_id"]), "item_id", "left")
    scored = R.series_quality(scored, settings.freq).join(maps.select("item_id", "best_model"), "item_id", "left")
    evidence = E.evidence(folds, settings.horizon, history)
    gated = maps.agg(F.count_if("gated")).scalar()
    overall = M.metrics(res.withColumn("scope", F.lit("all")), ["scope"])
    summary = overall.join(evidence.withColumn("scope", F.lit("all")), "scope").withColumn("ensemble_gate_series", gated)
    drivers = None
    if models and settings.drivers:
        heavy = {r["model"]: float(r["weight"]) for r in weights.select("model", "weight").collect()}
        drivers = G.driver_importance(models, train, heavy, settings.drivers, settings.roles)
    return Run(
        folds=folds, records=records, predictions=predictions, forecast=forecast, portfolio=portfolio,
        weights=maps.select("item_id", F.explode("weights").alias("model", "weight"), "gated"),
        leaderboard=board, diagnostics=scored, metrics=summary, drivers=drivers,
        label=E.best_model_label(weights, gated, settings.method),
    )


def run_tables(run: Run, panel: DataFrame, future: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The tables a run leaves behind, ready for ``write_run``."""
    spark = panel.sparkSession
    facts = {
        "frequency": settings.freq, "horizon": settings.horizon, "profile": settings.profile,
        "known_drivers": ", ".join(settings.drivers), "method_selection": settings.method,
        "scenario_adjustment_pct": settings.adjustment_pct, "interval_target_pct": 80.0,
    }
    tables = {
        "history_clean": panel.select("item_id", "ts", "target"),
        "forecast": run.forecast.join(future.select("item_id", "ts", *settings.drivers), ["item_id", "ts"], "left"),
        "portfolio": run.portfolio,
        "model_leaderboard": run.leaderboard,
        "series_diagnostics": run.diagnostics,
        "run_settings": spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "setting string, value string"),
    }
    if run.drivers is not None:
        tables["driver_importance"] = run.drivers
    return tables
