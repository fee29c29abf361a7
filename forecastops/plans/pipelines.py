"""End-to-end pipelines: hourly passengers, monthly series, segments and hourly vehicles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.functions import month_start as make_month_start
from forecastops.functions import day_type, row_total_strict, time_text, week_bucket, weekday_monday0
from forecastops.operators.aggregates import group_keyed, pivot_sum, union_all
from forecastops.operators.compare import calendar_cube, recovery_summary, year_pair
from forecastops.operators.evaluate import actual_vs_predicted, class_report, forecast_metrics
from forecastops.operators.forecast import (PARALLEL_FITS, BoostParams, LinearFit, counts_from_log, fit_boosted, fit_linear, fit_many, log_target,
                                            chosen_settings, param_grid, season_adjust, series_bounds, series_errors,
                                            time_series_cv)
from forecastops.operators.joins import calendar_side, measured_side
from forecastops.operators.ordered import interpolate_linear, lag_features, top_k, with_positions
from forecastops.operators.prepare import attach_climatology, hourly_by_facility, hourly_features, impute_seasonal, jitter
from forecastops.operators.quantiles import iqr_filter
from forecastops.operators.segments import cluster_series, day_type_profile, fit_forest, high_traffic, tercile_tiers
from forecastops.operators.splits import split_chronological, split_random, split_stratified
from forecastops.session import cut_lineage
from forecastops.sources.spines import day_hours, future_grid, month_spine, series_days, series_months


# --- hourly passengers by linear regression ----------------------------------------------------------

def prepare_passenger_hours(df: DataFrame, counts: Sequence[str], weather: Sequence[str]) -> DataFrame:
    """Facility-hour-month rows to training rows.

    Gaps are interpolated along the row order of the report, rows still without counts are dropped, and
    what remains is summed to year, month, time and facility. The order runs through the whole table and is
    cut into balanced ranges. The result feeds the encoder, the fit, the climatology and the grid, so it is
    written out once.
    """
    filled = interpolate_linear(df, ["year", "month", "facility", "time"], [*counts, *weather])
    filled = filled.dropna(subset=list(counts)).withColumn("total_passengers", row_total_strict(counts))
    return cut_lineage(group_keyed(filled, ["year", "month", "time", "facility"], ["total_passengers"], weather))


@dataclass
class PassengerForecast:
    train: DataFrame
    model: LinearFit
    forecast: DataFrame


def passenger_hour_forecast(hours: DataFrame, weather: Sequence[str], train_until: int, years: tuple[int, int],
                            features: Sequence[str] | None = None) -> PassengerForecast:
    """Linear model of passengers by time of day, weather and facility, scored on a full future grid.

    Year and month are no features by default, so every future year gets the same values.
    """
    inputs = list(features) if features else ["time", *weather]
    train = hours.filter(F.col("year") <= train_until)
    model = fit_linear(train, inputs, "total_passengers", "facility")
    # Levels and seasonal weather come from the training rows, times of day from all rows.
    known = hours.select("time", F.when(F.col("year") <= train_until, F.col("facility")).alias("facility"))
    grid = attach_climatology(future_grid(known, years), train, weather)
    scored = model.score(grid, "predicted_passengers")
    return PassengerForecast(train, model, scored.select("year", "month", "time", "facility", "predicted_passengers", *weather))


# Fixed search spaces: 32 settings with 3 folds for the first terminal, one setting with 5 folds for the second.
GRID_TERMINAL_A = param_grid(n_estimators=[100, 200], learning_rate=[0.01, 0.1], max_depth=[3, 4], subsample=[0.8, 1.0],
                             colsample=[0.8, 1.0])
GRID_TERMINAL_B = param_grid(n_estimators=[100], learning_rate=[0.1], max_depth=[4], subsample=[0.8], colsample=[0.8])
FOLDS_TERMINAL_A, FOLDS_TERMINAL_B = 3, 5
HOURLY_PARAMS = BoostParams(n_estimators=300, learning_rate=0.05, max_depth=6)


# --- monthly series by boosted trees -----------------------------------------------------------------

@dataclass
class SeriesForecast:
    """Results of :func:`series_forecast`; every table is lazy.

    ``series_scores`` has the fold errors of every series; in pooled mode ``fold_scores`` has those of all rows together.
    """

    history: DataFrame
    params: Mapping[str, BoostParams]
    fold_scores: Sequence[tuple]
    fitted: DataFrame
    actual_vs_predicted: DataFrame
    metrics: DataFrame
    forecast: DataFrame
    combined: DataFrame
    series_scores: Sequence[tuple] = ()


def prepare_series(df: DataFrame, series: Sequence[str], weather: Sequence[str], zero_is_missing: bool = True,
                   fit_filter: Column | None = None) -> DataFrame:
    """Monthly wide table with a month start and no gaps: weather by seasonal median, series by seasonal mean.

    The monthly table is written out before its statistics are taken, and again when it is complete, since
    every fit that follows reads it.
    """
    rows = cut_lineage(df.withColumn("month_start", make_month_start("year", "month")))
    stat = {c: "median" for c in weather} | {c: "mean" for c in series}
    return cut_lineage(impute_seasonal(rows, [*weather, *series], stat=stat, zero_is_missing=zero_is_missing, fit_filter=fit_filter, monthly=True))


def future_weather(history: DataFrame, weather: Sequence[str], first_month: str, last_month: str, share: float = 0.05,
                   seed: int = 42) -> DataFrame:
    """Monthly calendar with seasonal weather and keyed variation."""
    spine = month_spine(history.sparkSession, first_month, last_month)
    return jitter(attach_climatology(spine, history, weather), history, weather, F.col("month_start"), share, seed)


def search_series(train: DataFrame, features, series, grid, n_splits) -> tuple[dict[str, BoostParams], list[tuple]]:
    """Best setting of each series, and ``(series, setting, fold, error)`` of every fit."""
    placed = with_positions(train, [], ["month_start"], F.year("month_start")).persist()
    try:
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            found = list(pool.map(lambda c: time_series_cv(placed, features, c, "position", n_splits, grid, monthly=True), series))
    finally:
        placed.unpersist()
    return {c: best for c, (best, _) in zip(series, found)}, [(c, *s) for c, (_, scores) in zip(series, found) for s in scores]


def _long(df: DataFrame, series: Sequence[str], weather: Sequence[str]) -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in series})
    return doubles.unpivot(["month_start", "year", "month", *weather], list(series), "series", "value")


def series_forecast(history: DataFrame, series: Sequence[str], weather: Sequence[str], holdout_year: int, first_month: str,
                    last_month: str, grid: Sequence[BoostParams] = (BoostParams(),), n_splits: int = 3,
                    mode: str = "per_series", seed: int = 42) -> SeriesForecast:
    """Forecast monthly series from weather and calendar.

    ``history`` comes from :func:`prepare_series`. Models train on the years before ``holdout_year`` and
    are scored on that year. ``per_series`` fits one model per column, each with the best setting of
    ``grid``; ``pooled`` fits models over all series, scaled by their level (1 where the level is smaller): one for
    each setting and fold of the search and one for each setting that some series chose, so the number of fits does not
    grow with the number of series. ``fitted`` holds the training rows with their predictions.
    """
    features = [*weather, "year", "month"]
    train, holdout = history.filter(F.col("year") < holdout_year), history.filter(F.col("year") == holdout_year)
    future = future_weather(history, weather, first_month, last_month, seed=seed)

    if mode == "per_series":
        params, scores = search_series(train, features, series, list(grid), n_splits)
        by_series = scores
        score = fit_many(train, features, series, params)
        columns = {c: (c, f"{c}__p") for c in series}
        pairs = actual_vs_predicted(score(holdout), ["month_start"], columns)
        fitted = actual_vs_predicted(score(train), ["month_start"], columns)
        predicted = score(future).unpivot(["month_start"], [f"{c}__p" for c in series], "series", "predicted")
        predicted = predicted.withColumn("series", F.expr("substring(series, 1, length(series) - 3)"))
    elif mode == "pooled":
        long = _long(train, series, weather)
        # Every series of the table keeps its row, also one that is zero, negative or empty while training.
        level = F.greatest(F.abs(F.coalesce(F.avg("value"), F.lit(0.0))), F.lit(1.0))
        levels = measured_side(_long(history, series, weather).select("series").distinct().join(
            long.groupBy("series").agg(level.alias("level")), "series", "left").na.fill(1.0, ["level"]))
        months = with_positions(train.select("month_start").distinct(), [], ["month_start"], F.year("month_start"))
        scaled = long.join(levels, "series").join(calendar_side(months), "month_start")
        scaled = cut_lineage(scaled.withColumn("label", F.col("value") / F.col("level")))
        inputs, settings = [*features, "level"], list(grid)
        errors = series_errors(scaled, inputs, "label", "position", n_splits, settings)
        choice = measured_side(levels.select("series").join(chosen_settings(errors), "series", "left").na.fill(0, ["setting"]))
        # The series are columns of a wide table: their settings and fold errors are a bounded list.
        params = {r["series"]: settings[r["setting"]] for r in choice.collect()}
        by_series = [(r["series"], settings[r["setting"]], r["fold"], r["error"]) for r in errors.collect()]
        whole = errors.groupBy("setting", "fold").agg((F.sum(F.col("error") * F.col("rows")) / F.sum("rows")).alias("error")).orderBy("setting", "fold")
        scores = [("all", settings[r["setting"]], r["fold"], r["error"]) for r in whole.collect()]
        # One model over all series for each setting in use; every series is scored by the one it chose.
        fits = {k: fit_boosted(scaled, inputs, "label", settings[k]) for k in sorted({settings.index(p) for p in params.values()})}

        def score(rows: DataFrame, name: str) -> DataFrame:
            own = rows.join(choice, "series")
            return union_all([fit(own.filter(F.col("setting") == k), name) for k, fit in fits.items()]).drop("setting")

        back = F.col("p") * F.col("level")
        outcome = ["month_start", "series", F.col("value").alias("actual"), back.alias("predicted")]
        pairs = score(_long(holdout, series, weather).join(levels, "series"), "p").select(*outcome)
        fitted = score(scaled, "p").select(*outcome)
        ahead = series_months(levels, first_month, last_month).drop("year", "month")
        predicted = score(ahead.join(calendar_side(future), "month_start"), "p").select("month_start", "series", back.alias("predicted"))
    else:
        raise ValueError(f"unknown mode {mode}")

    bounds = series_bounds(_long(history, series, weather))
    forecast = season_adjust(predicted.join(bounds, "series"), "predicted", "series", "month_start", first_month, seed=seed)
    wide = pivot_sum(forecast, ["month_start"], "series", {c: c for c in series}, "forecast")
    wide = wide.join(calendar_side(future), "month_start").select("month_start", "year", "month", *series, *weather)
    past = history.select("month_start", "year", "month", *[F.col(c).cast("double").alias(c) for c in series], *weather)
    return SeriesForecast(history, params, scores, fitted, pairs, forecast_metrics(pairs, ["series"]), forecast, past.unionByName(wide), by_series)


# --- segments and high-traffic months ----------------------------------------------------------------

@dataclass
class Segments:
    labelled: DataFrame
    train: DataFrame
    test: DataFrame
    report: DataFrame


def segment_and_classify(history: DataFrame, series: Sequence[str], weather: Sequence[str], key: Sequence[str],
                         stratified: bool = True, trees: int = 100, depth: int = 30, seed: int = 42) -> Segments:
    """Cluster months by their series, flag the top quarter by total and classify the flag by weather and calendar."""
    labelled = high_traffic(cluster_series(history, series), series, monthly=True)
    if stratified:
        parted = split_stratified(labelled, "high_traffic", key, seed=seed)
    else:
        parted = split_random(labelled, key, seed=seed)
    features = [*weather, "year", "month"]
    train = parted.filter(F.col("split") == "train")
    score = fit_forest(train, features, "high_traffic", trees, depth, seed)
    test = score(parted.filter(F.col("split") == "test"))
    return Segments(labelled, score(train), test, class_report(test, "high_traffic"))


# --- hourly vehicles per facility --------------------------------------------------------------------

@dataclass
class FacilityForecast:
    fitted: DataFrame
    validation: DataFrame
    rmse: DataFrame
    forecast: DataFrame


def facility_forecast(hourly: DataFrame, weather: Sequence[str], train_until: str, first_day: str, last_day: str,
                      params: BoostParams = HOURLY_PARAMS, mode: str = "pooled",
                      value: str = "total_vehicles") -> FacilityForecast:
    """Hourly vehicle forecast per facility from hour, weather and calendar.

    Outliers are fenced per facility, counts are modelled on the log scale, the last fifth of each
    facility's hours validates, and every hour of the horizon is scored with the facility's mean weather
    of that month. ``pooled`` fits one model over all facilities with the facility's mean level as a
    feature (taken from its training rows); ``per_facility`` fits one model each, a few at a time. Facilities
    without training rows are skipped.
    """
    day_end = F.date_add(F.lit(train_until).cast("date"), 1).cast("timestamp_ntz")
    train = iqr_filter(hourly.filter(F.col("ts") < day_end), ["facility"], value)
    train = train.withColumns({"day_of_week": weekday_monday0("ts"), "month": F.month("ts"), "year": F.year("ts"),
                               "hour": F.hour("ts"), "label": log_target(value)})
    # Read by the split, the levels, the seasonal weather and the fit: written out once.
    train = cut_lineage(train)
    # A week slices a facility into at most 168 rows.
    parted = cut_lineage(split_chronological(train, ["facility"], "ts", week_bucket("ts")))
    features = ["hour", *weather, "day_of_week", "month", "year"]
    levels = measured_side(parted.filter(F.col("split") == "train").groupBy("facility").agg(F.avg("label").alias("level")))
    # The weather of a facility and month joins its days; the hours are spread out afterwards.
    seasonal = train.groupBy("facility", "month").agg(*[F.avg(c).alias(c) for c in weather])
    ahead = series_days(levels, first_day, last_day).withColumns(
        {"day_of_week": weekday_monday0("date"), "month": F.month("date"), "year": F.year("date")})
    ahead = day_hours(ahead.join(seasonal, ["facility", "month"], "left"))

    if mode == "pooled":
        leveled = parted.join(levels, "facility")
        score = fit_boosted(leveled.filter(F.col("split") == "train"), [*features, "level"], "label", params)
        scored_rows, scored = score(leveled), score(ahead)
    elif mode == "per_facility":
        ahead = cut_lineage(ahead)
        names = [r[0] for r in levels.select("facility").sort("facility").collect()]

        def one(name):
            own = parted.filter(F.col("facility") == name)
            score = fit_boosted(own.filter(F.col("split") == "train"), features, "label", params)
            return score(own), score(ahead.filter(F.col("facility") == name))

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            both = list(pool.map(one, names))
        scored_rows, scored = (union_all([cut_lineage(pair[k]) for pair in both]) for k in (0, 1))
    else:
        raise ValueError(f"unknown mode {mode}")

    fitted, validation = (scored_rows.filter(F.col("split") == part) for part in ("train", "valid"))
    error = F.col("label") - F.col("predicted")
    rmse = validation.groupBy("facility").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    forecast = scored.select("date", time_text("ts").alias("time"), "facility",
                             counts_from_log("predicted").alias(value), "ts", "hour")
    return FacilityForecast(fitted, validation, rmse, forecast)


# --- hourly vehicles from raw files to busiest hours -------------------------------------------------

def hourly_vehicles(raw: Sequence[DataFrame], weather: DataFrame, vehicles: Sequence[str], weather_cols: Sequence[str]) -> DataFrame:
    """Raw lane counts of several files to one row per facility and timestamp.

    Volumes are summed, weather is averaged, and the table is written out once because lags, fences,
    profiles and comparisons all start from it.
    """
    rows = hourly_features(union_all(list(raw)), vehicles).drop("hour", "day", "month", "year", "dayofweek", "is_weekend")
    rows = rows.join(measured_side(weather.select("date", *weather_cols)), "date", "left")
    rows = rows.select("facility", "ts", *vehicles, "total_vehicles", *weather_cols)
    return cut_lineage(hourly_by_facility(rows, [*vehicles, "total_vehicles"], weather_cols))


def with_lags(hourly: DataFrame, trim_warmup: bool = True) -> DataFrame:
    """Lags of 1 and 24 rows and the trailing 24-row mean per facility; a day is one slice of a facility."""
    return lag_features(hourly, ["facility"], "ts", "total_vehicles", slice_by=F.to_date("ts"), trim_warmup=trim_warmup)


def busiest_hours(forecast: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Tiers of the hour profile per facility and day type, and the ``k`` busiest hours of each."""
    profile = day_type_profile(forecast.withColumn("day_type", day_type("date")))
    tiers = tercile_tiers(profile, ["facility", "day_type"], "total_vehicles")
    return tiers, top_k(tiers, ["facility", "day_type"], [F.desc("total_vehicles"), "hour"], k, rank="rank")


def two_year_recovery(hourly: DataFrame, forecast: DataFrame, base: int, target: int, trim_warmup: bool = True) -> DataFrame:
    """Recovery summary of a base year of history against a target year of the forecast.

    The history is taken without its lag warm-up rows by default.
    """
    past = with_lags(hourly) if trim_warmup else hourly
    return recovery_summary(calendar_cube(year_pair(past, forecast, base, target)), base, target)
