"""Forecasts of ordered series, any number of them at once.

A series is (series, t, value) with t = 0, 1, ... in order. All methods work on one array
for each series, gathered by one shuffle, with SQL's higher-order functions; a series is
an aggregate (a value for each day, say), so its length is bounded by time and not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("moving_average", "exponential_smoothing", "linear_trend", "ensemble")
WINDOW, ALPHA = 3, 0.3
#: How many deviations a level of confidence takes.
LEVELS = ((0.99, 2.576), (0.95, 1.96), (0.0, 1.645))


def series(df: DataFrame, key: str | None, order: str, value: str) -> DataFrame:
    """series, xs: the non-null values in order."""
    k = F.col(key) if key else F.lit("all")
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return df.filter(F.col(value).isNotNull()).groupBy(k.alias("series")).agg(F.transform(pairs, lambda p: p["v"]).alias("xs"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.greatest(F.size(a), F.lit(1)))


def _errors(actual_and_predicted: Column) -> Column:
    """mae, rmse, mape of an array of (a, p), 6 places; 0 without any, and mape over actual values other than 0."""
    e = actual_and_predicted
    mae = _mean(F.transform(e, lambda x: F.abs(x["a"] - x["p"])))
    rmse = F.sqrt(_mean(F.transform(e, lambda x: (x["a"] - x["p"]) * (x["a"] - x["p"]))))
    rel = F.filter(e, lambda x: x["a"] != 0)
    mape = _mean(F.transform(rel, lambda x: F.abs((x["a"] - x["p"]) / x["a"]))) * 100
    return F.struct(F.round(mae, 6).alias("mae"), F.round(rmse, 6).alias("rmse"), F.round(mape, 6).alias("mape"))


def _pairs(actual: Column, predicted: Column) -> Column:
    return F.zip_with(actual, predicted, lambda a, p: F.struct(a.alias("a"), p.alias("p")))


def _tail(xs: Column, n: Column) -> Column:
    return F.slice(xs, F.size(xs) - n + 1, n)


def _moving_errors(xs: Column, window: int) -> Column:
    """(a, p) of one-step-ahead means of the w values before."""
    w = F.least(F.lit(window), F.size(xs))
    at = F.when(F.size(xs) > w, F.sequence(w, F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.element_at(xs, i + 1).alias("a"), (_mean(F.slice(xs, i - w + 1, w))).alias("p")))


def moving_average(xs: Column, horizon: int = 5, window: int = WINDOW) -> Column:
    """(predictions, errors): each step is the mean of the last w values, forecasts included."""
    w = F.least(F.lit(window), F.size(xs))
    start = F.struct(_tail(xs, w).alias("last"), F.array().cast("array<double>").alias("out"))
    step = lambda s, _: F.struct(F.concat(F.slice(s["last"], 2, F.greatest(w - 1, F.lit(0))), F.array(_mean(s["last"]))).alias("last"), F.concat(s["out"], F.array(_mean(s["last"]))).alias("out"))
    future = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"])
    return _result(xs, future, _moving_errors(xs, window), horizon)


def exponential_smoothing(xs: Column, horizon: int = 5, alpha: float = ALPHA) -> Column:
    """(predictions, errors): the last smoothed value for all steps; each value is predicted by the smoothed one before it."""
    start = F.struct(F.coalesce(F.try_element_at(xs, F.lit(1)), F.lit(0.0)).alias("s"), F.array().cast("array<double>").alias("ps"))
    step = lambda a, x: F.struct((alpha * x + (1 - alpha) * a["s"]).alias("s"), F.concat(a["ps"], F.array(a["s"])).alias("ps"))
    run = F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), start, step)
    rest = F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))
    return _result(xs, F.array_repeat(run["s"], horizon), _pairs(rest, run["ps"]), horizon)


def _line(xs: Column) -> Column:
    """(slope, intercept) over positions from 0; slope 0 for a single value."""
    n = F.size(xs).cast("double")
    at = F.transform(xs, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("x")))
    mi, mx = (n - 1) / 2, _mean(xs)
    sxy = F.aggregate(at, F.lit(0.0), lambda s, p: s + (p["i"] - mi) * (p["x"] - mx))
    sxx = n * (n * n - 1) / 12
    slope = F.when(n > 1, sxy / F.nullif(sxx, F.lit(0.0))).otherwise(0.0)
    return F.struct(slope.alias("slope"), (mx - slope * mi).alias("intercept"))


def linear_trend(xs: Column, horizon: int = 5) -> Column:
    """(predictions, errors): the least-squares line over positions, its errors on the series itself."""
    line = F.transform(F.array(_line(xs)), lambda f: F.struct(F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: f["intercept"] + f["slope"] * (F.size(xs) + h)).alias("future"), F.transform(xs, lambda _, i: f["intercept"] + f["slope"] * i).alias("fit")))
    return _result(xs, line[0]["future"], _pairs(xs, line[0]["fit"]), horizon)


def _result(xs: Column, future: Column, errors: Column, horizon: int) -> Column:
    empty = F.size(xs) == 0
    zeros = F.array_repeat(F.lit(0.0), horizon)
    return F.struct(F.transform(F.when(empty, zeros).otherwise(future), lambda x: F.round(x, 6)).alias("predictions"), _errors(errors).alias("errors"))


def forecasts(df: DataFrame, horizon: int = 5, window: int = WINDOW, alpha: float = ALPHA) -> DataFrame:
    """series, xs, and a column (predictions, errors) for each of the four methods. df: series, xs. The ensemble is the mean of the other three's rounded forecasts and errors."""
    xs = F.col("xs")
    three = df.withColumns({"moving_average": moving_average(xs, horizon, window), "exponential_smoothing": exponential_smoothing(xs, horizon, alpha), "linear_trend": linear_trend(xs, horizon)})
    m = [F.col(c) for c in METHODS[:3]]
    mean = lambda f: F.round(sum((f(c) for c in m[1:]), f(m[0])) / 3, 6)
    steps = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.round((m[0]["predictions"][i] + m[1]["predictions"][i] + m[2]["predictions"][i]) / 3, 6))
    errors = F.struct(*[mean(lambda c, k=k: c["errors"][k]).alias(k) for k in ("mae", "rmse", "mape")])
    return three.withColumn("ensemble", F.struct(steps.alias("predictions"), errors.alias("errors")))


def compared(df: DataFrame, horizon: int = 5) -> DataFrame:
    """series, method, mae, rmse, mape, predictions, best (the least mae; the earlier method of equals)."""
    f = forecasts(df, horizon)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("method"), F.col(f"{m}.errors.mae").alias("mae"), F.col(f"{m}.errors.rmse").alias("rmse"), F.col(f"{m}.errors.mape").alias("mape"), F.col(f"{m}.predictions").alias("predictions")) for i, m in enumerate(METHODS)])
    best = F.array_min(F.transform(rows, lambda r: F.struct(r["mae"].alias("mae"), r["i"].alias("i"))))["i"]
    return f.select("series", rows.alias("rows"), best.alias("b")).select("series", F.explode("rows").alias("r"), "b").select("series", "r.method", "r.mae", "r.rmse", "r.mape", "r.predictions", (F.col("r.i") == F.col("b")).alias("best"))


def decompose(df: DataFrame, period: int) -> DataFrame:
    """series, t, value, trend, seasonal, residual (6 places).

    The trend is a mean over period // 2 values on both sides. At the edges it is of those there are; inside, their
    sum over the period, so that an even period, whose window is one longer, divides by one less. The season is the mean of
    what is left at each position of the period. A series shorter than a period is all 0.
    """
    xs, h = F.col("xs"), period // 2
    n = F.size(xs)

    def smooth(_: Column, i: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), i - h), F.least(n, i + h + 1)
        part = F.slice(xs, lo + 1, hi - lo)
        total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
        return total / F.when((i < h) | (i >= n - h), F.size(part)).otherwise(period)

    short = n < period
    trend = df.withColumn("trend", F.transform(xs, smooth)).withColumn("left", F.zip_with("xs", "trend", lambda x, t: x - t))
    position = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda p: _mean(F.filter("left", lambda _, i: i % period == p)))
    cells = trend.withColumn("season", position).select("series", short.alias("short"), "season", F.posexplode(F.arrays_zip("xs", "trend")).alias("t", "z"))
    s = F.element_at("season", F.col("t") % period + 1)
    v = lambda c: F.when(F.col("short"), 0.0).otherwise(F.round(c, 6))
    return cells.select("series", "t", F.col("z.xs").alias("value"), v(F.col("z.trend")).alias("trend"), v(s).alias("seasonal"), v(F.col("z.xs") - F.col("z.trend") - s).alias("residual"))


def with_confidence(df: DataFrame, steps: int = 1, confidence: float = 0.95) -> DataFrame:
    """series, step, prediction, lower, upper: the ensemble, and around it so many root mean squares of the moving average's errors, or 1 where there are none."""
    z = next(v for level, v in LEVELS if confidence >= level)
    errors = _moving_errors(F.col("xs"), WINDOW)
    spread = F.when(F.size(errors) == 0, 1.0).otherwise(F.sqrt(_mean(F.transform(errors, lambda e: (e["a"] - e["p"]) * (e["a"] - e["p"])))))
    margin = F.when(F.size("xs") == 0, 0.0).otherwise(z * spread)
    f = forecasts(df, steps).withColumn("margin", margin).select("series", "margin", F.posexplode("ensemble.predictions").alias("step", "prediction"))
    return f.select("series", "step", "prediction", F.round(F.col("prediction") - F.col("margin"), 6).alias("lower"), F.round(F.col("prediction") + F.col("margin"), 6).alias("upper"))


def multistep(df: DataFrame, steps: int, method: str = "ensemble") -> DataFrame:
    """series, step, prediction: each forecast is added to the series before the next one. No rows for steps <= 0 or empty series; ValueError for another method."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    now = df.filter(F.size("xs") > 0).select("series", "xs", F.array().cast("array<double>").alias("out"))
    if steps <= 0:
        return now.select("series", F.lit(0).alias("step"), F.lit(0.0).alias("prediction")).limit(0)
    one = {"moving_average": lambda x: moving_average(x, 1), "exponential_smoothing": lambda x: exponential_smoothing(x, 1), "linear_trend": lambda x: linear_trend(x, 1)}

    def following(xs: Column) -> Column:
        if method != "ensemble":
            return one[method](xs)["predictions"][0]
        return F.round(sum((f(xs)["predictions"][0] for f in one.values()), F.lit(0.0)) / 3, 6)

    start = F.struct(F.col("xs").alias("xs"), F.array().cast("array<double>").alias("out"))
    grow = lambda s, _: F.transform(F.array(following(s["xs"])), lambda v: F.struct(F.concat(s["xs"], F.array(v)).alias("xs"), F.concat(s["out"], F.array(v)).alias("out")))[0]
    out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, grow, lambda s: s["out"])
    return now.select("series", F.posexplode(out).alias("step", "prediction"))


def cross_validate(df: DataFrame, n_splits: int = 3) -> DataFrame:
    """series, scores, mean_score, std_score (population): the ensemble's mean absolute error on each next part of a series cut into n_splits + 1; none where a part has fewer than three values."""
    size = F.floor(F.size("xs") / (n_splits + 1)).cast("int")
    folds = F.when((size >= 3) & F.lit(n_splits >= 2), F.sequence(F.lit(1), F.lit(max(1, n_splits))))
    cut = df.select("series", "xs", size.alias("size"), F.explode(folds).alias("fold"))
    cut = cut.select("series", "fold", "size", F.slice("xs", 1, F.col("size") * F.col("fold")).alias("xs"), F.slice("xs", F.col("size") * F.col("fold") + 1, F.col("size")).alias("test"))
    # The part's length is data, and forecasts need it as a number: the longest, then the part's share of it.
    longest = cut.agg(F.max("size")).first()[0] or 1
    f = forecasts(cut.withColumn("series", F.struct("series", "fold", "test")), longest)
    pairs = F.zip_with("test", F.slice("p", 1, F.size("test")), lambda a, p: F.abs(a - p))
    scored = f.select("series.series", "series.fold", F.col("series.test").alias("test"), F.col("ensemble.predictions").alias("p")).select("series", "fold", _mean(pairs).alias("score"))
    got = scored.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "score"))), lambda x: F.round(x["score"], 6)).alias("scores"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.stddev_pop("score"), 6).alias("std_score"))
    none = F.array().cast("array<double>")
    return df.select("series").join(got, "series", "left").select("series", F.coalesce("scores", none).alias("scores"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("std_score", F.lit(0.0)).alias("std_score"))
