"""Least squares and its diagnostics from one pass of sums.

Every row adds to a p x p matrix of products; the driver inverts it, and leverage is the
quadratic form of a row with the inverse, a column expression. No n x n matrix and no
refitting for each predictor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.functions import distributions as d
from prismtab.operators.stats import normality

VIF_HIGH = {"basic": 10.0, "advanced": 5.0}


@dataclass(frozen=True)
class Fit:
    columns: list[str]
    intercept: float
    coefficients: list[float]
    n: int
    r2: float
    #: Of the predictors, with the intercept first.
    inverse: np.ndarray

    def predicted(self) -> Column:
        return sum((F.col(c).cast("double") * b for c, b in zip(self.columns, self.coefficients, strict=True)), F.lit(self.intercept))


def _x(c: str) -> Column:
    return F.col(c).cast("double")


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of (1, columns...) over rows that have them all."""
    rows = df.select(*[_x(c).alias(c) for c in columns]).na.drop("any")
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    r = rows.agg(*[F.coalesce(F.sum(terms[i] * terms[j]), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(terms), len(terms)))
    for i, j in pairs:
        out[i, j] = out[j, i] = r[f"s{i}_{j}"]
    return out


def _sums(rows: DataFrame, columns: list[str], terms: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[int, list[float]]:
    """Rows, and the sum of each of the terms of (columns x rows): pairwise in a batch and without rounding between batches, as running sums
    over tens of millions of rows lose five digits. A row for each task comes to the driver."""
    n = len(terms(np.zeros((len(columns), 1))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, parts = 0, []
        for batch in batches:
            if batch.num_rows:
                count += batch.num_rows
                parts.append([float(np.ascontiguousarray(v).sum()) for v in terms(np.stack([c.to_numpy() for c in batch.columns]))])
        if parts:
            yield pa.record_batch([pa.array([count], pa.int64()), *[pa.array([_total(p)]) for p in zip(*parts, strict=True)]], ["n", *[f"s{i}" for i in range(n)]])

    got = rows.mapInArrow(work, ", ".join(["n long", *[f"s{i} double" for i in range(n)]])).collect()
    return sum(r["n"] for r in got), [_total([r[f"s{i}"] for r in got]) for i in range(n)]


def _total(values: Sequence[float]) -> float:
    return math.fsum(values) if all(map(math.isfinite, values)) else float(np.sum(values))


def centred_gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means, and sums of products of deviations: two passes, so large means don't cost digits."""
    rows = df.select(*[_x(c).alias(f"c{i}") for i, c in enumerate(columns)]).na.drop("any")
    n, totals = _sums(rows, columns, list)
    if not n:
        return 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2)
    means = np.array(totals) / n
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]

    def products(x: np.ndarray) -> list[np.ndarray]:
        dev = x - means[:, None]
        return [dev[i] * dev[j] for i, j in pairs]

    out = np.zeros((len(columns),) * 2)
    for (i, j), s in zip(pairs, _sums(rows, columns, products)[1], strict=True):
        out[i, j] = out[j, i] = s
    return n, means, out


def ols(df: DataFrame, columns: list[str], y: str) -> Fit:
    """Least squares with an intercept; a singular matrix is pseudo-inverted."""
    n, means, s = centred_gram(df, [*columns, y])
    p = len(columns)
    sxx, sxy, syy = s[:p, :p], s[:p, p], s[p, p]
    inner = np.linalg.pinv(sxx)
    b = inner @ sxy
    r2 = float(b @ sxy / syy) if syy > 0 else 0.0
    inverse = np.zeros((p + 1, p + 1))
    inverse[1:, 1:] = inner
    inverse[0, 1:] = inverse[1:, 0] = -inner @ means[:p]
    inverse[0, 0] = (1 / n if n else 0.0) + means[:p] @ inner @ means[:p]
    return Fit(columns, float(means[p] - b @ means[:p]) if n else 0.0, [float(v) for v in b], n, r2, inverse)


def with_residuals(df: DataFrame, columns: list[str], y: str) -> tuple[DataFrame, Fit]:
    """Rows that have all values, with predicted and residual, and the fit."""
    fit = ols(df, columns, y)
    rows = df.na.drop("any", subset=[*columns, y]).withColumn("predicted", fit.predicted())
    return rows.withColumn("residual", _x(y) - F.col("predicted")), fit


def quadratic(columns: list[Column], matrix: np.ndarray) -> Column:
    """x' M x of each row."""
    total = F.lit(0.0)
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            total = total + a * columns[j] * float(matrix[i, j] * (1 if i == j else 2))
    return total


def durbin_watson(df: DataFrame, order: str, residual: str = "residual", none: float = 2.0) -> float:
    """Squared differences of neighbours over squares; `none` for fewer than two rows or no squares.

    Neighbours meet across slices of the order: each slice's first row is handed to the one before.
    """
    from prismtab.functions.neighbours import with_previous

    r = with_previous(df.select(F.col(order).alias("o"), _x(residual).alias("e")), "o", "e").agg(F.count("e").alias("n"), F.sum((F.col("e") - F.col("previous")) ** 2).alias("d"), F.sum(F.col("e") ** 2).alias("s")).first()
    return float((r["d"] or 0.0) / r["s"]) if r["n"] > 1 and r["s"] else none


def residual_stats(df: DataFrame, order: str, residual: str = "residual", tier: str = "advanced") -> dict:
    """Mean, sample deviation, normality and Durbin-Watson of residuals; the advanced tier adds skewness and excess kurtosis (both
    of the population) and takes 0 instead of 2 where Durbin-Watson can't be had."""
    e = _x(residual)
    r = df.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.stddev_pop(e).alias("sp"), F.skewness(e).alias("skew"), F.kurtosis(e).alias("kurtosis")).first()
    out = {"n": r["n"], "mean": r["mean"] or 0.0, "std": r["std"] or 0.0}
    test = normality(df, residual) if r["n"] >= 3 else None
    out |= {"shapiro": test.statistic if test else math.nan, "shapiro_p": test.p_value if test else math.nan}
    out["durbin_watson"] = durbin_watson(df, order, residual, 2.0 if tier == "basic" else 0.0)
    if tier == "advanced":
        out |= {"skewness": r["skew"] if r["sp"] else 0.0, "kurtosis": r["kurtosis"] if r["sp"] else 0.0}
    return out


def vif(df: DataFrame, columns: list[str], tier: str = "basic", threshold: float | None = None) -> DataFrame:
    """ordinal, feature, vif, high: 1 / (1 - R²) of each predictor on the others, the diagonal of the inverse correlation matrix.

    One feature has 1. In the basic tier (4 places, high beyond 10) perfect dependence is infinite; the advanced tier (6 places, beyond 5)
    also calls a constant column's infinite.
    """
    limit = VIF_HIGH[tier] if threshold is None else threshold
    n, _, s = centred_gram(df, columns)
    sd = np.sqrt(np.diag(s))
    constant = sd <= 1e-12 * max(1.0, float(sd.max(initial=0)))
    used = [i for i in range(len(columns)) if not constant[i]]
    values = [math.inf if constant[i] and tier == "advanced" else 1.0 for i in range(len(columns))]
    if len(used) > 1:
        r = s[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        for k, i in enumerate(used):
            others = [j for j in range(len(used)) if j != k]
            explained = float(r[k, others] @ np.linalg.pinv(r[np.ix_(others, others)]) @ r[others, k])
            explained = min(1.0, max(0.0, explained))
            values[i] = math.inf if explained >= 1 - 1e-12 else 1 / (1 - explained)
    places = 4 if tier == "basic" else 6
    rows = [(i, c, v if math.isinf(v) else round(v, places), bool(v > limit)) for i, (c, v) in enumerate(zip(columns, values, strict=True))]
    return df.sparkSession.createDataFrame(rows, "ordinal int, feature string, vif double, high boolean")


def influence(df: DataFrame, columns: list[str], y: str, row_id: str, tier: str = "advanced") -> DataFrame:
    """row_id, residual, leverage, cooks_distance, influential (beyond 4 / n).

    The basic tier takes its leverages from a matrix without intercept, though the model has one, and divides by as many
    degrees of freedom as there are predictors; the advanced tier counts the intercept in both.
    """
    rows, fit = with_residuals(df, columns, y)
    p = len(columns) + (tier == "advanced")
    if tier == "advanced":
        h = quadratic([F.lit(1.0), *[_x(c) for c in columns]], fit.inverse)
    else:
        g = gram(df.na.drop("any", subset=[y]), columns)[1:, 1:]
        h = quadratic([_x(c) for c in columns], np.linalg.pinv(g))
    sse = rows.agg(F.sum(F.col("residual") ** 2)).first()[0] or 0.0
    mse = sse / max(fit.n - p, 1)
    e, lev = F.col("residual"), F.col("leverage")
    out = rows.select(F.col(row_id).alias("row_id"), "residual", h.alias("leverage"))
    cooks = F.when((lev < 1) & F.lit(mse > 0), e * e / F.lit(p * mse if mse > 0 else 1.0) * lev / ((1 - lev) * (1 - lev))).otherwise(0.0)
    return out.withColumn("cooks_distance", cooks).withColumn("influential", F.col("cooks_distance") > 4 / max(fit.n, 1))


def heteroscedasticity(df: DataFrame, columns: list[str], residual: str = "residual") -> tuple[float, float]:
    """F and p of squared residuals regressed on the predictors."""
    squared = df.withColumn("e2__", _x(residual) ** 2)
    fit = ols(squared, columns, "e2__")
    p, rest = len(columns), fit.n - len(columns) - 1
    if rest <= 0 or fit.r2 >= 1:
        return 0.0, 1.0
    f = (fit.r2 / p) / ((1 - fit.r2) / rest)
    return f, d.f_sf(f, p, rest)


def diagnose(df: DataFrame, columns: list[str], y: str, order: str, tier: str = "advanced") -> DataFrame:
    """One row: the fit, residuals' statistics, largest VIF, influential rows, warnings, and quality: good without warnings, moderate with one or two, else poor."""
    rows, fit = with_residuals(df, columns, y)
    res = residual_stats(rows, order, "residual", tier)
    f, p = heteroscedasticity(rows, columns)
    v = vif(df, columns, tier)
    worst = max((r["vif"] for r in v.collect()), default=1.0)  # a row for each predictor
    flagged = influence(df, columns, y, order, tier).filter("influential").count()
    warnings = []
    if res["shapiro_p"] < 0.05:
        warnings.append("residuals are not normal")
    if not 1.5 <= res["durbin_watson"] <= 2.5:
        warnings.append("residuals are autocorrelated")
    if worst > VIF_HIGH[tier]:
        warnings.append("predictors are collinear")
    if flagged:
        warnings.append("some rows are influential")
    if abs(res.get("skewness", 0.0)) > 1:
        warnings.append("residuals are skewed")
    if p < 0.05 and tier == "basic":
        warnings.append("residuals' spread changes")
    quality = "good" if not warnings else "moderate" if len(warnings) <= 2 else "poor"
    row = (fit.n, fit.intercept, fit.coefficients, fit.r2, res["mean"], res["std"], res["shapiro_p"], res["durbin_watson"], f, p, worst, flagged, warnings, quality)
    return df.sparkSession.createDataFrame([row], "n long, intercept double, coefficients array<double>, r2 double, residual_mean double, residual_std double, shapiro_p double, durbin_watson double, bp_f double, bp_p double, max_vif double, n_influential long, warnings array<string>, quality string")
