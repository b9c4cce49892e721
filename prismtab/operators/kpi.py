"""Key figures: formulas over aggregates, status against thresholds, health, trend, suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.formula import compile_formula

HIGHER, LOWER = "higher_is_better", "lower_is_better"


@dataclass(frozen=True)
class KPI:
    name: str
    formula: str
    thresholds: dict[str, float] = field(default_factory=dict)
    direction: str = HIGHER
    unit: str = ""


def status(value: Column, thresholds: dict[str, float], direction: str) -> Column:
    """on_track, warning or critical; bounds belong to the better side, and one that isn't given is 0."""
    good, fair = (F.lit(float(thresholds.get(k, 0.0))) for k in ("on_track", "warning"))
    reaches = (lambda t: value >= t) if direction == HIGHER else (lambda t: value <= t)
    return F.when(reaches(good), "on_track").when(reaches(fair), "warning").otherwise("critical")


class Registry:
    """Key figures by name; defining one again replaces it."""

    def __init__(self) -> None:
        self.kpis: dict[str, KPI] = {}

    def define(self, name: str, formula: str, thresholds: dict[str, float] | None = None, direction: str = HIGHER, unit: str = "") -> KPI:
        self.kpis[name] = KPI(name, formula, dict(thresholds or {}), direction, unit)
        return self.kpis[name]

    def compute(self, name: str, data: DataFrame, keys: list[str] = ()) -> DataFrame:
        """keys, kpi, value (6 places), status, unit, trend for each row of data. KeyError for a name that isn't defined; trend is empty."""
        if name not in self.kpis:
            raise KeyError(name)
        return self._rows(data, [self.kpis[name]], list(keys))

    def compute_all(self, data: DataFrame, keys: list[str] = ()) -> DataFrame:
        """All defined figures, in one pass over data's rows."""
        return self._rows(data, list(self.kpis.values()), list(keys))

    def _rows(self, data: DataFrame, kpis: list[KPI], keys: list[str]) -> DataFrame:
        cells = []
        for k in kpis:
            value = compile_formula(k.formula, data.columns)
            cells.append(F.struct(F.lit(k.name).alias("kpi"), F.round(value, 6).alias("value"), status(F.round(value, 6), k.thresholds, k.direction).alias("status"), F.lit(k.unit).alias("unit"), F.lit(None).cast("string").alias("trend")))
        if not cells:
            return data.sparkSession.createDataFrame([], "kpi string, value double, status string, unit string, trend string")
        return data.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def health(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, n_kpis, health_score: the share of figures on track (6 places), 0 without figures."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_kpis"), F.round(F.coalesce(F.avg((F.col("status") == "on_track").cast("double")), F.lit(0.0)), 6).alias("health_score"))


def trend(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, trend, relative_slope: the slope of value over its position 0, 1, ... divided by its range; beyond 0.1 it is improving
    or declining, else stable, as it is for fewer than two values. A straight line's is 1 / (n - 1), so long lines are stable.
    order must number the values without gaps."""
    at, x = F.col(order).cast("double"), F.col(value).cast("double")
    spread = F.max(x) - F.min(x)
    slope = F.when((F.count(x) > 1) & (spread > 0), F.regr_slope(x, at) / F.nullif(spread, F.lit(0.0)))
    out = series.groupBy(*keys).agg(F.coalesce(slope, F.lit(0.0)).alias("relative_slope"))
    return out.select(*keys, F.when(F.col("relative_slope") > 0.1, "improving").when(F.col("relative_slope") < -0.1, "declining").otherwise("stable").alias("trend"), F.round("relative_slope", 6).alias("relative_slope"))


#: What a column's name suggests.
SUGGESTIONS = (
    (r"revenue", "revenue_growth", "revenue / 1", 10000, 5000, HIGHER),
    (r"cost", "cost_reduction", "cost / 1", 1000, 5000, LOWER),
    (r"conversion", "conversion_rate", "conversion / 1", 0.1, 0.05, HIGHER),
    (r"churn", "churn_rate", "churn / 1", 0.05, 0.1, LOWER),
    (r"satisfaction|nps", "satisfaction_score", "satisfaction / 1", 8.0, 6.0, HIGHER),
    (r"response.?time", "response_time", "response_time / 1", 200, 500, LOWER),
    (r"profit", "profit_margin", "profit / 1", 0.2, 0.1, HIGHER),
)


def suggest(columns: list[str]) -> list[KPI]:
    """One figure for each name that the columns suggest, in the columns' order."""
    out: dict[str, KPI] = {}
    for c in columns:
        for pattern, name, formula, good, fair, direction in SUGGESTIONS:
            if name not in out and re.search(pattern, c.lower()):
                out[name] = KPI(name, formula, {"on_track": good, "warning": fair}, direction)
    return list(out.values())
