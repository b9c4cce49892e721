"""Figures and anomaly limits over streams: windows with watermarks, thresholds from history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.columns import finite
from prismtab.operators.kpi import Registry


def windowed(stream: DataFrame, at: str, value: str, keys: list[str] = (), width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, start, n, total, mean of each window; rows later than `late` behind the newest are left out."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys)
    return g.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "total", "mean")


def limits(history: DataFrame, value: str, threshold: float = 3.0) -> tuple[float, float]:
    """The values that are threshold population deviations from the mean of a bounded table."""
    x = finite(value)
    r = history.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    m, s = r["m"] or 0.0, r["s"] or 0.0
    return m - threshold * s, m + threshold * s


def flag_anomalies(stream: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """The stream's rows beyond the limits, with direction; no state is kept."""
    x = finite(value)
    return stream.filter((x < low) | (x > high)).withColumn("direction", F.when(x > high, "high").otherwise("low"))


def kpi_stream(aggregated: DataFrame, registry: Registry, keys: list[str]) -> DataFrame:
    """Each window's figures and their status."""
    return registry.compute_all(aggregated, keys)
