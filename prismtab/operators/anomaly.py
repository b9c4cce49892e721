"""Anomalies of single columns: distance from the mean, distance beyond the quartiles, and both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.functions.columns import finite
from prismtab.operators.profile import exact_quantiles

Z, FENCE = 3.0, 1.5


def _long(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("value")) for c in columns])
    return df.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.column", "c.value").filter("value is not null")


def _side(high: Column) -> Column:
    return F.when(high, "high").otherwise("low")


def zscore(df: DataFrame, row_id: str, columns: list[str], threshold: float = Z) -> DataFrame:
    """row_id, column, value, method, score, direction of finite values more than threshold population deviations from the mean.

    score is that distance, rounded to 4 places. A column with fewer than two values or no spread has none.
    """
    aggs = [f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"), (F.count, "n"))]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.when((F.col(f"n{i}") > 1) & (F.col(f"s{i}") > 0), F.col(f"s{i}")).alias("sd")) for i, c in enumerate(columns)]
    stats = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")  # a row for each column
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return _long(df, row_id, columns).join(F.broadcast(stats), "column").filter(F.abs(z) > threshold).select("row_id", "column", "value", F.lit("zscore").alias("method"), F.round(F.abs(z), 4).alias("score"), _side(z > 0).alias("direction"))


def iqr(df: DataFrame, row_id: str, columns: list[str], factor: float = FENCE) -> DataFrame:
    """As zscore, for values beyond factor interquartile ranges outside the quartiles; score is the distance from the fence in
    ranges. A column whose range is 0 has none."""
    counts = _long(df, row_id, columns).groupBy("column", F.col("value").alias("number")).agg(F.count("*").alias("n"))
    q = exact_quantiles(counts, [0.25, 0.75])
    span = F.col("q")[1] - F.col("q")[0]
    fences = q.filter(span > 0).select("column", span.alias("span"), (F.col("q")[0] - factor * span).alias("low"), (F.col("q")[1] + factor * span).alias("high"))  # a row for each column
    v = F.col("value")
    beyond = F.greatest(F.col("low") - v, v - F.col("high"))
    return _long(df, row_id, columns).join(F.broadcast(fences), "column").filter((v < F.col("low")) | (v > F.col("high"))).select("row_id", "column", "value", F.lit("iqr").alias("method"), F.round(beyond / F.col("span"), 4).alias("score"), _side(v > F.col("high")).alias("direction"))


def detect_all(df: DataFrame, row_id: str, columns: list[str], threshold: float = Z, factor: float = FENCE) -> DataFrame:
    """Both methods; a cell that both find keeps the one with the greater score, zscore if they are equal."""
    both = zscore(df, row_id, columns, threshold).unionByName(iqr(df, row_id, columns, factor))
    best = F.max(F.struct("score", (F.col("method") == "zscore").alias("first"), "value", "method", "direction"))
    return both.groupBy("row_id", "column").agg(best.alias("b")).select("row_id", "column", "b.value", "b.method", "b.score", "b.direction")


def summary(anomalies: DataFrame) -> DataFrame:
    """One row: total_anomalies, columns_affected, per_column (map), and the row, column and score of the greatest, the least column and row_id of equals."""
    per = anomalies.groupBy("column").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("score")).alias("s"), "column", "row_id")).alias("top"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_anomalies"), F.count("*").alias("columns_affected"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "n")))).alias("per_column"), F.min("top").alias("t"))
    return one.select("total_anomalies", "columns_affected", "per_column", F.col("t.row_id").alias("top_row"), F.col("t.column").alias("top_column"), (-F.col("t.s")).alias("top_score"))
