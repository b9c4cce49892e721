"""Anomalies of rows over several columns: isolation forest, local outlier factor, Mahalanobis distance, and their votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.columns import finite
from prismtab.functions.nearest import k_nearest
from prismtab.functions.store import cut
from prismtab.operators.regression import centred_gram, quadratic

TREES, SUBSAMPLE = 100, 256
LOF_FACTOR = 1.5


def _rows(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """row_id and the columns as double, for rows that have them all."""
    return df.select(F.col(row_id).alias("row_id"), *[finite(c).alias(c) for c in columns]).na.drop("any", subset=columns)


def _scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    stats = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])  # one row
    one = lambda i: F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0)
    return rows.join(F.broadcast(stats)).select("row_id", *[((F.col(c) - F.col(f"m{i}")) / one(i)).alias(c) for i, c in enumerate(columns)])


def _output(df: DataFrame, columns: list[str], method: str, score: Column, flag: Column, context: dict[str, Column]) -> DataFrame:
    entries = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), F.round(v.cast("double"), 6))])
    return df.select("row_id", F.round(F.col(columns[0]), 6).alias("value"), F.lit(method).alias("method"), F.round(score, 6).alias("score"), flag.alias("anomaly"), entries.alias("context"))


def _path_rest(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of an unsuccessful search among n."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A random tree as arrays: feature (-1 for a leaf), threshold, left child, right child, path length at a leaf."""
    top = int(np.ceil(np.log2(max(len(x), 2))))
    feature, threshold, left, right, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        me = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (0, 0)
        open_ = np.flatnonzero(np.asarray(hi) > np.asarray(lo)) if len(rows) > 1 and depth < top else np.zeros(0, int)
        feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1), path.append(depth + float(_path_rest(len(rows))))
        if len(open_):
            j = int(rng.choice(open_))
            t = float(rng.uniform(lo[j], hi[j]))
            feature[me], threshold[me] = j, t
            below = x[rows, j] <= t
            todo += [(rows[below], depth + 1, me, False), (rows[~below], depth + 1, me, True)]
    return tuple(np.array(a) for a in (feature, threshold, left, right, path))


def isolation_forest(df: DataFrame, row_id: str, columns: list[str], contamination: float | str = "auto", seed: int = 42) -> DataFrame:
    """row_id, value (the first column), method, score (0 to 1, 1 the most isolated), anomaly, context.

    Trees are grown on the driver from TREES x SUBSAMPLE rows at most, chosen by hash, and scored where the rows are. "auto" calls
    rows anomalous whose mean path is shorter than that of random search; a number calls that share of rows so.
    """
    rows = _scaled(_rows(df, row_id, columns), columns)
    picked = rows.orderBy(F.xxhash64("row_id", F.lit(seed))).limit(TREES * SUBSAMPLE).select(*columns).collect()  # a bounded sample
    data = np.array([list(r) for r in picked], float).reshape(-1, len(columns))
    rng = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(data))
    forest = [_grow(data[rng.choice(len(data), size, replace=False)], rng) for _ in range(TREES)] if size else []
    norm = float(_path_rest(max(size, 2))) or 1.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(columns))]) if len(batch) else np.zeros((0, len(columns)))
            total = np.zeros(len(x))
            for feature, threshold, left, right, path in forest:
                node = np.zeros(len(x), int)
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
                    node = np.where(inner, np.where(go, left[node], right[node]), node)
                total += path[node]
            yield pa.record_batch([*batch.columns, pa.array(2.0 ** (-total / max(1, len(forest)) / norm))], names=[*batch.schema.names, "raw"])

    kind = df.schema[row_id].dataType.simpleString()
    scored = rows.mapInArrow(work, ", ".join([f"row_id {kind}", *[f"`{c}` double" for c in columns], "raw double"]))
    bounds = scored.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.percentile_approx("raw", F.lit(1 - (contamination if contamination != "auto" else 0.5)), 10000).alias("cut"))  # one row
    joined = scored.join(F.broadcast(bounds)).join(_rows(df, row_id, columns).select("row_id", F.col(columns[0]).alias("first__")), "row_id").drop(columns[0]).withColumnRenamed("first__", columns[0])
    score = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    flag = F.col("raw") > (0.5 if contamination == "auto" else F.col("cut"))
    return _output(joined, columns, "isolation_forest", score, flag, {"raw_score": F.col("raw")})


def local_outlier_factor(df: DataFrame, row_id: str, columns: list[str], n_neighbors: int = 20, factor: float = LOF_FACTOR) -> DataFrame:
    """As isolation_forest; a row is anomalous whose neighbourhood is more than factor times as dense as its own. Neighbours are exact
    over tables of any size, ties by row_id. Columns are standardised first."""
    rows = _scaled(_rows(df, row_id, columns), columns)
    k = min(n_neighbors, rows.count() - 1)
    if k < 1:
        return _output(_rows(df, row_id, columns).withColumn("lof", F.lit(1.0)), columns, "local_outlier_factor", F.lit(0.0), F.lit(False), {"lof": F.col("lof")})
    near = cut(k_nearest(rows, columns, k))
    kdist = near.groupBy("x").agg(F.max("dist").alias("kd"))
    reach = near.join(kdist.select(F.col("x").alias("y"), "kd"), "y").groupBy("x").agg((F.lit(1.0) / (F.avg(F.greatest("dist", "kd")) + 1e-10)).alias("lrd"))
    lof = near.join(reach.select(F.col("x").alias("y"), F.col("lrd").alias("other")), "y").groupBy("x").agg(F.avg("other").alias("o")).join(reach, "x").select(F.col("x").alias("row_id"), (F.col("o") / F.col("lrd")).alias("lof"))
    joined = _rows(df, row_id, columns).join(lof, "row_id")
    bounds = joined.agg(F.min("lof").alias("lo"), F.max("lof").alias("hi"))  # one row
    score = F.when(F.col("hi") > F.col("lo"), (F.col("lof") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return _output(joined.join(F.broadcast(bounds)), columns, "local_outlier_factor", score, F.col("lof") > factor, {"lof": F.col("lof")})


def mahalanobis(df: DataFrame, row_id: str, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """As isolation_forest; a row is anomalous beyond threshold. Sample covariance; where it can't be inverted, only its diagonal counts, zeros as 1e-10. score is the distance over the greatest one."""
    rows = _rows(df, row_id, columns)
    n, means, s = centred_gram(rows, columns)
    cov = s / max(n - 1, 1)
    try:
        inverse = np.linalg.inv(cov)
        if not np.isfinite(inverse).all() or np.abs(inverse).max() > 1e15:
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        diagonal = np.diag(cov).copy()
        diagonal[diagonal == 0] = 1e-10
        inverse = np.diag(1 / diagonal)
    dist = F.sqrt(F.greatest(F.lit(0.0), quadratic([F.col(c) - float(m) for c, m in zip(columns, means, strict=True)], inverse)))
    measured = rows.withColumn("distance", dist)
    joined = measured.join(F.broadcast(measured.agg(F.max("distance").alias("most"))))  # one row
    score = F.when(F.col("most") > 0, F.col("distance") / F.col("most")).otherwise(0.0)
    return _output(joined, columns, "mahalanobis", score, F.col("distance") > threshold, {"distance": F.col("distance")})


METHODS: dict[str, Callable[..., DataFrame]] = {"isolation_forest": isolation_forest, "lof": local_outlier_factor, "mahalanobis": mahalanobis}


def run(df: DataFrame, row_id: str, columns: list[str], methods: list[str] | None = None) -> dict[str, DataFrame]:
    """Each method's rows, by name; ValueError for an unknown name."""
    names = methods or list(METHODS)
    unknown = [m for m in names if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods {unknown}")
    return {m: METHODS[m](df, row_id, columns) for m in names}


def compare(df: DataFrame, row_id: str, columns: list[str], methods: list[str] | None = None) -> DataFrame:
    """All methods' rows, one under another; `method` says which."""
    parts = list(run(df, row_id, columns, methods).values())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ensemble(df: DataFrame, row_id: str, columns: list[str], methods: list[str] | None = None, voting: str = "majority") -> DataFrame:
    """row_id, value, score (the mean), votes, n_methods, anomaly: by more than half of the methods that gave the row a score, or, for voting "any", by one."""
    if voting not in ("majority", "any"):
        raise ValueError(f"unknown voting {voting!r}")
    every = compare(df, row_id, columns, methods)
    g = every.groupBy("row_id").agg(F.first("value").alias("value"), F.round(F.avg("score"), 6).alias("score"), F.count_if("anomaly").alias("votes"), F.count("*").alias("n_methods"))
    return g.withColumn("anomaly", F.col("votes") > (F.lit(0) if voting == "any" else F.col("n_methods") / 2))
