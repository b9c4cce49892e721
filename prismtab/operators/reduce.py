"""Fewer dimensions: principal components from a p x p matrix, and t-SNE, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.columns import finite
from prismtab.operators.regression import centred_gram

#: Rows that t-SNE embeds together at most, as it compares all pairs; the rows of a larger table are placed among them.
TSNE_ROWS = 3000


@dataclass(frozen=True)
class Components:
    """Fitted on standardised columns: row i of vectors is the i-th component, its greatest entry positive."""

    columns: list[str]
    means: np.ndarray
    widths: np.ndarray
    vectors: np.ndarray
    eigenvalues: np.ndarray
    ratios: np.ndarray

    def transform(self, df: DataFrame, row_id: str, n: int) -> DataFrame:
        """row_id, pc1 ... pcn of rows that have all columns: one projection, no shuffle."""
        x = [(F.col(c) - float(m)) / float(w) for c, m, w in zip(self.columns, self.means, self.widths, strict=True)]
        rows = df.select(F.col(row_id).alias("row_id"), *[finite(c).alias(c) for c in self.columns]).na.drop("any", subset=self.columns)
        dot = lambda v: sum((a * float(b) for a, b in zip(x, v, strict=True)), F.lit(0.0))
        return rows.select("row_id", *[dot(self.vectors[i]).alias(f"pc{i + 1}") for i in range(min(n, len(self.vectors)))])


def fit(df: DataFrame, columns: list[str]) -> Components:
    rows = df.select(*[finite(c).alias(c) for c in columns]).na.drop("any")
    n, means, s = centred_gram(rows, columns)
    widths = np.sqrt(np.diag(s) / max(n, 1))
    widths = np.where(widths > 0, widths, 1.0)
    scaled = s / max(n - 1, 1) / np.outer(widths, widths)
    np.fill_diagonal(scaled, np.where(np.diag(s) > 0, n / max(n - 1, 1), 0.0))  # alike to the last digit, as nearly uncorrelated columns have axes that a digit would turn
    values, vectors = np.linalg.eigh(scaled)
    order = np.argsort(-values, kind="stable")[: min(n, len(columns))]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.zeros(0)
    total = values.sum() or 1.0
    return Components(columns, means, widths, vectors * np.where(sign == 0, 1, sign)[:, None], values, values / total)


class Reducer:
    """Remembers the last fitted components for new rows."""

    def __init__(self) -> None:
        self.last: tuple[Components, int] | None = None

    def pca(self, df: DataFrame, row_id: str, columns: list[str], n: int = 2) -> DataFrame:
        """row_id, pc1 ... ; n is at most the number of rows and of columns."""
        c = fit(df, columns)
        self.last = (c, min(n, len(c.vectors)))
        return c.transform(df, row_id, n)

    def auto_pca(self, df: DataFrame, row_id: str, columns: list[str], share: float = 0.95) -> DataFrame:
        """As pca, with the least number of components that explain the share of variance."""
        c = fit(df, columns)
        n = min(int(np.searchsorted(np.cumsum(c.ratios), share - 1e-12)) + 1, len(c.vectors))
        self.last = (c, n)
        return c.transform(df, row_id, n)

    def transform_new(self, df: DataFrame, row_id: str) -> DataFrame:
        """New rows on the last fitted components; RuntimeError before there are any."""
        if self.last is None:
            raise RuntimeError("fit components first")
        return self.last[0].transform(df, row_id, self.last[1])


def scree(df: DataFrame, columns: list[str]) -> DataFrame:
    """component, eigenvalue (divisor n - 1), ratio, cumulative, 6 places."""
    c = fit(df, columns)
    rows = [(i + 1, round(float(v), 6), round(float(r), 6), round(float(t), 6)) for i, (v, r, t) in enumerate(zip(c.eigenvalues, c.ratios, np.cumsum(c.ratios), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, ratio double, cumulative double")


def tsne(df: DataFrame, row_id: str, columns: list[str], n: int = 2, perplexity: float = 30.0, seed: int = 42) -> DataFrame:
    """row_id, d1 ... dn of each row: exact t-SNE of standardised rows. Perplexity is at most the rows less one.

    Of more than TSNE_ROWS rows, those with the least hash are embedded together, and each other row is put at the mean of their
    points, weighted by its affinities to them at the same perplexity.
    """
    from prismtab.operators.outliers import _rows, _scaled

    x = _scaled(_rows(df, row_id, columns), columns)
    kind = df.schema[row_id].dataType.simpleString()
    schema = ", ".join([f"row_id {kind}", *[f"d{i + 1} double" for i in range(n)]])
    names = ["row_id", *[f"d{i + 1}" for i in range(n)]]
    larger = x.limit(TSNE_ROWS + 1).count() > TSNE_ROWS

    def matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.column_stack([t.column(c).to_numpy() for c in columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts or not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts).sort_by("row_id")
        y = embed(matrix(t), n, perplexity, seed)
        more = [t.column(c).combine_chunks() for c in columns] if larger else []
        yield pa.record_batch([t.column("row_id").combine_chunks(), *[pa.array(y[:, i]) for i in range(n)], *more], [*names, *(f"x{i}" for i in range(len(more)))])

    # At most TSNE_ROWS rows go to the one task.
    if not larger:
        return x.repartition(1).mapInArrow(work, schema)
    picked = x.orderBy(F.xxhash64("row_id"), "row_id", *columns).limit(TSNE_ROWS).repartition(1)
    width = len(columns)
    fitted = picked.mapInArrow(work, ", ".join([schema, *[f"x{i} double" for i in range(width)]])).collect()  # the bounded sample
    points = np.array([list(r)[1 : 1 + n] for r in fitted], float)
    among = np.array([list(r)[1 + n :] for r in fitted], float)
    known = {(r[0], *r[1 + n :]): i for i, r in enumerate(fitted)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                mine = matrix(part)
                y = affinities(((mine[:, None, :] - among[None, :, :]) ** 2).sum(2), perplexity) @ points
                for i, key in enumerate(zip(part.column("row_id").to_pylist(), *mine.T.tolist(), strict=True)):
                    if key in known:
                        y[i] = points[known[key]]
                yield pa.record_batch([part.column("row_id"), *[pa.array(y[:, i]) for i in range(n)]], names)

    return x.mapInArrow(place, schema)


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows' shares of their neighbours, by squared distances d: Gaussian, as wide as their entropy fits the perplexity; infinite ones get none."""
    shifted = np.maximum(d - d.min(1)[:, None], 0)
    finite_ = np.where(np.isfinite(shifted), shifted, 0)
    beta, lo, hi = np.ones(len(d)), np.zeros(len(d)), np.full(len(d), np.inf)
    for _ in range(60):  # the width around each row at which its neighbours' entropy fits the perplexity
        p = np.exp(-shifted * beta[:, None])
        total = np.maximum(p.sum(1), 1e-300)
        entropy = np.log(total) + beta * (finite_ * p).sum(1) / total
        wide = entropy > np.log(perplexity)
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return p / total[:, None]


def embed(x: np.ndarray, n: int, perplexity: float, seed: int, rounds: int = 500) -> np.ndarray:
    m = len(x)
    rng = np.random.default_rng(seed)
    y = rng.standard_normal((m, n)) * 1e-4
    if m < 3:
        return y
    perplexity = min(perplexity, m - 1)
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, 0)
    beta, lo, hi = np.ones(m), np.zeros(m), np.full(m, np.inf)
    for _ in range(60):  # the width around each row at which its neighbours' entropy fits the perplexity
        shifted = d - np.where(np.eye(m, dtype=bool), np.inf, d).min(1)[:, None]
        p = np.exp(-np.maximum(shifted, 0) * beta[:, None])
        np.fill_diagonal(p, 0)
        total = np.maximum(p.sum(1), 1e-300)
        entropy = np.log(total) + beta * (np.maximum(shifted, 0) * p).sum(1) / total
        wide = entropy > np.log(perplexity)
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p /= total[:, None]
    p = np.maximum((p + p.T) / (2 * m), 1e-12)
    speed, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(m / 12 / 4, 50)
    for t in range(rounds):
        square = (y * y).sum(1)
        num = 1 / (1 + np.maximum(square[:, None] + square[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(num, 0)
        w = (p * (12 if t < 125 else 1) - np.maximum(num / num.sum(), 1e-12)) * num
        g = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where((g > 0) == (speed > 0), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if t < 125 else 0.8) * speed - rate * gain * g
        y = y + speed
        y -= y.mean(0)
    return y


def compare(df: DataFrame, row_id: str, columns: list[str], n: int = 2) -> DataFrame:
    """method, row_id, d1 ... dn of both methods."""
    pca = Reducer().pca(df, row_id, columns, n)
    a = pca.select(F.lit("pca").alias("method"), "row_id", *[F.col(f"pc{i + 1}").alias(f"d{i + 1}") for i in range(n)])
    return a.unionByName(tsne(df, row_id, columns, n).select(F.lit("tsne").alias("method"), "*"))
