"""Boosted trees for many classes, one against the rest, fitted on counts of rows that fall into the same bins."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.store import cut

#: Different rows, by their bins, that a task holds at most; beyond, Spark fits class by class. Distinct values that are counted to place splits.
CELLS, VALUES = 1 << 20, 10_000
#: Numbers of an array at once, classes of a task.
AT_ONCE, TOGETHER = 1 << 20, 16


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Where a column's sorted values may be split, as Spark's trees have it: all middles, or those that part equal shares of the rows."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    stride = counts.sum() / bins
    total, target, out = np.cumsum(counts), stride, []
    for i in range(1, len(values)):
        if abs(total[i - 1] - target) < abs(total[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _key(splits: list[np.ndarray]) -> Column:
    """The bins of a row's features from 1, a byte each."""

    @F.pandas_udf("binary")
    def key(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()).reshape(len(values), -1) if len(values) else np.zeros((0, len(splits)))
        at = np.stack([np.searchsorted(s, x[:, j]) + 1 for j, s in enumerate(splits)], 1).astype(np.uint8)
        return pd.Series([k.tobytes() for k in at], dtype=object)

    return key(vector_to_array("features"))


def _cells(keys: list[bytes]) -> np.ndarray:
    """Bins from 0 of sorted keys."""
    return np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1) - 1


def boost(cells: np.ndarray, counts: np.ndarray, hits: np.ndarray, rounds: int, depth: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature, split (classes x rounds x inner nodes), value (classes x rounds x leaves, times their weight) and gains (classes x features)
    of trees for hits (classes x cells) among counts rows of each cell: log loss on -1 and 1, the first tree in full, the others by step.

    Rows of a cell and class have the same residual in each round, so sums over cells are sums over rows. A node that isn't split has all on its left.
    """
    k, (v, width) = len(hits), cells.shape
    bins = int(cells.max()) + 1
    inner = (1 << depth) - 1
    feature, split = np.zeros((k, rounds, inner), np.uint8), np.full((k, rounds, inner), 255, np.uint8)
    value, gains = np.zeros((k, rounds, inner + 1)), np.zeros((k, width))
    raw = np.zeros((k, v))
    rest = counts - hits
    who, columns = np.arange(k)[:, None], cells.T.astype(np.int64)
    many = np.broadcast_to(counts.astype(float), (k, v)).ravel()
    for t in range(rounds):
        r = hits * (4 / (1 + np.exp(2 * raw))) - rest * (4 / (1 + np.exp(-2 * raw))) if t else (hits - rest).astype(float)
        flat, node, alive = r.ravel(), np.zeros((k, v), np.int64), np.ones((k, 1), bool)
        for level in range(depth):
            nodes = 1 << level
            base = (who * nodes + node) * bins
            best = np.zeros((k, nodes))
            chosen = np.zeros((k, nodes), np.int64)
            where = np.full((k, nodes), 255)
            for j in range(width):
                at = (base + columns[j]).ravel()
                s = np.bincount(at, flat, k * nodes * bins).reshape(k, nodes, bins).cumsum(2)
                n = np.bincount(at, many, k * nodes * bins).reshape(k, nodes, bins).cumsum(2)
                all_s, all_n = s[:, :, -1:], n[:, :, -1:]
                right = all_n - n
                ok = (n > 0) & (right > 0)
                whole = all_s * all_s / np.maximum(all_n, 1)
                gain = np.where(ok, s * s / np.maximum(n, 1) + (all_s - s) ** 2 / np.maximum(right, 1) - whole, 0)
                gain[gain <= 1e-12 * whole] = 0  # rounding
                b = gain.argmax(2)
                g = np.take_along_axis(gain, b[:, :, None], 2)[:, :, 0]
                more = (g > best * (1 + 1e-12)) & alive
                best, chosen, where = np.where(more, g, best), np.where(more, j, chosen), np.where(more, b, where)
            alive = where < 255
            here = slice(nodes - 1, 2 * nodes - 1)
            feature[:, t, here], split[:, t, here] = chosen, where
            np.add.at(gains, (np.repeat(np.arange(k), nodes), chosen.ravel()), best.ravel())
            mine = cells[np.arange(v)[None, :], np.take_along_axis(chosen, node, 1)]
            node = 2 * node + (mine > np.take_along_axis(where, node, 1))
            alive = np.repeat(alive, 2, axis=1)
        at = (who * (inner + 1) + node).ravel()
        n = np.bincount(at, many, k * (inner + 1))
        value[:, t] = (np.bincount(at, flat, k * (inner + 1)) / np.maximum(n, 1) * (step if t else 1.0)).reshape(k, -1)
        raw += np.take_along_axis(value[:, t], node, 1)
    return feature, split, value, gains


def score(cells: np.ndarray, feature: np.ndarray, split: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The trees' sums: classes x cells."""
    k, v, rounds = len(feature), len(cells), feature.shape[1]
    depth, out, all_cells = feature.shape[2].bit_length(), np.zeros((k, v)), np.arange(v)[None, :]
    for t in range(rounds):
        node = np.zeros((k, v), np.int64)
        for level in range(depth):
            place = node + (1 << level) - 1
            node = 2 * node + (cells[all_cells, np.take_along_axis(feature[:, t], place, 1)] > np.take_along_axis(split[:, t], place, 1))
        out += np.take_along_axis(value[:, t], node, 1)
    return out


class ManyClassesModel:
    """Trees of some classes in each row of trees (first, blob), which stay where the cluster's checkpoints are."""

    def __init__(self, trees: DataFrame, splits: list[np.ndarray], shares: np.ndarray) -> None:
        self.trees, self.splits, self.shares = trees, splits, shares

    @property
    def featureImportances(self):  # noqa: N802  as Spark's models name it
        from pyspark.ml.linalg import DenseVector

        return DenseVector(self.shares)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows and prediction, the class with the greatest sum, the first of equal ones. Each cell of rows is scored once for each class, CELLS cells at a time."""
        kept = rows.columns
        keyed = rows.withColumn("key", _key(self.splits))
        cells = cut(keyed.select("key").distinct())
        parts = -(-cells.count() // CELLS)
        said = []
        for part in range(parts):
            keys = sorted(bytes(r["key"]) for r in cells.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key").collect())  # about CELLS
            if not keys:
                continue

            def work(batches: Iterator[pa.RecordBatch], keys: list[bytes] = keys) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        z, at = np.load(io.BytesIO(blob)), _cells(keys)
                        size = max(1, AT_ONCE // len(z["feature"]))
                        for a in range(0, len(at), size):
                            s = score(at[a : a + size], z["feature"], z["split"], z["value"])
                            best = s.argmax(0)
                            yield pa.record_batch([pa.array(keys[a : a + size], pa.binary()), pa.array(s[best, np.arange(s.shape[1])]), pa.array(-(first + best), pa.int64())], ["key", "s", "c"])

            found = self.trees.select("first", "blob").mapInArrow(work, "key binary, s double, c long")
            said.append(cut(found.groupBy("key").agg((-F.max(F.struct("s", "c"))["c"]).cast("double").alias("prediction"))))
        if not said:
            return rows.withColumn("prediction", F.lit(0.0))
        table = said[0]
        for more in said[1:]:
            table = table.union(more)
        return keyed.join(F.broadcast(table) if parts == 1 else table, "key").select(*kept, "prediction")


class ManyClasses:
    """Spark's boosted trees for each class against the rest, with all rows that share bins and class as one with a count.

    Spark's trees look at bins alone, so the trees are those of all rows; their splits are placed by all rows' values where Spark
    samples. Classes are fitted in tasks, TOGETHER in each. More than CELLS different rows are fitted by Spark, class by class.
    """

    def __init__(self, rounds: int = 100, depth: int = 4, step: float = 0.1, bins: int = 32, seed: int = 42) -> None:
        self.rounds, self.depth, self.step, self.bins, self.seed = rounds, depth, step, bins, seed

    def _splits(self, rows: DataFrame) -> list[np.ndarray]:
        features = rows.select(vector_to_array("features").alias("x"))
        out = []
        for j in range(len(features.first()["x"])):
            x = features.select(F.col("x")[j].alias("v"))
            counted = sorted((r["v"], r["n"]) for r in x.groupBy("v").agg(F.count("*").alias("n")).limit(VALUES + 1).collect())
            if len(counted) > VALUES:
                out.append(np.unique(np.array(x.agg(F.percentile_approx("v", [i / self.bins for i in range(1, self.bins)], 100 * self.bins)).first()[0], float)))
            else:
                out.append(thresholds(*(np.array(c, float) for c in zip(*counted, strict=True)), self.bins))
        return out

    def fit(self, rows: DataFrame):
        splits = self._splits(rows)
        counted = cut(rows.select(F.col("label").cast("double").alias("label"), _key(splits).alias("key")).groupBy("key", "label").agg(F.count("*").alias("n")))
        found = counted.groupBy("key").agg(F.sum("n").alias("n")).limit(CELLS + 1).collect()
        if len(found) > CELLS:
            return C.OneVsRest(classifier=C.GBTClassifier(maxIter=self.rounds, stepSize=self.step, maxDepth=self.depth, maxBins=self.bins, seed=self.seed)).fit(rows)
        found = sorted((bytes(r["key"]), r["n"]) for r in found)
        keys, counts = [k for k, _ in found], np.array([n for _, n in found], float)
        spark, rounds, depth, step = rows.sparkSession, self.rounds, self.depth, self.step
        classes = int(counted.agg(F.max("label")).first()[0]) + 1
        tasks = max(1, min(-(-classes // TOGETHER), 8 * spark.sparkContext.defaultParallelism))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            table = pa.Table.from_batches(batches)
            label, key, n = table.column("label").to_numpy().astype(int), np.array(table.column("key").to_pylist(), object), table.column("n").to_numpy()
            order, cells = {k: i for i, k in enumerate(keys)}, _cells(keys)
            mine = np.unique(label)
            size = max(1, min(TOGETHER, AT_ONCE // len(keys)))
            for a in range(0, len(mine), size):
                some = mine[a : a + size]
                here = np.isin(label, some) & (n > 0)
                hits = np.zeros((len(some), len(keys)))
                hits[np.searchsorted(some, label[here]), [order[k] for k in key[here]]] = n[here]
                feature, split, value, gains = boost(cells, counts, hits, rounds, depth, step)
                for run in np.split(np.arange(len(some)), np.flatnonzero(np.diff(some) != 1) + 1):  # a blob's classes follow each other
                    blob = io.BytesIO()
                    np.savez(blob, feature=feature[run], split=split[run], value=value[run])
                    shares = gains[run] / np.where(gains[run].sum(1) > 0, gains[run].sum(1), 1)[:, None]
                    yield pa.record_batch([pa.array([int(some[run[0]])], pa.int64()), pa.array([blob.getvalue()], pa.binary()), pa.array([shares.sum(0).tolist()], pa.list_(pa.float64()))], ["first", "blob", "shares"])

        every = spark.range(classes).select(F.lit(keys[0]).alias("key"), F.col("id").cast("double").alias("label"), F.lit(0).cast("long").alias("n"))  # classes without a row too
        dealt = counted.union(every).withColumn("task", F.floor(F.col("label") * tasks / classes)).repartitionByRange(tasks, "task")
        trees = cut(dealt.mapInArrow(work, "first long, blob binary, shares array<double>"))
        shares = np.sum([r["shares"] for r in trees.select("shares").collect()], axis=0) / classes  # a row for each run of classes
        return ManyClassesModel(trees, splits, shares)
