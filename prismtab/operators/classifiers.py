"""Classifiers that Spark has no estimator for: ridge, and the support vector machine with a radial kernel.

Both fit Spark's own linear models on rows (features, label); their models add `prediction`, as Spark's do.
"""

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _products(weights: np.ndarray, shifts: np.ndarray, waves: bool = False):
    """Of an array of numbers its product with each row of weights, plus that row's shift; with waves the cosine of it. A batch at a time."""

    @F.pandas_udf("array<double>")
    def products(values: pd.Series) -> pd.Series:
        out = np.stack(values.to_numpy()).reshape(len(values), -1) @ weights.T + shifts if len(values) else np.zeros((0, len(weights)))
        return pd.Series(list(np.cos(out) * np.sqrt(2 / len(weights)) if waves else out))

    return products


class RidgeModel:
    def __init__(self, weights: np.ndarray, intercepts: np.ndarray) -> None:
        #: A row for each class, or one row for two classes.
        self.weights, self.intercepts = weights, intercepts

    @property
    def coefficientMatrix(self):  # noqa: N802  as Spark's models name it
        from pyspark.ml.linalg import DenseMatrix

        return DenseMatrix(*self.weights.shape, self.weights.ravel(order="F").tolist())

    def transform(self, rows: DataFrame) -> DataFrame:
        kept = rows.columns
        scored = rows.withColumn("scores__", _products(self.weights, self.intercepts)(vector_to_array("features")))
        if len(self.weights) == 1:
            said = F.when(F.col("scores__")[0] > 0, 1.0).otherwise(0.0)
        else:
            said = (F.array_position("scores__", F.array_max("scores__")) - 1).cast("double")  # the first of equal ones
        return scored.select(*kept, said.alias("prediction"))


class Ridge:
    """Least squares on -1 and 1 with alpha times the squared weights, one against the rest beyond two classes; the intercept is free."""

    def __init__(self, alpha: float = 1.0, n_classes: int = 2) -> None:
        self.alpha, self.n_classes = alpha, n_classes

    def fit(self, rows: DataFrame) -> RidgeModel:
        n = max(1, rows.count())
        one = LinearRegression(regParam=self.alpha / n, elasticNetParam=0.0, standardization=False, solver="normal", labelCol="target")
        fitted = [one.fit(rows.withColumn("target", F.when(F.col("label") == k, 1.0).otherwise(-1.0))) for k in ([1] if self.n_classes <= 2 else range(self.n_classes))]
        return RidgeModel(np.array([m.coefficients.toArray() for m in fitted]), np.array([m.intercept for m in fitted]))


class KernelModel:
    def __init__(self, model, waves: np.ndarray, shifts: np.ndarray) -> None:
        self.model, self.waves, self.shifts = model, waves, shifts

    def transform(self, rows: DataFrame) -> DataFrame:
        kept = rows.columns
        return self.model.transform(_mapped(rows, self.waves, self.shifts)).select(*kept, "prediction")


def _mapped(rows: DataFrame, waves: np.ndarray, shifts: np.ndarray) -> DataFrame:
    return rows.withColumn("waves", array_to_vector(_products(waves, shifts, True)(vector_to_array("features"))))


class KernelSVM:
    """A linear machine over `size` random Fourier features, whose products approach the radial kernel of width 1 / (features x variance)."""

    def __init__(self, c: float = 1.0, n_classes: int = 2, size: int = 96, seed: int = 42) -> None:
        self.c, self.n_classes, self.size, self.seed = c, n_classes, size, seed

    def fit(self, rows: DataFrame) -> KernelModel:
        cells = rows.select(F.explode(vector_to_array("features")).alias("x")).agg(F.var_pop("x").alias("v"), F.count("*").alias("cells")).first()
        n = max(1, rows.count())
        width = cells["cells"] // n
        rng = np.random.default_rng(self.seed)
        gamma = 1.0 / (max(1, width) * (cells["v"] or 1.0))
        waves, shifts = rng.normal(0, np.sqrt(2 * gamma), (self.size, width)), rng.uniform(0, 2 * np.pi, self.size)
        one = C.LinearSVC(maxIter=50, regParam=1.0 / (n * self.c), featuresCol="waves")
        machine = one if self.n_classes <= 2 else C.OneVsRest(classifier=one, featuresCol="waves")
        mapped = _mapped(rows, waves, shifts).select("waves", "label").persist()
        try:
            return KernelModel(machine.fit(mapped), waves, shifts)
        finally:
            mapped.unpersist()
