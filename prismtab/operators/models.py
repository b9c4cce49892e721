"""Models: automatic training, comparison of kinds, tuning, importances, and SHAP values of boosted trees."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Model
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtab.functions.columns import normalise, numeric_columns
from prismtab.functions.store import cut
from prismtab.operators.boosting import ManyClasses
from prismtab.operators.classifiers import KernelSVM, Ridge
from prismtab.operators.clean import fill_values

MISSING = "__missing__"
METRICS = ("accuracy", "precision", "recall", "f1")
MODELS = ("random_forest", "gradient_boosting", "logistic_regression", "ridge", "svm")
#: The combinations that tuning tries.
GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10, 20]},
    "gradient_boosting": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [200]},
    "ridge": {"alpha": [0.1, 1.0, 10.0]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"]},
}


#: The greatest depth of Spark's trees, and classes at most.
DEEPEST, CLASSES = 30, 10_000


def task_type(df: DataFrame, target: str) -> str:
    """classification for text and for few distinct numbers (20 at most, or under 5 % of the rows), else regression."""
    if target not in numeric_columns(df):
        return "classification"
    r = df.agg(F.count("*").alias("n"), F.count_distinct(target).alias("d")).first()
    return "classification" if r["d"] <= 20 or r["d"] / max(r["n"], 1) < 0.05 else "regression"


def codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: 0, 1, ... in the order of the values as text; a row for each category."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("double"))


def prepared(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """df with numeric features instead of the others, and their names: text becomes codes, missing numbers the median."""
    df = normalise(df)
    names = [c for c in df.columns if c != target]
    numeric = set(numeric_columns(df))
    fills = fill_values(df.select(*[c for c in names if c in numeric])) if numeric - {target} else {}
    out = df
    for c in names:
        if c in numeric:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), fills.get(c, F.lit(0.0)).cast("double")))
        elif isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = out.withColumn(c, F.coalesce(F.unix_micros(F.col(c).cast("timestamp")) / 1e6, F.lit(0.0)))
        else:
            m = codes(df, c).withColumnsRenamed({"value": "v__", "code": "c__"})
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
            out = out.join(F.broadcast(m) if m.limit(10_001).count() <= 10_000 else m, F.col(c) == F.col("v__"), "left").withColumn(c, F.col("c__")).drop("v__", "c__")
    return out, names


def split(df: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, dealt at random row by row: equal rows may fall on either side. A lost task deals its partition's rows alike again."""
    fit_on, held = df.randomSplit([1 - share, share], seed)
    return fit_on, held


def build(name: str, params: dict | None = None, seed: int = 42, n_classes: int = 2, n_rows: int = 100):
    """An unfitted estimator; ValueError for an unknown name or kernel. Boosted trees and the margin classifiers are one-vs-rest beyond two classes.

    n_rows is the number of rows that it will be fitted on, as C weighs the rows' sum and Spark takes their mean.
    A forest without a depth grows to DEEPEST, the most that Spark has; a greater depth is a ValueError.
    """
    p = params or {}
    if name == "random_forest":
        depth = p.get("max_depth") or DEEPEST
        if depth > DEEPEST:
            raise ValueError(f"trees are {DEEPEST} deep at most")
        return C.RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=depth, seed=seed)
    if name == "gradient_boosting":
        one = C.GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), maxDepth=p.get("max_depth", 3), seed=seed)
        return one if n_classes <= 2 else C.OneVsRest(classifier=one)
    if name == "logistic_regression":
        return C.LogisticRegression(maxIter=p.get("max_iter", 200), regParam=1.0 / (max(1, n_rows) * p.get("C", 1.0)))
    if name == "ridge":
        return Ridge(p.get("alpha", 1.0), n_classes)
    if name == "svm":
        if p.get("kernel", "rbf") == "rbf":
            return KernelSVM(p.get("C", 1.0), n_classes, seed=seed)
        if p["kernel"] != "linear":
            raise ValueError(f"unknown kernel {p['kernel']!r}")
        one = C.LinearSVC(maxIter=50, regParam=1.0 / (max(1, n_rows) * p.get("C", 1.0)))
        return one if n_classes <= 2 else C.OneVsRest(classifier=one)
    raise ValueError(f"unknown model {name!r}")


def class_metrics(predictions: DataFrame, label: str = "label", predicted: str = "prediction") -> dict[str, float]:
    """accuracy, and precision, recall and F1 of each class weighted by its rows; a share of nothing is 0."""
    r = predictions.groupBy(F.col(label).cast("double").alias("l"), F.col(predicted).cast("double").alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each pair of classes
    n = sum(x["n"] for x in r) or 1
    hits, reals, saids = {x["l"]: x["n"] for x in r if x["l"] == x["p"]}, Counter(), Counter()
    for x in r:
        reals[x["l"]] += x["n"]
        saids[x["p"]] += x["n"]
    out = {"accuracy": sum(hits.values()) / n, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for k, real in reals.items():
        hit, said = hits.get(k, 0), saids[k]
        precision, recall = hit / said if said else 0.0, hit / real
        out["precision"] += precision * real / n
        out["recall"] += recall * real / n
        out["f1"] += (2 * precision * recall / (precision + recall) if precision + recall else 0.0) * real / n
    return out


def regression_metrics(predictions: DataFrame, label: str = "label", predicted: str = "prediction") -> dict[str, float]:
    """r2, mae, rmse."""
    e = F.col(label) - F.col(predicted)
    r = predictions.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(label).alias("v")).first()
    return {"r2": 1 - r["mse"] / r["v"] if r["v"] else 0.0, "mae": r["mae"] or 0.0, "rmse": (r["mse"] or 0.0) ** 0.5}


def importances(model: Model, names: list[str]) -> dict[str, float]:
    """Of trees, their importances; of linear models, mean absolute coefficients; of one-vs-rest, their mean; else 0. 6 places."""
    if hasattr(model, "models"):
        each = [importances(m, names) for m in model.models]
        return {n: round(sum(e[n] for e in each) / len(each), 6) for n in names}
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        v = np.abs(model.coefficientMatrix.toArray()).mean(0)
    elif hasattr(model, "coefficients"):
        v = np.abs(model.coefficients.toArray())
    else:
        v = np.zeros(len(names))
    return {n: round(float(x), 6) for n, x in zip(names, v, strict=True)}


def _assembled(df: DataFrame, names: list[str], label: Column) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.withColumn("label", label)).select("features", "label")


def train(df: DataFrame, target: str, test_share: float = 0.2, seed: int = 42) -> dict:
    """Boosted trees (100 of depth 4) for the target: task, metrics (4 places) on held-out rows, importances (sorted), model, features, labels.

    ValueError if there is no such column, or more than CLASSES classes. Codes and medians are of all rows, held-out ones included, before the split.
    """
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    task = task_type(df, target)
    rows = df.filter(F.col(target).isNotNull()) if task == "regression" else df
    x, names = prepared(rows, target)
    classes: list[str] = []
    if task == "classification":
        m = codes(rows, target)
        classes = [r["value"] for r in m.orderBy("code").limit(CLASSES + 1).collect()]
        if len(classes) > CLASSES:
            raise ValueError(f"{target!r} has more than {CLASSES} classes")
        known = m.withColumnsRenamed({"value": "l__", "code": "k__"})
        x = x.join(F.broadcast(known), F.coalesce(F.col(target).cast("string"), F.lit(MISSING)) == F.col("l__"))
        data = _assembled(x, names, F.col("k__"))
        estimator = C.GBTClassifier(maxIter=100, maxDepth=4, seed=seed) if len(classes) <= 2 else ManyClasses(100, 4, seed=seed)
    else:
        data = _assembled(x, names, F.col(target).cast("double"))
        estimator = R.GBTRegressor(maxIter=100, maxDepth=4, seed=seed)
    fit_on, held = split(data.withColumn("f__", vector_to_array("features")), test_share, seed)
    model = estimator.fit(fit_on.drop("f__").cache())
    predictions = model.transform(held.drop("f__"))
    if task == "classification":
        m = class_metrics(predictions)
        metrics = {"accuracy": m["accuracy"], "f1_weighted": m["f1"]}
    else:
        metrics = regression_metrics(predictions)
    ranked = dict(sorted(importances(model, names).items(), key=lambda i: -i[1]))
    return {"task": task, "metrics": {k: round(v, 4) for k, v in metrics.items()}, "importances": ranked, "model": model, "features": names, "labels": classes, "predictions": predictions}


def train_single(data: DataFrame, names: list[str], model: str, params: dict | None = None, test_share: float = 0.2, seed: int = 42) -> dict:
    """One kind of classifier on rows (names, label): metrics (6 places), importances and milliseconds to fit."""
    assembled = _assembled(data, names, F.col("label").cast("double"))
    fit_on, held = split(assembled.withColumn("f__", vector_to_array("features")), test_share, seed)
    n_classes = assembled.select("label").distinct().count()
    n_rows = fit_on.count()
    began = time.time()
    fitted = build(model, params, seed, n_classes, n_rows).fit(fit_on.drop("f__"))
    ms = (time.time() - began) * 1000
    metrics = class_metrics(fitted.transform(held.drop("f__")))
    return {"model": model, "metrics": {k: round(v, 6) for k, v in metrics.items()}, "importances": importances(fitted, names), "fit_ms": ms, "fitted": fitted}


def compare_models(data: DataFrame, names: list[str], models: tuple[str, ...] = MODELS, metric: str = "f1", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(model, metrics, best by metric) and (feature, importance: the mean over models), best first. ValueError for an unknown metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    results = [train_single(data, names, m, seed=seed) for m in models]
    best = max(range(len(results)), key=lambda i: (results[i]["metrics"][metric], -i))
    spark = data.sparkSession
    rows = [(r["model"], *[r["metrics"][m] for m in METRICS], round(r["fit_ms"], 3), i == best) for i, r in enumerate(results)]
    ranks = sorted(((n, round(sum(r["importances"][n] for r in results) / len(results), 6)) for n in names), key=lambda x: (-x[1], x[0]))
    return (
        spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, fit_ms double, best boolean"),
        spark.createDataFrame([(i + 1, *r) for i, r in enumerate(ranks)], "rank int, feature string, importance double"),
    )


def _cross_validated(folds: list[DataFrame], model: str, params: dict, metric: str, seed: int, n_classes: int) -> float:
    """The mean metric over the folds; 0 where the rest can't be fitted, as with rows of one class."""
    scores = []
    for k, held in enumerate(folds):
        rest = reduce(DataFrame.union, folds[:k] + folds[k + 1 :])
        try:
            fitted = build(model, params, seed, n_classes, rest.count()).fit(rest)
        except (ValueError, IllegalArgumentException):  # a combination that can't be fitted ranks last; a lost executor is no such case
            scores.append(0.0)
            continue
        scores.append(class_metrics(fitted.transform(held))[metric])
    return sum(scores) / len(scores)


def _search(data: DataFrame, names: list[str], model: str, combos: list[dict], cv: int, metric: str, seed: int) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    assembled = cut(_assembled(data, names, F.col("label").cast("double")))
    # Dealt row by row; arrays beside the vectors, as rows are sorted before they are dealt and vectors have no order.
    folds = [f.drop("f__") for f in assembled.withColumn("f__", vector_to_array("features")).randomSplit([1.0] * cv, seed)]
    n_classes = assembled.select("label").distinct().count()
    scored = [(round(_cross_validated(folds, model, c, metric, seed, n_classes), 6), i, c) for i, c in enumerate(combos)]
    ranked = sorted(scored, key=lambda x: (-x[0], x[1]))
    rows = [(model, r + 1, {k: str(v) for k, v in c.items()}, s, len(combos)) for r, (s, _, c) in enumerate(ranked)]
    return data.sparkSession.createDataFrame(rows, "model string, rank int, params map<string,string>, score double, total_combinations int")


def combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]


def grid_search(data: DataFrame, names: list[str], model: str, grid: dict[str, list] | None = None, cv: int = 3, metric: str = "accuracy", seed: int = 42) -> DataFrame:
    """model, rank, params, score, total_combinations, for every combination of the grid."""
    build(model)
    return _search(data, names, model, combinations(grid or GRIDS[model]), cv, metric, seed)


def random_search(data: DataFrame, names: list[str], model: str, grid: dict[str, list] | None = None, n_iter: int = 10, cv: int = 3, metric: str = "accuracy", seed: int = 42) -> DataFrame:
    """As grid_search, for n_iter different combinations, or all if there are fewer."""
    build(model)
    combos = combinations(grid or GRIDS[model])
    return _search(data, names, model, random.Random(seed).sample(combos, min(n_iter, len(combos))), cv, metric, seed)


def auto_tune(data: DataFrame, names: list[str], models: tuple[str, ...] = MODELS, method: str = "grid", cv: int = 3, metric: str = "accuracy", **more) -> DataFrame:
    """The searches of all models, one under another."""
    if method not in ("grid", "random"):
        raise ValueError(f"unknown method {method!r}")
    search = grid_search if method == "grid" else random_search
    out = None
    for m in models:
        got = search(data, names, m, cv=cv, metric=metric, **more)
        out = got if out is None else out.unionByName(got)
    return out


def tree_shap(model: Model, rows: DataFrame, names: list[str]) -> DataFrame:
    """features and shap, an array with each feature's Shapley value of the boosted trees' raw sum, by exact path-dependent TreeSHAP.

    The trees are read from the fitted model on the driver; rows are explained where they are.
    """
    trees, weights = [], list(model.treeWeights)
    for t in model.trees:
        trees.append(_tree_arrays(t))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(len(batch), len(names))
            out = np.zeros((len(batch), len(names)))
            for w, t in zip(weights, trees, strict=True):
                _shap(t, x, out, w)
            yield pa.record_batch([batch.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], ["features", "shap"])

    return rows.select(vector_to_array("features").alias("features")).mapInArrow(work, "features array<double>, shap array<double>")


def _tree_arrays(tree) -> dict:
    """A fitted tree's nodes: feature (-1 for leaves), threshold, children, value, rows."""
    out = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "cover": []}

    def visit(node) -> int:
        me = len(out["feature"])
        for k in out:
            out[k].append(-1)
        out["value"][me] = node.prediction()
        out["cover"][me] = float(node.impurityStats().count())
        if node.subtreeDepth() > 0:
            s = node.split()
            out["feature"][me] = s.featureIndex()
            out["threshold"][me] = s.threshold() if hasattr(s, "threshold") else 0.0
            out["left"][me], out["right"][me] = visit(node.leftChild()), visit(node.rightChild())
        return me

    visit(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"))
    return out


def _shap(tree: dict, x: np.ndarray, out: np.ndarray, weight: float) -> None:
    """Adds the tree's Shapley values of all rows of x to out.

    Leaf by leaf: along the path to a leaf each feature has the share of training rows that follow it (z) and, for each row of x, whether
    that row does (o, 0 or 1). A leaf gives a feature its value times o - z, times the mean over the orders of the
    other features on the path of the products of their o (those before it) and z (those after it), which are the
    coefficients of a polynomial with a factor z + o t for each.
    """

    def leaf(value: float, path: dict[int, tuple[float, np.ndarray]]) -> None:
        m = len(path)
        for f, (z_f, o_f) in path.items():
            poly = [np.ones(len(x))]
            for g, (z, o) in path.items():
                if g != f:
                    poly = [(poly[k] * z if k < len(poly) else 0) + (poly[k - 1] * o if k else 0) for k in range(len(poly) + 1)]
            share = sum(c * (math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)) for k, c in enumerate(poly))
            out[:, f] += weight * value * (o_f - z_f) * share

    def visit(node: int, path: dict[int, tuple[float, np.ndarray]]) -> None:
        f = tree["feature"][node]
        if f < 0:
            leaf(tree["value"][node], path)
            return
        left = x[:, f] <= tree["threshold"][node]
        for child, follows in ((tree["left"][node], left), (tree["right"][node], ~left)):
            z, o = path.get(f, (1.0, np.ones(len(x))))
            visit(child, {**path, f: (z * tree["cover"][child] / tree["cover"][node], o * follows)})

    visit(0, {})
