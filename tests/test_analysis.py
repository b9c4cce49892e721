"""Anomalies, features, forecasts, tests, regression, clusters, components, models, streams."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtab.functions import distributions as d
from prismtab.functions import mutual_info
from prismtab.functions.neighbours import with_previous
from prismtab.functions.ranks import average_ranks
from prismtab.operators import anomaly, cluster, features, forecast, models, outliers, reduce, regression, stats
from prismtab.sources import synthetic
from prismtab.streaming import monitors


def test_distributions():
    assert d.t_two_sided(2.0, 10) == pytest.approx(0.07338803)
    assert d.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert d.f_sf(4.0, 2, 10) == pytest.approx(0.05289, abs=1e-4)
    assert d.normal_ppf(0.975) == pytest.approx(1.959963985)


def test_univariate_anomalies(spark):
    v = [10.0, 11.0, 10.0, 12.0, 10.0, 11.0, 10.0, 100.0, math.nan, math.inf, None]
    df = spark.createDataFrame([(i, x, 5.0) for i, x in enumerate(v)], "i int, x double, c double")
    got = anomaly.detect_all(df, "i", ["x", "c"], 2.0).collect()
    assert [(r["row_id"], r["column"], r["direction"]) for r in got] == [(7, "x", "high")]
    s = anomaly.summary(anomaly.detect_all(df, "i", ["x"], 2.0)).first()
    assert (s["total_anomalies"], s["columns_affected"], s["per_column"], s["top_row"]) == (1, 1, {"x": 1}, 7)


def test_row_anomalies(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(0, 20.0, 20.0)] + [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(1, 100)] + [(100, None, 1.0)], "i int, a double, b double")
    for name in outliers.METHODS:
        rows = {r["row_id"]: r for r in outliers.METHODS[name](df, "i", ["a", "b"]).collect()}
        assert rows[0]["anomaly"] and rows[0]["score"] == 1.0 and len(rows) == 100 and all(0 <= r["score"] <= 1 for r in rows.values())
    e = {r["row_id"]: r["anomaly"] for r in outliers.ensemble(df, "i", ["a", "b"]).collect()}
    assert e[0] and sum(e.values()) < 40
    with pytest.raises(ValueError):
        outliers.run(df, "i", ["a"], ["none"])


def test_features(spark):
    df = spark.createDataFrame([(1.0, 4.0, "S"), (2.0, 5.0, "M"), (3.0, 6.0, None)], "a double, b double, s string")
    assert [r["a_scaled"] for r in features.scale(df, ["a"], "minmax").orderBy("a").collect()] == [0.0, 0.5, 1.0]
    assert features.scale(df.withColumn("a", F.lit(1.0)), ["a"]).first()["a_scaled"] == 0.0
    hot = features.onehot(df, ["s"])
    assert hot.columns == ["a", "b", "s_M", "s_S"] and [tuple(r)[2:] for r in hot.orderBy("a").collect()] == [(0, 1), (1, 0), (0, 0)]
    assert [r["s_ordinal"] for r in features.ordinal(df, "s", ["S", "L"]).orderBy("a").collect()] == [0, None, None]
    p = features.polynomial(df, ["a", "b"], 3).orderBy("a").collect()[1]
    assert (p["a_pow2"], p["a_pow3"], p["a_x_b"]) == (4.0, 8.0, 10.0)
    enc = spark.createDataFrame([("X", 10), ("X", 20), ("Y", 30), ("Y", 40), (None, 50)], "c string, y long")
    assert sorted(r["c_target_encoded"] for r in features.target_encode(enc, "c", "y").collect()) == [15.0, 15.0, 30.0, 35.0, 35.0]
    binned = features.bin_numeric(spark.range(0, 11).select(F.col("id").cast("double").alias("x")), "x", 5).orderBy("x").collect()
    assert [r["x_binned"] for r in binned] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    parts = features.time_parts(spark.createDataFrame([("2023-01-07",), ("2023-04-03",)], "t string"), "t").orderBy("t").collect()
    assert [(r["t_is_weekend"], r["t_quarter"], r["t_day_of_week"]) for r in parts] == [(1, 1, 5), (0, 2, 0)] and "t_hour" not in parts[0]


def test_selection(spark):
    rng = random.Random(3)
    data = [(1.0, x := rng.gauss(0, 1), 2 * x, rng.gauss(0, 1), 3 * x) for _ in range(200)]
    df = spark.createDataFrame(data, "k double, a double, copy double, other double, y double")
    pick = lambda m, t: {r["feature"]: r["selected"] for r in features.select_features(df, "y", m, t).collect()}
    assert pick("variance", 0.01) == {"k": False, "a": True, "copy": True, "other": True}
    assert pick("correlation", 0.9) == {"k": True, "a": True, "copy": False, "other": True}
    mi = {r["feature"]: r["score"] for r in features.select_features(df, "y", "mutual_info").collect()}
    assert mi["a"] > 1 > 0.3 > mi["other"]


def series(spark, **named):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in named.items()], "series string, xs array<double>")


def test_forecasts(spark):
    f = {r["series"]: r for r in forecast.forecasts(series(spark, line=[10, 20, 30, 40, 50], flat=[42] * 10, one=[5], none=[]), 3).collect()}
    assert f["line"]["linear_trend"]["predictions"] == [60.0, 70.0, 80.0]
    assert f["flat"]["moving_average"]["predictions"] == [42.0] * 3 and f["flat"]["ensemble"]["errors"]["mae"] == 0
    assert f["one"]["ensemble"]["predictions"] == [5.0] * 3 and f["none"]["ensemble"]["predictions"] == [0.0] * 3
    s, errors = 10.0, []
    for x in (20.0, 30, 40, 50):
        errors.append(abs(x - s))
        s = 0.3 * x + 0.7 * s
    assert f["line"]["exponential_smoothing"]["predictions"][0] == pytest.approx(s) and f["line"]["exponential_smoothing"]["errors"]["mae"] == pytest.approx(sum(errors) / 4)


def test_decomposition_adds_up(spark):
    xs = [i + (i % 4) * 2.0 for i in range(40)]
    rows = forecast.decompose(series(spark, s=xs), 4).orderBy("t").collect()
    assert all(r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(x, abs=1e-5) for r, x in zip(rows, xs, strict=True))
    assert {r["trend"] for r in forecast.decompose(series(spark, s=[1, 2]), 4).collect()} == {0.0}


def test_multistep_and_folds(spark):
    df = series(spark, s=range(1, 21), short=[1, 2, 3])
    assert [r["prediction"] for r in forecast.multistep(df, 2, "linear_trend").filter("series = 's'").orderBy("step").collect()] == [21.0, 22.0]
    cv = {r["series"]: r for r in forecast.cross_validate(df).collect()}
    assert len(cv["s"]["scores"]) == 3 and cv["short"]["scores"] == []
    with pytest.raises(ValueError):
        forecast.multistep(df, 1, "none")
    c = forecast.with_confidence(df, 1, 0.99).filter("series = 's'").first()
    assert c["lower"] < c["prediction"] < c["upper"]


def test_means(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (2, 4, 6, 8, 10)], "g string, v double")
    w = stats.welch(df, "g", "v", "a", "b")
    assert w.statistic == pytest.approx(-1.8974, abs=1e-4) and w.p_value == pytest.approx(0.10754, abs=1e-4)
    m = stats.mann_whitney(df.filter("v <> 10"), "g", "v", "a", "b")
    assert 0 < m.p_value < 1
    a = stats.anova(df, "g", "v")
    assert a.statistic == pytest.approx(w.statistic**2)


def test_exact_ranks():
    import itertools

    for n1, n2 in ((2, 3), (4, 4)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 // 2 + 1, n1 * n2 + 1):
            assert stats._exact_ranks(u, n1, n2) == pytest.approx(min(1, 2 * sum(x >= u for x in us) / len(us)))


def test_tables_and_correlation(spark):
    r = stats.chi_square_counts([[50, 5], [5, 50]])
    assert r.statistic == pytest.approx(70.4, abs=0.01) and r.significant and not stats.chi_square_counts([[25, 25], [25, 25]]).significant
    df = spark.createDataFrame([(float(x), float(x**3)) for x in range(1, 11)], "x double, y double")
    assert stats.correlation(df, "x", "y", "spearman").statistic == pytest.approx(1.0)
    assert stats.paired(df, "y", "x").effect_size < 0 < stats.paired(df, "y", "x").statistic


def test_normality():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    w, p = stats.shapiro_wilk(x)
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)
    assert stats.shapiro_wilk(np.random.default_rng(1).standard_normal(500))[1] > 0.05


def test_ranks_and_neighbours(spark):
    values = [random.Random(2).randrange(50) for _ in range(300)]
    got = {(r["i"], r["rank"]) for r in average_ranks(spark.createDataFrame(list(enumerate(map(float, values))), "i int, v double"), "v").collect()}
    ordered = sorted(values)
    assert got == {(i, (ordered.index(v) + 1 + ordered.index(v) + ordered.count(v)) / 2) for i, v in enumerate(values)}
    prev = {r["o"]: r["previous"] for r in with_previous(spark.range(100).select((F.col("id") * 3).alias("o"), F.col("id").cast("double").alias("v")), "o", "v").collect()}
    assert prev[0] is None and all(prev[3 * i] == i - 1 for i in range(1, 100))


def test_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 2))
    y = 3 * x[:, 0] + 1.5 * x[:, 1] + 0.1 * rng.standard_normal(120) + 7
    x[0], y[0] = (8, 8), -50
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, y double")
    fit = regression.ols(df, ["a", "b"], "y")
    full = np.column_stack([np.ones(120), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [fit.intercept, *fit.coefficients] == pytest.approx(list(want))
    hat = np.diag(full @ np.linalg.inv(full.T @ full) @ full.T)
    rows = {r["row_id"]: r for r in regression.influence(df, ["a", "b"], "y", "i").collect()}
    assert [rows[i]["leverage"] for i in range(120)] == pytest.approx(list(hat)) and max(rows, key=lambda i: rows[i]["cooks_distance"]) == 0
    e = y - full @ want
    res, _ = regression.with_residuals(df, ["a", "b"], "y")
    assert regression.durbin_watson(res, "i") == pytest.approx(float((np.diff(e) ** 2).sum() / (e**2).sum()))
    out = regression.diagnose(df, ["a", "b"], "y", "i").first()
    assert "some rows are influential" in out["warnings"]


def test_vif(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal(100)
    df = spark.createDataFrame([(float(x), float(x + 0.01 * e), 1.0) for x, e in zip(a, rng.standard_normal(100), strict=True)], "a double, b double, c double")
    assert regression.vif(df, ["a"]).first()["vif"] == 1.0
    assert all(r["high"] for r in regression.vif(df, ["a", "b"]).collect())
    assert {r["feature"]: math.isinf(r["vif"]) for r in regression.vif(df, ["a", "c"], "advanced").collect()} == {"a": False, "c": True}


def blobs(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate([(float(i), 0.0) for i in range(10)] + [(float(i), 100.0) for i in range(10)] + [(100.0 + i, 50.0) for i in range(10)])], "i int, x double, y double")


def test_clusters(spark):
    df = blobs(spark)
    labels, inertia = cluster.kmeans(df, "i", ["x", "y"], 3)
    got = {r["row_id"]: r["label"] for r in labels.collect()}
    assert len({got[i] for i in range(10)}) == 1 and len(set(got.values())) == 3 and inertia > 0
    db = {r["row_id"]: r["label"] for r in cluster.dbscan(df, "i", ["x", "y"], 0.5, 3).collect()}
    assert [db[0], db[10], db[20]] == [0, 1, 2]
    h = {r["row_id"]: r["label"] for r in cluster.hierarchical(df, "i", ["x", "y"], 3).collect()}
    assert [h[0], h[10], h[20]] == [0, 1, 2]
    marked = df.withColumn("row_id", F.col("i")).withColumn("label", F.floor(F.col("i") / 10).cast("int"))
    e = cluster.evaluate(marked, ["x", "y"]).first()
    assert e["n_clusters"] == 3 and e["silhouette"] > 0.8
    assert cluster.silhouette(marked.withColumn("label", F.lit(0)), ["x", "y"]) == -1.0
    noise = cluster.dbscan(spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 0.2), (3, 50.0)], "i int, x double"), "i", ["x"], 0.2, 3, scale=False).collect()
    assert {r["row_id"]: r["label"] for r in noise} == {0: 0, 1: 0, 2: 0, 3: -1}


def test_agglomeration_equals_definition():
    rng = np.random.default_rng(8)
    data = rng.standard_normal((30, 2))
    for linkage in ("single", "complete", "average"):
        groups = [[i] for i in range(30)]
        dist = lambda a, b: {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[linkage]([float(np.linalg.norm(data[i] - data[j])) for i in a for j in b])  # noqa: B023, E731
        while len(groups) > 4:
            a, b = min(((a, b) for k, a in enumerate(groups) for b in groups[k + 1 :]), key=lambda p: dist(*p))
            groups.remove(b)
            a += b
        got = cluster.agglomerate(data, 4, linkage)
        assert {frozenset(g) for g in groups} == {frozenset(i for i in range(30) if got[i] == k) for k in set(got)}


def test_components(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((50, 2))
    x = np.column_stack([base, base @ rng.standard_normal((2, 3)) + 0.01 * rng.standard_normal((50, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double, e double")
    cols = list("abcde")
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.svd(z, compute_uv=False) ** 2 / 49
    s = reduce.scree(df, cols).collect()
    assert [r["eigenvalue"] for r in s] == pytest.approx(list(values), abs=1e-5) and s[-1]["cumulative"] == pytest.approx(1)
    r = reduce.Reducer()
    with pytest.raises(RuntimeError):
        r.transform_new(df, "i")
    assert r.auto_pca(df, "i", cols, 0.95).columns == ["row_id", "pc1", "pc2"]
    assert r.transform_new(df, "i").count() == 50 and reduce.tsne(df, "i", cols).count() == 50


def test_models(spark):
    data = synthetic.classification(spark, 200, 3, 2)
    names = ["f0", "f1", "f2"]
    assert models.task_type(data, "label") == "classification"
    got = models.train_single(data, names, "logistic_regression")
    assert got["metrics"]["accuracy"] > 0.7 and got["importances"]["f0"] > got["importances"]["f2"]
    assert models.grid_search(data, names, "ridge", cv=2).first()["total_combinations"] == 3
    with pytest.raises(ValueError):
        models.build("none")
    with pytest.raises(ValueError):
        models.train(data, "none")
    assert [len(models.combinations(g)) for g in models.GRIDS.values()] == [12, 12, 4, 3, 6]


def _points(spark, xs, ys):
    from pyspark.ml.linalg import Vectors

    return spark.createDataFrame([(Vectors.dense(*map(float, x)), float(y)) for x, y in zip(xs, ys, strict=True)], ["features", "label"])


def test_ridge_is_penalised_least_squares(spark):
    from prismtab.operators.classifiers import Ridge

    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3)) * [1, 5, 0.2]
    y = (x @ [1, -0.3, 2] + rng.normal(size=150) > 0).astype(int)
    for alpha in (0.1, 10.0):
        m = Ridge(alpha).fit(_points(spark, x, y))
        centered, t = x - x.mean(0), 2.0 * y - 1
        want = np.linalg.solve(centered.T @ centered + alpha * np.eye(3), centered.T @ (t - t.mean()))
        assert m.weights[0] == pytest.approx(want, rel=1e-4, abs=1e-6)
    three = np.array([0, 1, 2] * 50)
    moved = rng.normal(size=(150, 2)) + np.array([[0, 0], [5, 0], [0, 5]])[three]
    got = Ridge(1.0, 3).fit(_points(spark, moved, three)).transform(_points(spark, moved, three))
    assert got.filter("prediction = label").count() > 140


def test_radial_kernel_parts_a_disc_from_what_is_around_it(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (400, 2))
    y = (np.hypot(*x.T) < 1.2).astype(int)
    rows = _points(spark, x, y)
    right = {k: models.build("svm", {"kernel": k}, n_rows=400).fit(rows).transform(rows).filter("prediction = label").count() / 400 for k in ("rbf", "linear")}
    assert right["rbf"] > 0.9 > 0.8 > right["linear"]
    with pytest.raises(ValueError):
        models.build("svm", {"kernel": "poly"})
    with pytest.raises(ValueError):
        models.build("random_forest", {"max_depth": 31})


def test_split_parts_equal_rows(spark):
    fit_on, held = models.split(_points(spark, [[1.0, 2.0]] * 500, [1] * 500))
    assert 60 < held.count() < 140 and fit_on.count() + held.count() == 500


def test_a_lost_executor_is_no_bad_score(spark, monkeypatch):
    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(models, "build", lost)
    with pytest.raises(RuntimeError):
        models._search(synthetic.classification(spark, 60, 3, 2), ["f0", "f1", "f2"], "ridge", [{}], 2, "accuracy", 1)


def test_shap_adds_up(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 3), float(i % 5) * 2 + (i % 3)) for i in range(120)], "a double, b double, y double")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = GBTRegressor(labelCol="y", maxIter=3, maxDepth=2, seed=1).fit(rows)
    got = models.tree_shap(model, rows.limit(10), ["a", "b"]).collect()
    said = {tuple(r["features"].toArray()): r["prediction"] for r in model.transform(rows).collect()}
    gaps = [said[tuple(r["features"])] - sum(r["shap"]) for r in got]
    assert max(gaps) - min(gaps) < 1e-6


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"2024-01-01 {i % 5:02d}:10:00", float(i)) for i in range(50)], "i int, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(src)
    w = monitors.windowed(spark.readStream.schema(df.schema).parquet(src), "t", "v")
    q = w.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", out).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 50 and spark.table("windows").count() == 5
    assert monitors.flag_anomalies(df, "v", 1.0, 47.0).count() == 3


def brute_nearest(data, k, largest=False):
    gap = np.abs(data[:, None, :] - data[None, :, :])
    dist = gap.max(2) if largest else np.sqrt((gap * gap).sum(2))
    np.fill_diagonal(dist, np.inf)
    return dist, np.argsort(dist, axis=1, kind="stable")[:, :k]


def test_nearest_equal_brute_force_across_leaves(spark):
    from prismtab.functions.nearest import k_nearest

    rng = np.random.default_rng(11)
    data = np.concatenate([rng.integers(0, 9, (300, 2)).astype(float), rng.standard_normal((150, 2)) * 40, np.ones((60, 2))])  # ties, far rows, copies
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "row_id int, a double, b double")
    for largest in (False, True):
        dist, best = brute_nearest(data, 6, largest)
        got = {}
        for r in k_nearest(df, ["a", "b"], 6, largest, leaf=16).collect():
            got.setdefault(r["x"], []).append((r["dist"], r["y"]))
        assert {i: sorted(v) for i, v in got.items()} == {i: [(dist[i, j], j) for j in best[i]] for i in range(len(data))}


def part_table(spark, folder, n):
    spark.range(1, n + 1).selectExpr("id as p_partkey", "cast(id * 7919 % 50 + 1 as int) as p_size", "900 + 1000 * pmod(sin(id) * 10000, 1D) as p_retailprice").write.parquet(f"{folder}/part.parquet")


def test_row_anomaly_queries_take_all_parts(spark, tmp_path):
    from prismtab.plans import analysis

    part_table(spark, tmp_path, 1500)
    ids = list(range(1, 1501))
    for name, times in (("lof", 1), ("anomaly_compare", 3), ("ensemble_vote", 1)):
        assert sorted(r["row_id"] for r in analysis.C.queries[name](spark, str(tmp_path)).collect()) == sorted(ids * times)
    p = spark.read.parquet(f"{tmp_path}/part.parquet").orderBy("p_partkey").select("p_size", "p_retailprice").collect()
    data = np.array([list(r) for r in p], float)
    dist, best = brute_nearest((data - data.mean(0)) / data.std(0), 20)
    near = np.take_along_axis(dist, best, 1)
    lrd = 1 / (np.maximum(near, near[:, -1][best]).mean(1) + 1e-10)
    got = {r["row_id"]: r["context"]["lof"] for r in analysis.C.queries["anomaly_compare"](spark, str(tmp_path)).filter("method = 'local_outlier_factor'").collect()}
    assert [got[i] for i in ids] == pytest.approx(list(lrd[best].mean(1) / lrd), abs=2e-6)


def test_local_outlier_factor_beyond_20000_rows(spark):
    df = spark.range(20_100).selectExpr("id", "cast(id % 150 as double) as a", "cast(id div 150 as double) as b")
    got = outliers.local_outlier_factor(df, "id", ["a", "b"]).agg(F.count("*"), F.count_distinct("row_id")).first()
    assert tuple(got) == (20_100, 20_100)


def test_tsne_places_every_row_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(reduce, "TSNE_ROWS", 120)
    rng = np.random.default_rng(12)
    data = np.concatenate([rng.standard_normal((150, 3)) + c for c in (0, 30, -30)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "i int, a double, b double, c double")
    got = {r["row_id"]: (r["d1"], r["d2"]) for r in reduce.tsne(df, "i", ["a", "b", "c"], perplexity=10.0).collect()}
    assert sorted(got) == list(range(450))
    y = np.array([got[i] for i in range(450)])
    gap = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(gap, np.inf)
    assert (gap.argmin(1) // 150 == np.arange(450) // 150).all()
    assert reduce.compare(df, "i", ["a", "b", "c"]).groupBy("method").count().filter("count = 450").count() == 2


def test_tree_shap_explains_all_held_out_rows(spark, tmp_path):
    from prismtab.plans import inference

    spark.range(400).selectExpr("cast(id as int) as s_suppkey", "cast(id * 7 % 25 as int) as s_nationkey", "1000 * pmod(sin(id) * 10000, 1D) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    s = spark.read.parquet(f"{tmp_path}/supplier.parquet").select("s_nationkey", F.col("s_suppkey").cast("double").alias("k"), "s_acctbal")
    held = models.train(s, "s_acctbal")["predictions"].count()
    assert held > 40 and inference.C.queries["tree_shap"](spark, str(tmp_path)).count() == held


def brute_information(x, y, classes, k=3):
    n = len(x)
    x = x / x.std()
    dx = np.abs(x[:, None] - x)
    np.fill_diagonal(dx, np.inf)
    psi = lambda v: float(mutual_info.digamma(np.atleast_1d(np.asarray(v, float))).mean())
    if classes:
        size = np.array([(y == v).sum() for v in y])
        r = np.array([np.nextafter(np.sort(dx[i][y == y[i]])[min(k, size[i] - 1) - 1], 0) for i in range(n)])
        return psi([n]) + psi(np.minimum(k, size - 1)) - psi(size) - psi((dx <= r[:, None]).sum(1) + 1)
    z = y / y.std()
    dz = np.abs(z[:, None] - z)
    r = np.nextafter(np.partition(np.maximum(dx, dz), k - 1, axis=1)[:, k - 1], 0)[:, None]
    return psi([n]) + psi([k]) - psi((dx <= r).sum(1) + 1) - psi((dz - np.diag(np.diag(dz)) <= r).sum(1))


@pytest.mark.parametrize("classes", [False, True])
def test_mutual_information_of_all_rows(spark, classes):
    rng = np.random.default_rng(13)
    n = 3600
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    y = np.clip(np.round(a + 0.5 * rng.standard_normal(n)), -2, 2) if classes else a + 0.5 * rng.standard_normal(n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y, strict=True)], "a double, b double, y double")
    got = {r["feature"]: r["score"] for r in mutual_info.mutual_information(df, ["a", "b"], "y").collect()}
    assert [got["a"], got["b"]] == pytest.approx([max(0.0, brute_information(x, y, classes)) for x in (a, b)], abs=2e-5)


def test_silhouette_of_all_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SILHOUETTE", 100)
    rng = np.random.default_rng(14)
    x, label = rng.standard_normal((430, 2)), np.arange(430) % 3
    x[:, 0] += label
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, label, strict=True))], "row_id int, a double, b double, label int")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(430):
        inner = dist[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        outer = min(dist[i, label == k].mean() for k in range(3) if k != label[i])
        s.append((outer - inner) / max(inner, outer))
    assert cluster.silhouette(df, ["a", "b"]) == pytest.approx(float(np.mean(s)), abs=1e-9)


def test_scatter_has_all_rows(spark):
    from prismtab.operators import report

    assert report.scatter(spark.range(5200).selectExpr("id as a", "id as b"), ["a", "b"]).data.count() == 5200


def test_normality_of_all_values(spark):
    x = np.round(np.random.default_rng(15).gamma(20, 1, 5600), 2)  # with ties
    got = stats.normality(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
    w, p = stats.shapiro_wilk(x)
    assert got.statistic == pytest.approx(w, abs=1e-6) and got.p_value == pytest.approx(p, rel=1e-2, abs=1e-9)


def test_sums_of_products_keep_their_digits(spark):
    n = 1 << 21
    df = spark.range(0, n, 1, 1).selectExpr("(id % 50) + 0.1D as a", "(id * 7919 % 104729) * 0.01D as b")
    i = np.arange(n)
    x = [(i % 50) + 0.1, (i * 7919 % 104729) * 0.01]
    means = [math.fsum(v) / n for v in x]
    got_n, got_means, s = regression.centred_gram(df, ["a", "b"])
    assert got_n == n and got_means.tolist() == pytest.approx(means, rel=4e-16)
    for a in range(2):
        assert s[a, a] == pytest.approx(math.fsum((x[a] - means[a]) ** 2), rel=4e-15)


def test_pca_two_keeps_the_sign_of_zeros(spark, tmp_path):
    import duckdb

    from prismtab import catalog

    values = [0.0, 2.0, 0.99999, 1.00001]
    li = spark.createDataFrame([(i, 1, v, v, 0.0, 0.0) for i, v in enumerate(values)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    duckdb.sql(f"create or replace view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted((i, str(v)) for i, v in duckdb.sql(catalog.ORACLE_SQL["pca_two"]).fetchall())
    assert [v for _, v in want][2:] == ["-0.0", "0.0"]
    assert sorted((r["row_id"], str(r["pc1"])) for r in catalog.QUERIES["pca_two"](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_agglomeration_of_more_rows_than_one_task_joins(spark, monkeypatch, linkage):
    rng = np.random.default_rng(16)
    data = rng.standard_normal((120, 2)) + 3.0 * rng.integers(0, 3, (120, 1))
    data[90:] = data[:30]  # copies
    df = spark.createDataFrame([(f"r{i:03}", *map(float, v)) for i, v in enumerate(data)], "i string, a double, b double")
    want = cluster.agglomerate((data - data.mean(0)) / data.std(0), 7, linkage)
    monkeypatch.setattr(cluster, "AGGLOMERATE", 40)
    monkeypatch.setattr(cluster, "SILHOUETTE", 50)
    got = [r["label"] for r in cluster.hierarchical(df, "i", ["a", "b"], 7, linkage).orderBy("row_id").collect()]
    assert got == want


def test_dbscan_equals_definition_without_writing_pairs(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = np.concatenate([rng.standard_normal((250, 2)), np.repeat(rng.standard_normal((4, 2)), 40, axis=0), rng.uniform(-4, 4, (60, 2)), [[-0.0, 0.0], [0.0, -0.0]]])
    ids, eps, least = rng.permutation(len(x)), 0.3, 6
    near = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(2)) <= eps * eps
    core, root = near.sum(1) >= least, ids.copy()
    while True:
        fresh = np.array([root[near[i] & core].min() if core[i] else root[i] for i in range(len(x))])
        if (fresh == root).all():
            break
        root = fresh
    order = {r: k for k, r in enumerate(sorted(set(root[core].tolist())))}
    want = {}
    for i in range(len(x)):
        by = np.flatnonzero(near[i] & core)
        want[int(ids[i])] = order[root[i]] if core[i] else order[root[by[ids[by].argmin()]]] if len(by) else -1
    assert -1 in want.values() and len(order) > 2
    sizes, kept = [], cluster.cut
    monkeypatch.setattr(cluster, "FEW", 1)
    monkeypatch.setattr(cluster, "cut", lambda df: sizes.append((out := kept(df)).count()) or out)
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)], "i int, a double, b double")
    assert {r["row_id"]: r["label"] for r in cluster.dbscan(df, "i", ["a", "b"], eps, least, scale=False).collect()} == want
    assert max(sizes) <= 2 * len(x) < near.sum()


@pytest.mark.parametrize("largest", [False, True])
def test_nearest_within_boxes_equal_all_compared(monkeypatch, largest):
    from prismtab.functions import nearest

    rng = np.random.default_rng(18)
    compared, real = [0], nearest._length
    monkeypatch.setattr(nearest, "_length", lambda gap, m: compared.__setitem__(0, compared[0] + gap.shape[0] * gap.shape[1]) or real(gap, m))
    for x in (rng.standard_normal((3000, 2)), np.round(rng.standard_normal((3000, 2)), 1), rng.integers(0, 3, (3000, 1)).astype(float)):
        for mine, same in ((x, True), (x[:50] + 0.01, False)):
            d = real(mine[:, None, :] - x[None], largest)
            if same:
                np.fill_diagonal(d, np.inf)
            want = np.argsort(d, axis=1, kind="stable")[:, :3]
            compared[0] = 0
            dist, place = nearest._best(mine, x, 3, largest, same)
            assert (place == want).all() and (dist == np.take_along_axis(d, want, 1)).all()
            assert compared[0] < len(mine) * len(x) or len(np.unique(x)) == 3


def test_silhouettes_of_many_labels_compare_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(19)
    rows = [(i, *map(float, rng.standard_normal(2)), i % 2, i % 3 - 1, 0) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, p int, q int, one int")
    want = [cluster.silhouette(df.withColumn("label", F.col(c)), ["a", "b"]) for c in ("p", "q", "one")]
    kept, cuts = cluster.cut, []
    monkeypatch.setattr(cluster, "cut", lambda d: cuts.append(1) or kept(d))
    assert cluster.silhouettes(df, ["a", "b"], ["p", "q", "one"]) == pytest.approx(want, abs=1e-12) and want[2] == -1.0
    assert len(cuts) == 3


@pytest.mark.parametrize("sign", [-1, 0, 1])
def test_pca_two_is_its_sql_however_the_columns_are_correlated(spark, tmp_path, sign):
    import duckdb

    from prismtab import catalog

    rng = np.random.default_rng(20)
    q = rng.integers(1, 51, 400).astype(float)
    e = np.round(50000 + 300 * sign * q + 9000 * rng.standard_normal(400), 2) if sign else np.concatenate([q[:200], 51 - q[:200]])
    q = q if sign else np.concatenate([q[:200], q[:200]])
    li = spark.createDataFrame([(i, 1, *map(float, v), 0.0, 0.0) for i, v in enumerate(zip(q, e, strict=True))], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    duckdb.sql(f"create or replace view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(duckdb.sql(catalog.ORACLE_SQL["pca_two"]).fetchall())
    assert sorted((r["row_id"], r["pc1"]) for r in catalog.QUERIES["pca_two"](spark, str(tmp_path)).collect()) == want


def test_components_of_nearly_uncorrelated_columns(spark):
    df = spark.range(0, 4000, 1, 3).selectExpr("(id * 7919 % 4001) * 0.1D + 3 as a", "(id * id % 3989) * 1e3D + 0.7 as b")
    n, _, s = regression.centred_gram(df, ["a", "b"])
    assert abs(s[0, 1]) < 0.1 * math.sqrt(s[0, 0] * s[1, 1])
    c = reduce.fit(df, ["a", "b"])
    assert np.abs(c.vectors) == pytest.approx(np.full((2, 2), math.sqrt(0.5)), abs=3e-16)


def test_boosted_trees_of_many_classes_are_sparks(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    from prismtab.operators.boosting import ManyClasses

    rng = np.random.default_rng(21)
    x = np.stack([rng.integers(0, 9, 700), rng.integers(0, 6, 700) * 0.5, rng.integers(0, 3, 700)], 1)
    y = (x[:, 0] + 2 * x[:, 1] + rng.integers(0, 3, 700)) // 4
    rows = _points(spark, x, y).withColumnRenamed("_1", "features").withColumnRenamed("_2", "label").cache()
    want, got = OneVsRest(classifier=GBTClassifier(maxIter=12, maxDepth=3)).fit(rows), ManyClasses(12, 3).fit(rows)
    shares = np.mean([m.featureImportances.toArray() for m in want.models], axis=0)
    assert got.featureImportances.toArray() == pytest.approx(shares, abs=1e-9)
    said = lambda m: sorted((*r["features"].toArray(), r["label"], r["prediction"]) for r in m.transform(rows).collect())
    assert said(got) == said(want)


def test_training_for_many_classes_is_no_fit_for_each(spark, monkeypatch):
    from pyspark.ml import classification

    fits, real = [], classification.GBTClassifier.fit
    monkeypatch.setattr(classification.GBTClassifier, "fit", lambda *a, **b: fits.append(1) or real(*a, **b))
    df = spark.range(0, 3000, 1, 3).selectExpr("cast(id % 30 as int) as a", "concat('b', id % 7) as b", "(id % 30) * 1.5D as y")
    got = models.train(df, "y")
    assert got["task"] == "classification" and len(got["labels"]) == 30 and not fits
    assert got["metrics"]["accuracy"] > 0.9 and got["importances"]["a"] > 0.9
    assert got["predictions"].count() == got["predictions"].filter("prediction between 0 and 29").count() > 400


def test_nearest_centers_are_found_by_boxes(monkeypatch):
    rng = np.random.default_rng(22)
    looked, real = [0], cluster._Boxes._look
    monkeypatch.setattr(cluster._Boxes, "_look", lambda b, own, mine, box: looked.__setitem__(0, looked[0] + b.x[box].shape[0] * b.x.shape[1]) or real(b, own, mine, box))
    for x in (rng.standard_normal((3000, 3)), np.round(rng.standard_normal((3000, 2)), 1), rng.standard_normal((5, 2))):
        w, names = rng.integers(1, 5, len(x)).astype(float), rng.permutation(10 * len(x))[: len(x)]
        data = np.column_stack([w, x])
        d = cluster._squared(x, x) * (w[:, None] * w / (w[:, None] + w)) * 2
        d[names[:, None] == names] = np.inf
        want = [min((d[i, j], int(cluster._hash(names[i : i + 1], names[j : j + 1])[0]), int(names[j])) for j in np.flatnonzero(d[i] == d[i].min())) for i in range(len(x))]
        looked[0] = 0
        i, height, h, best = cluster._Boxes(names, data).nearest(names, data)
        assert (i == np.arange(len(x))).all() and list(zip(height.tolist(), h.tolist(), best.tolist(), strict=True)) == want
        assert looked[0] < len(x) ** 2 / 3 or len(x) < 10


def test_ward_joins_blocks_of_centers(spark, monkeypatch):
    rng = np.random.default_rng(23)
    data = rng.standard_normal((130, 2)) + 3.0 * rng.integers(0, 3, (130, 1))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(data)], "i int, a double, b double")
    want = cluster.agglomerate((data - data.mean(0)) / data.std(0), 5, "ward")
    monkeypatch.setattr(cluster, "AGGLOMERATE", 30)
    monkeypatch.setattr(cluster, "CENTERS", 80)
    assert [r["label"] for r in cluster.hierarchical(df, "i", ["a", "b"], 5).orderBy("row_id").collect()] == want


@pytest.mark.parametrize("largest", [False, True])
def test_nearest_on_lines_equal_all_compared(monkeypatch, largest):
    from prismtab.functions import nearest

    rng = np.random.default_rng(24)
    values, noise = rng.integers(0, 9, 3000) * 0.1, 1e-10 * rng.standard_normal((3000, 2))
    copies = np.repeat(np.column_stack([values, rng.standard_normal(3000)])[:100], 30, axis=0) + noise
    boxed, real = [0], nearest._best_by_box
    monkeypatch.setattr(nearest, "_best_by_box", lambda mine, *a: boxed.__setitem__(0, len(mine)) or real(mine, *a))
    for x in (np.column_stack([values, rng.standard_normal(3000)]) + noise, np.column_stack([np.round(rng.standard_normal(3000), 1), values]), copies, copies[:, ::-1], np.zeros((90, 2))):
        d = nearest._length(x[:, None, :] - x[None], largest)
        np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, :3]
        boxed[0] = 0
        dist, place = nearest._best(x, x, 3, largest, True)
        assert (place == want).all() and (dist == np.take_along_axis(d, want, 1)).all()
        assert boxed[0] < 300 or len(np.unique(x)) < 100
