"""Profiles, quality, cleaning, attribution, key figures, charts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prismtab.operators import attribution, clean, kpi, profile, quality, report
from prismtab.sources import files, synthetic


def col(df, **where):
    return {r["column"]: r for r in df.collect()}


def test_profile_counts_types_and_skewness(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True), (2, 2.0, "b", False), (3, None, "c", None), (4, float("nan"), "d", True)], "i long, x double, s string, b boolean")
    p = {r["column"]: r for r in profile.profile(df).collect()}
    assert [p[c]["type"] for c in "ixsb"] == ["integer", "integer", "string", "boolean"]
    assert (p["x"]["null_count"], p["x"]["null_pct"], p["x"]["unique_count"]) == (2, 50.0, 2)
    assert (p["i"]["mean"], p["i"]["median"], p["i"]["q25"], p["i"]["q75"]) == (2.5, 2.5, 1.75, 3.25)
    assert p["x"]["skewness"] is None and p["i"]["skewness"] == 0.0
    assert p["s"]["top_values"][0]["value"] == "a" and p["i"]["top_values"] is None


def test_profile_of_an_empty_table(spark):
    p = profile.profile(spark.createDataFrame([], "x double, s string")).collect()
    assert {r["column"]: (r["non_null_count"], r["type"]) for r in p} == {"x": (0, "categorical_numeric"), "s": (0, "categorical")}


def test_datetime_strings_and_text(spark):
    df = spark.createDataFrame([(f"2024-01-{i:02d}", "word " * 30 + str(i)) for i in range(1, 29)], "d string, t string")
    assert {r["column"]: r["type"] for r in profile.profile(df).collect()} == {"d": "datetime_string", "t": "text"}


def test_narrowed_quantiles_equal_exact_ones(spark):
    df = spark.range(1, 2001).select(F.lit("c").alias("column"), (F.col("id") * F.col("id") % 977).cast("double").alias("number")).groupBy("column", "number").agg(F.count("*").alias("n"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert profile.exact_quantiles(df, probs, limit=10).first()["q"] == pytest.approx(profile.exact_quantiles(df, probs).first()["q"])


def test_duplicates_outliers_correlation(spark):
    dup = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (None, "z")], "a long, b string")
    assert profile.duplicate_rows(dup).first()[0] == 2
    tail = spark.createDataFrame([(float(i),) for i in [*range(100), 1000]], "v double")
    assert profile.profile(tail).first()["outlier_count"] == 1
    r = {(x["a"], x["b"]): x["r"] for x in profile.correlations(spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "c"] is None


def test_quality_percentages(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "a"), (4.0, "a"), (None, "a")], "p double, d string")
    q = {r["column"]: r for r in profile.quality_columns(df).collect()}
    assert q["p"]["completeness"] == 60.0 and q["p"]["uniqueness"] == 100.0 and q["d"]["uniqueness"] == 20.0
    none = spark.createDataFrame([(None,), (None,)], "e string")
    assert profile.quality_columns(none).first()["validity"] == 100.0


def test_quality_of_one(spark):
    df = spark.createDataFrame([("1", 10), ("two", 20), ("3", -5), ("four", 30)], "m string, v long")
    q = {r["column"]: r for r in quality.score_columns(df, {"v": ["v > 0", lambda x: x < 100]}).collect()}
    assert q["m"]["consistency"] == 0.5 and q["v"]["validity"] == 0.75
    empty = quality.score_table(spark.createDataFrame([], "a int")).first()
    assert empty["overall_score"] == 1.0 and len(empty["issues"]) == 1


def test_names_and_white_space(spark):
    df = spark.createDataFrame([(" Alice ", 1)], ["First Name", "First-Name"])
    out = clean.standardize(df)
    assert out.columns == ["first_name", "first_name_2"] and out.first()[0] == "Alice"


def test_fuzzy_dedup(spark):
    df = spark.createDataFrame([(1, "John Smith"), (2, "john  smith"), (3, "Jane Doe"), (4, None)], "i long, name string")
    assert sorted(r["i"] for r in clean.dedup_fuzzy(df, ["i"], ["name"]).collect()) == [1, 3, 4]


def test_fuzzy_dedup_by_share_is_greedy(spark):
    data = [(1, "a", "b", "c"), (2, "a", "b", "x"), (3, "z", "b", "x"), (4, "q", "r", "s"), (5, "z", "b", "y"), (6, "A", "b", "C ")]
    df = spark.createDataFrame(data, "i long, p string, q string, r string")
    keep, norm = [], lambda v: v.strip().lower()
    for row in data:
        if not any(sum(norm(a) == norm(b) for a, b in zip(row[1:], k[1:], strict=True)) >= 2 for k in keep):
            keep.append(row)
    assert sorted(r["i"] for r in clean.dedup_fuzzy(df, ["i"], ["p", "q", "r"], 0.66).collect()) == [k[0] for k in keep]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (None, None), (4.0, "a")], "x double, s string")
    assert sorted(r["x"] for r in clean.impute(df, "mean").collect())[2] == pytest.approx(7 / 3)
    out = clean.impute(df).collect()
    assert (out[2]["x"], out[2]["s"]) == (2.0, "a")
    assert clean.impute(df, "drop").count() == 3


def touches(spark):
    return spark.createDataFrame(
        [("U1", "Google", "2024-01-01"), ("U1", "Email", "2024-01-05"), ("U1", "Facebook", "2024-01-10"), ("U2", "Google", "2024-01-01"), ("U3", "LinkedIn", "2024-01-02"), ("U3", "Facebook", "2024-01-09")],
        "user_id string, channel string, timestamp string",
    )


def test_attribution(spark):
    conv = spark.createDataFrame([("U1",), ("U3",)], "user_id string")
    first = {r["channel"]: r["conversions"] for r in attribution.first_touch(touches(spark), conv).collect()}
    last = {r["channel"]: r["credit_pct"] for r in attribution.last_touch(touches(spark), conv).collect()}
    assert first == {"Google": 1, "LinkedIn": 1} and last == {"Facebook": 100.0}
    assert sum(r["credit"] for r in attribution.linear(touches(spark), conv).collect()) == pytest.approx(2.0, abs=0.03)
    decay = {r["channel"]: r["credit"] for r in attribution.time_decay(touches(spark), conv).collect()}
    assert decay["Facebook"] > decay["Email"] > decay["Google"]
    with pytest.raises(ValueError):
        attribution.linear(touches(spark).drop("channel"), conv)


def test_formulas(spark):
    r = kpi.Registry()
    r.define("k", "(a + b) * c")
    r.define("zero", "a / d", {"on_track": 1, "warning": 0.0})
    data = spark.createDataFrame([(3.0, 7.0, 5.0, 0.0)], "a double, b double, c double, d double")
    got = {x["kpi"]: (x["value"], x["status"]) for x in r.compute_all(data).collect()}
    assert got == {"k": (50.0, "on_track"), "zero": (0.0, "warning")}
    for bad in ("import os", "x / 1", "a ** 2", "f(a)", "a if b else c"):
        r.define("bad", bad)
        with pytest.raises(ValueError):
            r.compute("bad", data)
    with pytest.raises(KeyError):
        r.compute("none", data)


def test_trend(spark):
    up = spark.createDataFrame([("u", i, float(i)) for i in range(5)] + [("d", i, -float(i)) for i in range(5)] + [("s", i, 1.0) for i in range(5)] + [("l", i, float(i)) for i in range(12)], "k string, i int, v double")
    assert {r["k"]: r["trend"] for r in kpi.trend(up, ["k"], "i", "v").collect()} == {"u": "improving", "d": "declining", "s": "stable", "l": "stable"}


def test_report_and_charts(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2], None if i % 3 == 0 else "note") for i in range(60)], "x double, c string, n string")
    text = report.report(df).markdown()
    assert "## Data Overview" in text and "High missing values" in text
    charts = report.dashboard(df)
    assert [c.kind for c in charts][-1] != "scatter_matrix"
    assert len(files.write_charts(charts, str(tmp_path / "charts"))) == len(charts)


def test_files(spark, tmp_path):
    csv = tmp_path / "my_table.csv"
    csv.write_text("a,b\n1,x\n2,\n")
    assert files.load(spark, str(csv)).dtypes == [("a", "int"), ("b", "string")]
    assert files.demo_catalog(spark, str(tmp_path))["My Table"].endswith("my_table.csv")
    book = tmp_path / "t.xlsx"
    files.write_xlsx(str(book), [["id", "name", "score"], [1, 'A "q", b', 2.5], [2, None, 3]])
    out = files.load(spark, str(book))
    assert out.columns == ["id", "name", "score"] and [tuple(r) for r in out.orderBy("id").collect()] == [(1, 'A "q", b', 2.5), (2, None, 3.0)]
    with pytest.raises(ValueError):
        files.load(spark, "x.pdf")


def test_synthetic_tables_are_the_same_each_time(spark):
    a, b = synthetic.ecommerce(spark, 50), synthetic.ecommerce(spark, 50)
    assert a.exceptAll(b).count() == 0 and 5 <= a.filter("customer_rating is null").count() <= 25


def test_kpi_trend_looks_at_all_months(spark, tmp_path):
    from prismtab.plans import marketing

    # Eight months rise, the twelve after them fall.
    months = [*range(8), *range(8, -4, -1)]
    rows = [("1-URGENT", f"{1995 + i // 12}-{1 + i % 12:02d}-15", 100.0 + v) for i, v in enumerate(months)]
    spark.createDataFrame(rows, "o_orderpriority string, d string, o_totalprice double").selectExpr("o_orderpriority", "cast(d as timestamp) as o_orderdate", "o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    xs, n = [100.0 + v for v in months], len(months)
    slope = sum((i - (n - 1) / 2) * x for i, x in enumerate(xs)) / sum((i - (n - 1) / 2) ** 2 for i in range(n))
    got = marketing.C.queries["kpi_trend"](spark, str(tmp_path)).first()
    assert got["relative_slope"] == pytest.approx(slope / (max(xs) - min(xs)), abs=1e-5) and got["relative_slope"] < 0
    short = kpi.trend(spark.createDataFrame([("a", i, float(i)) for i in range(8)], "p string, i int, v double"), ["p"], "i", "v").first()
    assert short["trend"] == "improving"
