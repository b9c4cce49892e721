"""Anomalies, features and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.operators import anomaly, features, forecast, outliers
from prismtab.plans.base import Catalog, read

C = Catalog()


# Anomalies of single columns.

def _z(c: str, t: str, thr: float, key: str) -> str:
    return f"select {key} as row_id, '{c}' as \"column\", {c}::double as value, 'zscore' as method, round(abs({c} - m) / s, 4) as score, case when {c} > m then 'high' else 'low' end as direction from {t}, (select avg({c}) m, stddev_pop({c}) s from {t}) where abs({c} - m) / s > {thr}"


def _iqr(c: str, t: str, key: str) -> str:
    return f"select {key} as row_id, '{c}' as \"column\", {c}::double as value, 'iqr' as method, round(greatest((a - 1.5 * (b - a)) - {c}, {c} - (b + 1.5 * (b - a))) / (b - a), 4) as score, case when {c} > b then 'high' else 'low' end as direction from {t}, (select quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b from {t}) where b > a and ({c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a))"


@C.add("anomaly_zscore", _z("value", "events", 2.0, "event_id"))
def anomaly_zscore(spark, sf):
    return anomaly.zscore(read(spark, sf, "events"), "event_id", ["value"], 2.0)


@C.add("anomaly_iqr", _iqr("value", "events", "event_id") + " union all " + _iqr("user_id", "events", "event_id"))
def anomaly_iqr(spark, sf):
    return anomaly.iqr(read(spark, sf, "events"), "event_id", ["value", "user_id"])


_BEST = f"select row_id, \"column\", value, score from ({_z('value', 'events', 2.0, 'event_id')} union all {_iqr('value', 'events', 'event_id')}) qualify row_number() over (partition by row_id, \"column\" order by score desc, method desc) = 1"


@C.add("anomaly_merge", _BEST)
def anomaly_merge(spark, sf):
    return anomaly.detect_all(read(spark, sf, "events"), "event_id", ["value"], 2.0).select("row_id", "column", "value", "score")


@C.add("anomaly_summary", f"select count(*) as total_anomalies, count(distinct \"column\") as columns_affected, max(score) as top_score from ({_BEST})")
def anomaly_summary(spark, sf):
    return anomaly.summary(anomaly.detect_all(read(spark, sf, "events"), "event_id", ["value"], 2.0)).select("total_anomalies", "columns_affected", "top_score")


@C.add("anomaly_constant", "select 1 as n where false")
def anomaly_constant(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.lit(5.0).alias("x"))
    return anomaly.detect_all(e, "event_id", ["x"]).select(F.lit(1).alias("n"))


# Anomalies of rows.

_M2 = """with s as (select avg(p_size) mx, avg(p_retailprice) my, var_samp(p_size) a, var_samp(p_retailprice) b, covar_samp(p_size, p_retailprice) c from part),
d as (select p_partkey as row_id, sqrt((b * (p_size - mx) ** 2 - 2 * c * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) ** 2) / (a * b - c * c)) as dist from part, s)
select row_id, round(dist / (select max(dist) from d), 6) as score, dist > 2 as anomaly from d"""


@C.add("mahalanobis_2d", _M2)
def mahalanobis_2d(spark, sf):
    return outliers.mahalanobis(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], 2.0).select("row_id", "score", "anomaly")


@C.add(
    "lof",
    """with p as (select p_partkey as id, (p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part) as x, (p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part) as y from part),
n as (select a.id as a, b.id as b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from p a join p b on a.id <> b.id qualify row_number() over (partition by a.id order by d, b.id) <= 20),
k as (select a, max(d) as kd from n group by a), r as (select n.a, 1 / (avg(greatest(d, kd)) + 1e-10) as lrd from n join k on k.a = n.b group by n.a)
select n.a as row_id, avg(o.lrd) / any_value(m.lrd) > 1.5 as anomaly from n join r o on o.a = n.b join r m on m.a = n.a group by n.a""",
)
def lof(spark, sf):
    return outliers.local_outlier_factor(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"]).select("row_id", "anomaly")


@C.add("isolation_forest")
def isolation_forest(spark, sf):
    return outliers.isolation_forest(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


@C.add("anomaly_compare")
def anomaly_compare(spark, sf):
    return outliers.compare(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


@C.add("ensemble_vote")
def ensemble_vote(spark, sf):
    return outliers.ensemble(read(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


# Features.

def _r(df: DataFrame, *names: str, n: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


@C.add("scale_standard", "select p_partkey, round((p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part), 5) as p_size_scaled from part")
def scale_standard(spark, sf):
    return _r(features.scale(read(spark, sf, "part").select("p_partkey", "p_size"), ["p_size"]), "p_size_scaled").drop("p_size")


@C.add("scale_minmax", "select p_partkey, round((p_size - (select min(p_size) from part)) / (select max(p_size) - min(p_size) from part)::double, 5) as p_size_scaled, 0e0 as one_scaled from part")
def scale_minmax(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_size", F.lit(1.0).alias("one"))
    return _r(features.scale(p, ["p_size", "one"], "minmax"), "p_size_scaled").drop("p_size", "one")


@C.add("scale_robust", "select p_partkey, round((p_size - (select quantile_cont(p_size, 0.5) from part)) / (select quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) from part), 5) as p_size_scaled from part")
def scale_robust(spark, sf):
    return _r(features.scale(read(spark, sf, "part").select("p_partkey", "p_size"), ["p_size"], "robust"), "p_size_scaled").drop("p_size")


@C.add("onehot", "select r_regionkey, " + ", ".join(f"(r_name = '{n}')::int as \"r_name_{n}\"" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " from region")
def onehot(spark, sf):
    return features.onehot(read(spark, sf, "region").select("r_regionkey", "r_name"), ["r_name"])


@C.add("ordinal", "select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 end::int as o_orderstatus_ordinal from orders")
def ordinal(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return features.ordinal(o, "o_orderstatus", ["F", "O"]).select("o_orderkey", F.col("o_orderstatus_ordinal").cast("int").alias("o_orderstatus_ordinal"))


@C.add("poly", "select s_suppkey, s_nationkey::double ** 2 as s_nationkey_pow2, s_nationkey::double ** 3 as s_nationkey_pow3, (s_suppkey::double) ** 2 as s_suppkey_pow2, (s_suppkey::double) ** 3 as s_suppkey_pow3, s_suppkey::double * s_nationkey as s_suppkey_x_s_nationkey from supplier")
def poly(spark, sf):
    return features.polynomial(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey", "s_nationkey"], 3).drop("s_nationkey")


@C.add("interactions", "select l_orderkey, l_linenumber, l_quantity * l_tax as l_quantity_x_l_tax, l_quantity * l_linenumber as l_quantity_x_l_linenumber, l_tax * l_linenumber as l_tax_x_l_linenumber from lineitem")
def interactions(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return features.interactions(li, ["l_quantity", "l_tax", "l_linenumber"]).drop("l_quantity", "l_tax")


@C.add("auto_engineer", "select n_nationkey, n_regionkey, " + "round((n_nationkey - (select avg(n_nationkey) from nation)) / (select stddev_pop(n_nationkey) from nation), 5) as n_nationkey_scaled, round((n_regionkey - (select avg(n_regionkey) from nation)) / (select stddev_pop(n_regionkey) from nation), 5) as n_regionkey_scaled, (n_nationkey * n_regionkey)::double as n_nationkey_x_n_regionkey from nation")
def auto_engineer(spark, sf):
    return _r(features.auto_engineer(read(spark, sf, "nation").select("n_nationkey", "n_regionkey")), "n_nationkey_scaled", "n_regionkey_scaled")


@C.add("time_features", "select event_id, (isodow(ts) - 1)::int as ts_day_of_week, month(ts)::int as ts_month, quarter(ts)::int as ts_quarter, year(ts)::int as ts_year, (isodow(ts) >= 6)::int as ts_is_weekend, hour(ts)::int as ts_hour from events")
def time_features(spark, sf):
    return features.time_parts(read(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


@C.add("bin_width", "with s as (select min(p_retailprice) lo, (max(p_retailprice) - min(p_retailprice)) / 5 w from part) select p_partkey, greatest(least(ceil((p_retailprice - lo) / w) - 1, 4), 0)::int as p_retailprice_binned from part, s")
def bin_width(spark, sf):
    return features.bin_numeric(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice").drop("p_retailprice")


@C.add("bin_freq", "with q as (select quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) as q from part) select p_partkey, ((p_retailprice > q[1])::int + (p_retailprice > q[2])::int + (p_retailprice > q[3])::int) as p_retailprice_binned from part, q")
def bin_freq(spark, sf):
    return features.bin_numeric(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4, "equal_frequency").drop("p_retailprice")


@C.add("target_means", "select o_orderpriority as category, round(avg(o_totalprice), 3) as mean from orders group by 1")
def target_means(spark, sf):
    return _r(features.target_means(read(spark, sf, "orders"), "o_orderpriority", "o_totalprice"), "mean", n=3)


@C.add("target_encode", "select event_id, round(coalesce(avg(value) over (partition by t), avg(value) over ()), 4) as t_target_encoded from (select event_id, value, case when event_id % 7 = 0 then null else event_type end as t from events) qualify true")
def target_encode(spark, sf):
    e = read(spark, sf, "events").select("event_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("t"))
    out = features.target_encode(e, "t", "value").select("event_id", F.round("t_target_encoded", 4).alias("t_target_encoded"))
    return out


C.sql["target_encode"] = "with e as (select event_id, value, case when event_id % 7 = 0 then null else event_type end as t from events), m as (select t, avg(value) as m from e where t is not null group by t) select event_id, round(coalesce(m.m, (select avg(value) from e)), 4) as t_target_encoded from e left join m on e.t = m.t"


@C.add("select_variance", " union all ".join(f"select '{c}' as feature, round(var_samp({c}), 4) as score, var_pop({c}) > 0.01 as selected from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def select_variance(spark, sf):
    li = read(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    return features.select_features(li, "l_extendedprice").select("feature", F.round("score", 4).alias("score"), "selected")


@C.add("select_corr", "select 'a' as feature, 1e0 as score, true as selected union all select 'b', 1, false union all select 'c', round(corr(l_quantity, l_tax), 4), true from lineitem")
def select_corr(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * 2 + 1).alias("b"), F.col("l_tax").alias("c"), "l_extendedprice")
    return features.select_features(li, "l_extendedprice", "correlation", 0.9).select("feature", F.round("score", 4).alias("score"), "selected")


@C.add("mutual_info")
def mutual_info(spark, sf):
    return features.select_features(read(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), "l_extendedprice", "mutual_info")


# Forecasts.

def _daily(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return forecast.series(daily, "event_type", "day", "v")


_SERIES = "d as (select event_type as series, ts::date as day, sum(value) as v from events group by all), s as (select series, v, row_number() over (partition by series order by day) - 1 as i, count(*) over (partition by series) as n from d)"


@C.add(
    "forecast_linear",
    f"with {_SERIES}, f as (select series, any_value(n) as n, regr_slope(v, i) as b, regr_intercept(v, i) as a from s group by series), e as (select s.series, avg(abs(v - a - b * i)) as mae, sqrt(avg((v - a - b * i) ** 2)) as rmse from s join f using (series) group by s.series) select f.series, h.h::int as step, round(a + b * (n + h.h), 3) as prediction, round(mae, 3) as mae, round(rmse, 3) as rmse from f join e using (series), range(5) h(h)",
)
def forecast_linear(spark, sf):
    f = forecast.forecasts(_daily(spark, sf)).select("series", "linear_trend.errors.mae", "linear_trend.errors.rmse", F.posexplode("linear_trend.predictions").alias("step", "prediction"))
    return _r(f, "prediction", "mae", "rmse", n=3)


@C.add(
    "forecast_ma_errors",
    f"with {_SERIES}, p as (select series, v, i, avg(v) over (partition by series order by i rows between 3 preceding and 1 preceding) as p from s) select series, round(avg(abs(v - p)), 3) as mae, round(sqrt(avg((v - p) ** 2)), 3) as rmse, round(avg(abs((v - p) / nullif(v, 0))) * 100, 3) as mape from p where i >= 3 group by series",
)
def forecast_ma_errors(spark, sf):
    e = forecast.forecasts(_daily(spark, sf)).select("series", "moving_average.errors.*")
    return _r(e, "mae", "rmse", "mape", n=3)


_MA_CTE = "ma as (select series, 0 as step, list(v order by i)[-3:] as last from s group by series union all select series, step + 1, list_append(last[2:], (last[1] + last[2] + last[3]) / 3) from ma where step < 5)"
_SES_CTE = "ses as (select series, i, v as l, null::double as p from s where i = 0 union all select s.series, s.i, 0.3 * s.v + 0.7 * ses.l, ses.l from ses join s on s.series = ses.series and s.i = ses.i + 1)"


@C.add("forecast_ma", f"with recursive {_SERIES}, {_MA_CTE} select series, (step - 1)::int as step, round(last[3], 3) as prediction from ma where step > 0")
def forecast_ma(spark, sf):
    return _r(forecast.forecasts(_daily(spark, sf)).select("series", F.posexplode("moving_average.predictions").alias("step", "prediction")), "prediction", n=3)


@C.add("forecast_ses", f"with recursive {_SERIES}, {_SES_CTE}, e as (select ses.series, avg(abs(s.v - ses.p)) as mae from ses join s using (series, i) where i > 0 group by ses.series) select series, h.h::int as step, round(l, 3) as prediction, round(mae, 3) as mae from ses join e using (series), range(5) h(h) where i = (select max(i) from s where s.series = ses.series)")
def forecast_ses(spark, sf):
    f = forecast.forecasts(_daily(spark, sf)).select("series", "exponential_smoothing.errors.mae", F.posexplode("exponential_smoothing.predictions").alias("step", "prediction"))
    return _r(f, "prediction", "mae", n=3)


@C.add(
    "forecast_ensemble",
    f"""with recursive {_SERIES}, {_MA_CTE}, {_SES_CTE}, f as (select series, any_value(n) as n, regr_slope(v, i) as b, regr_intercept(v, i) as a from s group by series),
    l as (select series, l from ses where i = (select max(i) from s where s.series = ses.series))
    select ma.series, (step - 1)::int as step, round((last[3] + l + a + b * (n + step - 1)) / 3, 3) as prediction from ma join l using (series) join f using (series) where step > 0""",
)
def forecast_ensemble(spark, sf):
    return _r(forecast.forecasts(_daily(spark, sf)).select("series", F.posexplode("ensemble.predictions").alias("step", "prediction")), "prediction", n=3)


#: All methods of all series: their errors e (k is the method) and predictions y.
_METHODS_CTE = f"""with recursive {_SERIES}, {_MA_CTE}, {_SES_CTE},
p as (select series, v, i, avg(v) over (partition by series order by i rows between 3 preceding and 1 preceding) as p from s),
f as (select series, any_value(n) as n, regr_slope(v, i) as b, regr_intercept(v, i) as a from s group by series),
pairs as (select series, 0 as k, v, p from p where i >= 3 union all select s.series, 1, s.v, ses.p from ses join s on ses.series = s.series and ses.i = s.i where s.i > 0 union all select s.series, 2, v, a + b * i from s join f using (series)),
e3 as (select series, k, round(avg(abs(v - p)), 6) as mae, round(sqrt(avg((v - p) ** 2)), 6) as rmse, round(coalesce(avg(abs((v - p) / nullif(v, 0))), 0) * 100, 6) as mape from pairs group by series, k),
e as (select * from e3 union all select series, 3, round(sum(mae) / 3, 6), round(sum(rmse) / 3, 6), round(sum(mape) / 3, 6) from e3 group by series),
y3 as (select series, 0 as k, step - 1 as step, round(last[3], 6) as y from ma where step > 0 union all select series, 1, h.h, round(l, 6) from ses, range(5) h(h) where i = (select max(i) from s where s.series = ses.series) union all select series, 2, h.h, round(a + b * (n + h.h), 6) from f, range(5) h(h)),
y as (select * from y3 union all select series, 3, step, round(sum(y) / 3, 6) from y3 group by series, step)"""


@C.add(
    "forecast_compare",
    f"""{_METHODS_CTE}, b as (select series, arg_min(k, mae * 1e6 + k * 1e-3) as k from e group by series)
    select y.series, ['moving_average', 'exponential_smoothing', 'linear_trend', 'ensemble'][y.k + 1] as method, step::int as step, round(y, 3) as prediction, round(mae, 3) as mae, round(rmse, 3) as rmse, round(mape, 3) as mape, y.k = b.k as best
    from y join e on e.series = y.series and e.k = y.k join b on b.series = y.series""",
)
def forecast_compare(spark, sf):
    c = forecast.compared(_daily(spark, sf)).select("series", "method", "mae", "rmse", "mape", "best", F.posexplode("predictions").alias("step", "prediction"))
    return _r(c, "prediction", "mae", "rmse", "mape", n=3)


def _decompose_sql(p: int) -> str:
    h = p // 2
    return f"""with {_SERIES}, t as (select series, i, v, n, case when i < {h} or i >= n - {h} then avg(v) over w else sum(v) over w / {p} end as trend from s window w as (partition by series order by i rows between {h} preceding and {h} following)),
    q as (select *, avg(v - trend) over (partition by series, i % {p}) as seasonal from t) select series, i::int as t, round(v, 3) as value, round(trend, 6) as trend, round(seasonal, 6) as seasonal, round(v - trend - seasonal, 6) as residual from q"""


@C.add("forecast_decompose", _decompose_sql(7))
def forecast_decompose(spark, sf):
    return _r(forecast.decompose(_daily(spark, sf), 7), "value", n=3)


@C.add("forecast_decompose_even", _decompose_sql(6))
def forecast_decompose_even(spark, sf):
    return _r(forecast.decompose(_daily(spark, sf), 6), "value", n=3)


@C.add("forecast_confidence", f"with {_SERIES}, p as (select series, v, i, avg(v) over (partition by series order by i rows between 3 preceding and 1 preceding) as p from s) select series, h.h::int as step, round(2 * 1.96 * sqrt(avg((v - p) ** 2)), 2) as width from p, range(3) h(h) where i >= 3 group by series, h.h")
def forecast_confidence(spark, sf):
    f = forecast.with_confidence(_daily(spark, sf), 3, 0.95)
    return f.select("series", "step", F.round(F.col("upper") - F.col("lower"), 2).alias("width"))


@C.add(
    "forecast_multistep",
    f"""with recursive {_SERIES}, {_SES_CTE},
    m as (select s.series, 0 as step, any_value(n)::double as n, sum(s.v) as sv, sum(s.i * s.v) as siv, max(ses.l) filter (s.i = n - 1) as l, list(s.v order by s.i)[-3:] as last, null::double as y from s join ses on ses.series = s.series and ses.i = s.i group by s.series
    union all select series, step + 1, n + 1, sv + y1, siv + n * y1, 0.3 * y1 + 0.7 * l, list_append(last[2:], y1), y1
    from (select *, round((round((last[1] + last[2] + last[3]) / 3, 6) + round(l, 6) + round(sv / n + b * (n + 1) / 2, 6)) / 3, 6) as y1 from (select *, (siv - (n - 1) / 2 * sv) / (n * (n * n - 1) / 12) as b from m)) where step < 4)
    select series, (step - 1)::int as step, round(y, 3) as prediction from m where step > 0""",
)
def forecast_multistep(spark, sf):
    return _r(forecast.multistep(_daily(spark, sf), 4), "prediction", n=3)


@C.add(
    "forecast_cv",
    f"""with recursive {_SERIES}, {_SES_CTE},
    t as (select s.*, k, n // 4 as size from s, range(1, 4) r(k)),
    ma as (select series, k, any_value(size) as size, 0 as step, list(v order by i)[-3:] as last from t where i < size * k group by series, k union all select series, k, size, step + 1, list_append(last[2:], (last[1] + last[2] + last[3]) / 3) from ma where step < size),
    f as (select series, k, any_value(size) as size, regr_slope(v, i) as b, regr_intercept(v, i) as a from t where i < size * k group by series, k),
    y as (select ma.series, ma.k, ma.step - 1 as h, ma.size, round((round(last[3], 6) + round(l, 6) + round(a + b * (ma.size * ma.k + ma.step - 1), 6)) / 3, 6) as y
    from ma join f on f.series = ma.series and f.k = ma.k join ses on ses.series = ma.series and ses.i = ma.size * ma.k - 1 where step > 0),
    c as (select y.series, y.k, avg(abs(s.v - y)) as score from y join s on s.series = y.series and s.i = y.size * y.k + h group by y.series, y.k)
    select series, round(max(score) filter (k = 1), 3) as score_1, round(max(score) filter (k = 2), 3) as score_2, round(max(score) filter (k = 3), 3) as score_3, round(round(avg(score), 6), 3) as mean_score, round(round(stddev_pop(score), 6), 3) as std_score from c group by series""",
)
def forecast_cv(spark, sf):
    c = forecast.cross_validate(_daily(spark, sf)).select("series", *[F.col("scores")[k].alias(f"score_{k + 1}") for k in range(3)], "mean_score", "std_score")
    return _r(c, "score_1", "score_2", "score_3", "mean_score", "std_score", n=3)


@C.add("forecast_pivot", f"{_METHODS_CTE} select series, step::int as step, " + ", ".join(f"round(max(y) filter (k = {k}), 3) as {m}" for k, m in enumerate(forecast.METHODS)) + " from y group by series, step")
def forecast_pivot(spark, sf):
    c = forecast.compared(_daily(spark, sf)).select("series", "method", F.posexplode("predictions").alias("step", "prediction"))
    return _r(c.groupBy("series", "step").pivot("method", list(forecast.METHODS)).agg(F.first("prediction")), *forecast.METHODS, n=3)


@C.add("forecast_multistep_linear", f"with {_SERIES}, f as (select series, any_value(n) as n, regr_slope(v, i) as b, regr_intercept(v, i) as a from s group by series) select series, h.h::int as step, round(a + b * (n + h.h), 2) as prediction from f, range(4) h(h)")
def forecast_multistep_linear(spark, sf):
    """A point on the fitted line leaves the line as it is, so steps one by one are the line."""
    return _r(forecast.multistep(_daily(spark, sf), 4, "linear_trend"), "prediction", n=2)


@C.add(
    "forecast_best",
    f"""with recursive {_SERIES}, {_SES_CTE}, p as (select series, v, i, avg(v) over (partition by series order by i rows between 3 preceding and 1 preceding) as p from s),
    f as (select series, regr_slope(v, i) as b, regr_intercept(v, i) as a from s group by series),
    m as (select series, 'moving_average' as method, avg(abs(v - p)) as mae from p where i >= 3 group by series
    union all select series, 'exponential_smoothing', avg(abs(s.v - ses.p)) from ses join s using (series, i) where i > 0 group by series
    union all select series, 'linear_trend', avg(abs(v - a - b * i)) from s join f using (series) group by series),
    e as (select * from m union all select series, 'ensemble', avg(mae) from m group by series)
    select series, method, round(mae, 3) as mae, mae = min(mae) over (partition by series) as best from e""",
)
def forecast_best(spark, sf):
    return _r(forecast.compared(_daily(spark, sf)).select("series", "method", "mae", "best"), "mae", n=3)
