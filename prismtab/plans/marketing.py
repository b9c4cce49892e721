"""Attribution and key figures over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.operators import attribution, kpi
from prismtab.plans.base import Catalog, read

C = Catalog()

_TOUCH = "touch as (select user_id, event_type as channel, ts, event_id from events where event_type <> 'purchase'), conv as (select distinct user_id from events where event_type = 'purchase' and value > 200), own as (select t.* from touch t where user_id in (select user_id from conv))"


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "events")
    touches = e.filter("event_type <> 'purchase'").select("user_id", F.col("event_type").alias("channel"), F.col("ts").alias("timestamp"), "event_id")
    return touches, e.filter("event_type = 'purchase' and value > 200").select("user_id")


def _single_sql(last: bool) -> str:
    d = "desc" if last else "asc"
    return f"""with {_TOUCH}, firsts as (select user_id, channel, row_number() over (partition by user_id order by ts {d}, event_id {d}) as rn from own)
    select channel, count(*) as conversions, round(count(*) * 1e0 / sum(count(*)) over () * 100, 2) as credit_pct from firsts where rn = 1 group by channel"""


_LINEAR = f"""with {_TOUCH}, w as (select user_id, channel, 1e0 / count(*) over (partition by user_id) as share from own)
select channel, round(sum(share), 2) as credit, round(sum(share) / (select count(*) from conv) * 100, 2) as credit_pct from w group by channel"""
_DECAY = f"""with {_TOUCH}, w as (select user_id, channel, exp(-ln(2e0) / 7 * (epoch_us(max(ts) over (partition by user_id)) - epoch_us(ts)) / 86400e6) as weight from own),
s as (select channel, weight / sum(weight) over (partition by user_id) as share from w)
select channel, round(sum(share), 2) as credit, round(sum(share) / (select count(*) from conv) * 100, 2) as credit_pct from s group by channel"""


@C.add("attribution_first_touch", _single_sql(False))
def first_touch(spark, sf):
    return attribution.first_touch(*_tables(spark, sf), tie="event_id")


@C.add("attribution_last_touch", _single_sql(True))
def last_touch(spark, sf):
    return attribution.last_touch(*_tables(spark, sf), tie="event_id")


@C.add("attribution_linear", _LINEAR)
def linear(spark, sf):
    return attribution.linear(*_tables(spark, sf))


@C.add("attribution_time_decay", _DECAY)
def time_decay(spark, sf):
    return attribution.time_decay(*_tables(spark, sf))


@C.add(
    "attribution_all_models",
    f"""select 'first_touch' as model, channel, conversions::double as credit, credit_pct from ({_single_sql(False)})
union all select 'last_touch', channel, conversions::double, credit_pct from ({_single_sql(True)})
union all select 'linear', * from ({_LINEAR}) union all select 'time_decay', * from ({_DECAY})""",
)
def all_models(spark, sf):
    return attribution.all_models(*_tables(spark, sf), tie="event_id")


_KPIS = (
    ("revenue_per_order", "revenue / orders", {"on_track": 30000, "warning": 20000}, kpi.HIGHER),
    ("discount_rate", "discount / gross", {"on_track": 0.045, "warning": 0.06}, kpi.LOWER),
    ("return_rate", "returned / (orders - orders)", {"on_track": 1, "warning": 0}, kpi.HIGHER),
    ("net", "-(discount - gross) / 1000000", {}, kpi.HIGHER),
)


def registry() -> kpi.Registry:
    r = kpi.Registry()
    for name, formula, thresholds, direction in _KPIS:
        r.define(name, formula, thresholds, direction)
    return r


def _inputs(spark, sf, keys: tuple = ()) -> DataFrame:
    li = read(spark, sf, "lineitem")
    gross, disc = F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount")
    return li.groupBy(*keys).agg(F.sum(gross - disc).alias("revenue"), F.count_distinct("l_orderkey").cast("double").alias("orders"), F.sum(disc).alias("discount"), F.sum(gross).alias("gross"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned"))


def _kpi_sql(key: str = "") -> str:
    k, g = (f"{key}, ", f" group by {key}") if key else ("", "")
    src = f"(select {k}sum(l_extendedprice - l_extendedprice * l_discount) as revenue, count(distinct l_orderkey)::double as orders, sum(l_extendedprice * l_discount) as discount, sum(l_extendedprice) as gross, count(*) filter (where l_returnflag = 'R')::double as returned from lineitem{g})"
    rows = f"""select {k}'revenue_per_order' as kpi, round(revenue / orders, 6) as value, 30000e0 as good, 20000e0 as fair, true as up from {src}
    union all select {k}'discount_rate', round(discount / gross, 6), 0.045, 0.06, false from {src}
    union all select {k}'return_rate', 0e0, 1, 0, true from {src}
    union all select {k}'net', round(-(discount - gross) / 1000000, 6), 0, 0, true from {src}"""
    return f"select {k}kpi, round(value, 4) as value, case when (up and value >= good) or (not up and value <= good) then 'on_track' when (up and value >= fair) or (not up and value <= fair) then 'warning' else 'critical' end as status from ({rows})"


@C.add("kpi_dashboard", _kpi_sql())
def kpi_dashboard(spark, sf):
    return registry().compute_all(_inputs(spark, sf)).select("kpi", F.round("value", 4).alias("value"), "status")


@C.add("kpi_by_group", _kpi_sql("l_returnflag"))
def kpi_by_group(spark, sf):
    return registry().compute_all(_inputs(spark, sf, ("l_returnflag",)), ["l_returnflag"]).select("l_returnflag", "kpi", F.round("value", 4).alias("value"), "status")


@C.add("kpi_formula", "select 'net' as kpi, round((sum(l_extendedprice) - sum(l_extendedprice * l_discount)) / 1000000, 4) as value from lineitem")
def kpi_formula(spark, sf):
    return registry().compute("net", _inputs(spark, sf)).select("kpi", F.round("value", 4).alias("value"))


@C.add("kpi_health", f"select count(*) as n_kpis, round(avg((status = 'on_track')::int), 6) as health_score from ({_kpi_sql()})")
def kpi_health(spark, sf):
    return kpi.health(registry().compute_all(_inputs(spark, sf)))


@C.add(
    "kpi_trend",
    """with m as (select o_orderpriority as p, date_trunc('month', o_orderdate) as mon, sum(o_totalprice) as v from orders group by all),
r as (select p, v, row_number() over (partition by p order by mon) - 1 as i from m),
s as (select p, coalesce(regr_slope(v, i) / nullif(max(v) - min(v), 0), 0) as rel from r group by p)
select p as priority, case when rel > 0.1 then 'improving' when rel < -0.1 then 'declining' else 'stable' end as trend, round(rel, 5) as relative_slope from s""",
)
def kpi_trend(spark, sf):
    from pyspark.sql import Window

    m = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.date_trunc("month", "o_orderdate").alias("mon")).agg(F.sum("o_totalprice").alias("v"))
    placed = m.withColumn("i", F.row_number().over(Window.partitionBy("priority").orderBy("mon")) - 1)
    return kpi.trend(placed, ["priority"], "i", "v").withColumn("relative_slope", F.round("relative_slope", 5))


@C.add("kpi_suggest", "select * from (values ('revenue_growth'), ('churn_rate'), ('satisfaction_score')) as t(kpi)")
def kpi_suggest(spark, sf):
    return spark.createDataFrame([(k.name,) for k in kpi.suggest(["Total Revenue", "nps_score", "churn", "revenue2"])], "kpi string")
