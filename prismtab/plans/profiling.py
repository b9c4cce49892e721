"""Profiles, quality and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.operators import clean, profile, quality, report
from prismtab.plans.base import Catalog, read

C = Catalog()

#: events with values missing in the same rows on both sides.
_EV = "ev as (select event_id, user_id, case when event_id % 7 = 0 then null else event_type end as event_type, case when event_id % 5 = 0 then null else value end as value from events)"


def _events(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


def _stats(c: str, table: str) -> str:
    return f"""select '{c}' as "column", count({c}) as non_null_count, count(*) - count({c}) as null_count, round((count(*) - count({c})) * 1e2 / count(*), 2) as null_pct,
    round(avg({c}::double), 3) as mean, round(quantile_cont({c}::double, 0.5), 3) as median, round(stddev_samp({c}::double), 3) as std, min({c})::double as "min", max({c})::double as "max", round(quantile_cont({c}::double, 0.25), 3) as q25, round(quantile_cont({c}::double, 0.75), 3) as q75, round(skewness({c}::double), 3) as skewness, count(distinct {c}) as unique_count from {table}"""


_LI = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


def _round(p: DataFrame, *more: str) -> DataFrame:
    return p.select("column", "non_null_count", "null_count", "null_pct", "unique_count", *[F.round(c, 3).alias(c) for c in ("mean", "median", "std", "q25", "q75", "skewness")], "min", "max", *more)


@C.add("profile_numeric", " union all ".join(_stats(c, "lineitem") for c in _LI))
def profile_numeric(spark, sf):
    return _round(profile.profile(read(spark, sf, "lineitem"), list(_LI)))


@C.add("profile_nulls", f"with {_EV} " + _stats("value", "ev") + " union all " + _stats("event_id", "ev"))
def profile_nulls(spark, sf):
    return _round(profile.profile(_events(spark, sf), ["value", "event_id"]))


@C.add("profile_approx")
def profile_approx(spark, sf):
    return profile.profile(read(spark, sf, "lineitem"), list(_LI), approx=True)


@C.add(
    "profile_types",
    """select * from (values ('c_custkey', 'integer'), ('c_name', 'string'), ('c_nationkey', case when (select count(distinct c_nationkey) * 1e0 / count(*) < 0.05 and count(distinct c_nationkey) < 20 from customer) then 'categorical_numeric' else 'integer' end), ('c_acctbal', 'float'),
    ('c_mktsegment', case when (select count(distinct c_mktsegment) * 1e0 / count(*) < 0.05 from customer) then 'categorical' else 'string' end)) as t("column", type)""",
)
def profile_types(spark, sf):
    return profile.profile(read(spark, sf, "customer")).select("column", "type")


@C.add("profile_types_text", "select 'text' as \"column\", 'text' as type union all select 'lang', 'categorical' union all select 'doc_id', 'integer'")
def profile_types_text(spark, sf):
    return profile.profile(read(spark, sf, "documents").select("doc_id", "text", "lang")).select("column", "type")


@C.add("profile_top_values", "select 'c_mktsegment' as \"column\", row_number() over (order by count(*) desc, c_mktsegment)::int as rank, c_mktsegment as value, count(*) as n from customer group by c_mktsegment qualify rank <= 10 union all select 'c_nationkey', (row_number() over (order by count(*) desc, c_nationkey::varchar))::int as rank, c_nationkey::varchar, count(*) from customer group by c_nationkey qualify rank <= 10")
def profile_top_values(spark, sf):
    return profile.top_values(profile.value_counts(read(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"]))


def _outliers(c: str, t: str) -> str:
    return f"select '{c}' as \"column\", (select count(*) from {t}, (select quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b from {t}) where {c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a)) as outlier_count"


@C.add("profile_outliers", " union all ".join(_outliers(c, t) for c, t in (("l_extendedprice", "lineitem"), ("l_quantity", "lineitem"), ("l_discount", "lineitem"))))
def profile_outliers(spark, sf):
    return profile.profile(read(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"]).select("column", "outlier_count")


def _corr(pairs) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 5) as r from lineitem" for a, b in pairs)


@C.add("profile_corr", _corr([(a, b) for i, a in enumerate(_LI) for b in _LI[i:]]))
def profile_corr(spark, sf):
    return profile.correlations(read(spark, sf, "lineitem"), list(_LI)).withColumn("r", F.round("r", 5))


@C.add("profile_dup_rows", f"with {_EV} select count(*) - count(distinct (user_id, event_type)) as duplicates from ev")
def profile_dup_rows(spark, sf):
    return profile.duplicate_rows(_events(spark, sf).select("user_id", "event_type"))


@C.add("profile_memory", "select round(sum(8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment)) / 1048576, 2) as memory_mb from customer")
def profile_memory(spark, sf):
    return profile.memory_mb(read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


_Q = f"""with {_EV}, q as (select 'event_id' as "column", 100e0 as completeness, round(count(distinct event_id) * 1e2 / count(event_id), 2) as uniqueness, 100e0 as validity from ev
union all select 'user_id', 100, round(count(distinct user_id) * 1e2 / count(user_id), 2), 100 from ev
union all select 'event_type', round(count(event_type) * 1e2 / count(*), 2), round(count(distinct event_type) * 1e2 / count(event_type), 2), 100 from ev
union all select 'value', round(count(value) * 1e2 / count(*), 2), round(count(distinct value) * 1e2 / count(value), 2), 100 from ev) """


@C.add("profile_overview", _Q + ", o as (select round(avg(completeness) * 0.5 + avg(validity) * 0.3 + avg(uniqueness) * 0.2, 2) as quality from q) select (select count(*) from ev) as row_count, 4::bigint as column_count, (select count(*) - count(distinct (event_id, user_id, event_type, value)) from ev) as duplicate_rows, (select round(sum(8 + 8 + coalesce(strlen(event_type), 0) + 8) / 1048576, 2) from ev) as memory_mb, quality from o")
def profile_overview(spark, sf):
    return profile.overview(_events(spark, sf))


@C.add("quality_pct", _Q + "select * from q")
def quality_pct(spark, sf):
    return profile.quality_columns(_events(spark, sf)).select("column", "completeness", "uniqueness", "validity")


@C.add("quality_pct_overall", _Q + "select round(avg(completeness) * 0.5 + avg(validity) * 0.3 + avg(uniqueness) * 0.2, 2) as overall_score, round(avg(completeness), 2) as completeness, round(avg(uniqueness), 2) as uniqueness, round(avg(validity), 2) as validity from q")
def quality_pct_overall(spark, sf):
    return profile.quality(_events(spark, sf))


def _score(c: str, ok: str = "true") -> str:
    return f"select '{c}' as \"column\", round(count({c}) * 1e0 / count(*), 6) as completeness, round(count(distinct {c}) * 1e0 / count({c}), 6) as uniqueness, 1e0 as consistency, round(count(*) filter (where {c} is not null and {ok}) * 1e0 / count({c}), 6) as validity from ev"


_SCORES = f"with {_EV}, s as ({_score('event_id')} union all {_score('user_id')} union all {_score('event_type')} union all {_score('value', 'value > 10 and value < 200')}) "
_RULES = {"value": ["value > 10", "value < 200"]}


@C.add("quality_score", _SCORES + "select *, round(completeness * 0.3 + uniqueness * 0.2 + consistency * 0.3 + validity * 0.2, 5) as overall from s")
def quality_score(spark, sf):
    return quality.score_columns(_events(spark, sf), _RULES).drop("ordinal").withColumn("overall", F.round("overall", 5))


@C.add("quality_frame", _SCORES + "select round(avg(completeness * 0.3 + uniqueness * 0.2 + consistency * 0.3 + validity * 0.2), 5) as overall_score, (select count(*) from ev) as row_count, (select sum((completeness < 0.9)::int + (uniqueness < 0.5)::int + (consistency < 0.9)::int)::int from s) as n_issues from s")
def quality_frame(spark, sf):
    return quality.score_table(_events(spark, sf), _RULES).select(F.round("overall_score", 5).alias("overall_score"), "row_count", F.size("issues").alias("n_issues"))


@C.add("quality_rules_python", f"with {_EV} select round(count(*) filter (where value > 10) * 1e0 / count(value), 6) as validity from ev")
def quality_rules_python(spark, sf):
    return quality.score_columns(_events(spark, sf).select("value"), {"value": [lambda v: v > 10]}).select("validity")


@C.add("clean_standardize", "select c_custkey as cust_key, regexp_replace(regexp_replace('  ' || c_name || chr(9), '^\\s+', ''), '\\s+$', '') as full_name from customer")
def clean_standardize(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias(" Cust-Key "), F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("Full Name!"))
    return clean.standardize(c)


@C.add("impute_smart", f"with {_EV} select event_id, user_id, coalesce(event_type, (select event_type from ev where event_type is not null group by event_type order by count(*) desc, event_type limit 1)) as event_type, round(coalesce(value, (select quantile_cont(value, 0.5) from ev)), 6) as value from ev")
def impute_smart(spark, sf):
    return clean.impute(_events(spark, sf)).withColumn("value", F.round("value", 6))


@C.add("impute_mean", f"with {_EV} select event_id, round(coalesce(value, (select avg(value) from ev)), 6) as value from ev")
def impute_mean(spark, sf):
    return clean.impute(_events(spark, sf).select("event_id", "value"), "mean").withColumn("value", F.round("value", 6))


@C.add("impute_drop", f"with {_EV} select * from ev where event_type is not null and value is not null")
def impute_drop(spark, sf):
    return clean.impute(_events(spark, sf), "drop")


@C.add("clean_report", f"with {_EV}, u as (select distinct on (user_id, event_type) * from ev order by user_id, event_type, event_id) select (select count(*) from ev) as rows_before, (select count(*) from u) as rows_after, (select count(*) from ev) - (select count(*) from u) as duplicates_removed, (select count(*) filter (where event_type is null) + count(*) filter (where value is null) from u) as values_imputed, 0::bigint as columns_renamed")
def clean_report(spark, sf):
    return clean.clean_report(_events(spark, sf), ["event_id"], ["user_id", "event_type"])


@C.add("clean_pipeline", f"with {_EV}, u as (select * from ev qualify row_number() over (partition by user_id, event_type order by event_id) = 1) select event_id, user_id, coalesce(event_type, (select event_type from u where event_type is not null group by event_type order by count(*) desc, event_type limit 1)) as event_type, round(coalesce(value, (select quantile_cont(value, 0.5) from u)), 6) as value from u")
def clean_pipeline(spark, sf):
    return clean.clean(_events(spark, sf), ["event_id"], subset=["user_id", "event_type"]).withColumn("value", F.round("value", 6))


@C.add("dedup_exact", "select distinct lang, source from documents")
def dedup_exact(spark, sf):
    return clean.dedup_exact(read(spark, sf, "documents").select("lang", "source"))


@C.add("dedup_subset", f"with {_EV} select * from ev qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def dedup_subset(spark, sf):
    return clean.dedup_exact(_events(spark, sf), ["user_id", "event_type"], ["event_id"])


_KEY = "regexp_replace(regexp_replace(trim(lower(coalesce(text, '')), chr(32) || chr(9) || chr(10) || chr(13)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')"


@C.add("dedup_fuzzy", f"select doc_id from documents qualify row_number() over (partition by {_KEY} order by doc_id) = 1")
def dedup_fuzzy(spark, sf):
    return clean.dedup_fuzzy(read(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], ["text"]).select("doc_id")


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim(lower({c})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')"


@C.add(
    "dedup_fuzzy_share",
    f"""with recursive p as (select p_partkey, p_brand, p_type, p_name[:12] as p_name, {_norm("p_brand")} as a, {_norm("p_type")} as b, {_norm("p_name[:12]")} as c from part),
    f as (select *, row_number() over (order by p_partkey) as n from (select * from p qualify row_number() over (partition by a, b, c order by p_partkey) = 1)),
    e as (select y.n as y, list(x.n) as xs from f x join f y on x.n < y.n and (x.a = y.a)::int + (x.b = y.b)::int + (x.c = y.c)::int >= 2 group by y.n),
    r as (select 0::bigint as n, []::bigint[] as kept union all select r.n + 1, case when e.xs is not null and list_has_any(kept, e.xs) then kept else list_append(kept, r.n + 1) end from r left join e on e.y = r.n + 1 where r.n < (select max(n) from f))
    select p_partkey, p_brand, p_type, p_name from f where n in (select unnest(kept) from r where n = (select max(n) from f))""",
)
def dedup_fuzzy_share(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.substring("p_name", 1, 12).alias("p_name"))
    return clean.dedup_fuzzy(p, ["p_partkey"], ["p_brand", "p_type", "p_name"], 0.66)


@C.add("chart_distribution", "select event_type as label, count(*) as n from events group by event_type order by n desc, label limit 15")
def chart_distribution(spark, sf):
    return report.value_chart(read(spark, sf, "events"), "event_type")


@C.add("chart_histogram", "with s as (select min(value) lo, max(value) hi, least(50, count(distinct value)) k from events) select least(floor((value - lo) / ((hi - lo) / k)), k - 1)::int as bin, count(*) as n from events, s group by 1")
def chart_histogram(spark, sf):
    return report.histogram(read(spark, sf, "events"), "value").select("bin", "n")


@C.add("chart_timeline", "select ts::date as day, count(*) as n from events group by 1")
def chart_timeline(spark, sf):
    return report.timeline(read(spark, sf, "events"), "ts")


@C.add("chart_heatmap", "with c as (" + _corr([(a, b) for a in _LI for b in _LI]) + ") select * from c")
def chart_heatmap(spark, sf):
    return report.heatmap(read(spark, sf, "lineitem").select(*_LI)).data.withColumn("r", F.round("r", 5))


@C.add("chart_scatter", "select p_size, p_retailprice from part")
def chart_scatter(spark, sf):
    return report.scatter(read(spark, sf, "part"), ["p_size", "p_retailprice"]).data


@C.add("chart_plan", """select 'event_id' as "column", 'histogram' as chart union all select 'user_id', 'histogram' union all select 'event_type', 'pie' union all select 'value', 'histogram'""")
def chart_plan(spark, sf):
    return report.chart_plan(profile.profile(_events(spark, sf)))


@C.add("report_findings", f"with {_EV}, d as (select count(*) - count(distinct (user_id, event_type)) as n from ev) select 'duplicate_rows' as finding, n as amount from d where n > 0")
def report_findings(spark, sf):
    e = _events(spark, sf).select("user_id", "event_type")
    return report.findings(profile.profile(e), profile.duplicate_rows(e)).filter("finding = 'duplicate_rows'").select("finding", "amount")


@C.add("report_markdown")
def report_markdown(spark, sf):
    text = report.report(_events(spark, sf)).markdown()
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")
