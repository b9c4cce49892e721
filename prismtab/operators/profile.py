"""Profiles: semantic types, counts, moments, quantiles, top values, outliers, correlations, quality of 0 to 100.

Three passes whatever the number of columns: one wide aggregate for counts and moments;
a long table of (column, value, count) for distinct counts, quantiles and top values;
and one more aggregate for outliers. Quantiles of columns with more than EXACT distinct
values are found by narrowing an interval with counts, so no task holds a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtab.functions.columns import normalise, numeric_columns, string_columns, to_timestamp
from prismtab.functions.store import cut

#: Kinds whose most frequent values are listed.
TOP_KINDS = ("categorical", "categorical_numeric", "string", "boolean")
TOP = 10
#: Distinct values of a column up to which `percentile` is used; beyond, intervals are narrowed.
EXACT = 2_000_000
BINS = 4096


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text), number (the value as double, for numeric columns), n: non-null values of each column.

    Values are counted as they are, whole numbers, other numbers and text apart, and only distinct ones are written as text.
    """
    numeric = set(numeric_columns(df))

    def cell(i: int, c: str) -> Column:
        kind = df.schema[c].dataType
        whole, real = isinstance(kind, _WHOLE), isinstance(kind, (T.FloatType, T.DoubleType))
        text = F.lit(None).cast("string") if whole or real else F.col(c).cast("string")
        # A decimal is known by its text and has a number beside it.
        number = F.col(c).cast("double") if c in numeric and not whole else F.lit(None).cast("double")
        return F.struct(F.lit(i).alias("i"), (F.col(c).cast("long") if whole else F.lit(None).cast("long")).alias("l"), number.alias("d"), text.alias("s"))

    long = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("c")).select("c.*").filter("l is not null or d is not null or s is not null")
    counted = long.groupBy("i", "l", "d", "s").agg(F.count("*").alias("n"))
    singles = [i for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.FloatType)]
    real = F.when(F.col("i").isin(singles), F.col("d").cast("float").cast("string")).otherwise(F.col("d").cast("string")) if singles else F.col("d").cast("string")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return counted.select(name.alias("column"), F.coalesce("s", F.col("l").cast("string"), real).alias("value"), F.coalesce("d", F.col("l").cast("double")).alias("number"), "n")


def exact_quantiles(counts: DataFrame, probs: list[float], limit: int = EXACT) -> DataFrame:
    """column, q (an array, one for each of probs): linear between order statistics, as `percentile`. counts: column, number, n."""
    size = {r["column"]: r for r in counts.groupBy("column").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi")).collect()}  # a row for each column
    few = [c for c, r in size.items() if r["d"] <= limit]
    out = counts.filter(F.col("column").isin(few)).groupBy("column").agg(F.percentile("number", F.array(*[F.lit(p) for p in probs]), F.col("n")).alias("q"))
    rest = [(c, _narrowed(counts.filter(F.col("column") == c), r, probs)) for c, r in size.items() if r["d"] > limit]
    return out.union(counts.sparkSession.createDataFrame(rest, "column string, q array<double>")) if rest else out


def _narrowed(counts: DataFrame, row, probs: list[float]) -> list[float]:
    """The quantiles of one column: for each rank its bin among BINS, again and again until a bin has one value."""

    def at(rank: int) -> float:
        lo, hi, before = row["lo"], row["hi"], 0
        while lo < hi:
            width = (hi - lo) / BINS
            if lo + width == lo or width == 0:
                break
            bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("number") - lo) / width))
            bins = counts.filter((F.col("number") >= lo) & (F.col("number") <= hi)).groupBy(bin_.alias("b")).agg(F.sum("n").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))
            for r in sorted(bins.collect(), key=lambda r: r["b"]):  # at most BINS rows
                if before + r["n"] > rank:
                    lo, hi = r["lo"], r["hi"]
                    break
                before += r["n"]
        return lo

    out = []
    for p in probs:
        where = p * (row["n"] - 1)
        a = at(math.floor(where))
        b = at(math.ceil(where)) if where != math.floor(where) else a
        out.append(a + (b - a) * (where - math.floor(where)))
    return out


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: n, rows, mean, std, lowest, highest, skewness, whole, dates, width (mean text length)."""
    numeric, text = set(numeric_columns(df)), set(string_columns(df))
    # The datetime test looks at 100 values at most; which ones must not depend on the plan, so it is all of them.
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        n = F.count(c)
        g1 = F.skewness(x) if c in numeric else F.lit(None).cast("double")
        aggs += [
            n.alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.when((n > 2) & (F.stddev_pop(x) > 0), g1 * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))).alias(f"skew{i}"),
            F.coalesce(F.min(x == F.floor(x)), F.lit(True)).alias(f"whole{i}") if c in numeric else F.lit(False).alias(f"whole{i}"),
            F.coalesce(F.min(to_timestamp(c).isNotNull() | F.col(c).isNull()), F.lit(False)).alias(f"dates{i}") if c in text else F.lit(False).alias(f"dates{i}"),
            (F.avg(F.length(c)) if c in text else F.lit(0.0)).alias(f"width{i}"),
        ]
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(_family(df.schema[c].dataType)).alias("family"), F.col("rows"), *[F.col(f"{k}{i}").alias(k) for k in ("n", "mean", "std", "lo", "hi", "skew", "whole", "dates", "width")])
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "string"


def semantic_type() -> Column:
    """The type tag from family, rows, unique_count, whole, dates, width and n."""
    ratio = F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1))
    few = (ratio < 0.05) | (F.col("rows") == 0)
    numeric = F.when(F.col("whole") & few & (F.col("unique_count") < 20), "categorical_numeric").when(F.col("whole"), "integer").otherwise("float")
    text = F.when(F.col("dates") & (F.col("n") > 0), "datetime_string").when(few & (F.col("unique_count") < 50), "categorical").when(F.col("width") > 100, "text").otherwise("string")
    return F.when(F.col("family") == "boolean", "boolean").when(F.col("family") == "numeric", numeric).when(F.col("family") == "datetime", "datetime").otherwise(text)


def profile(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row for each column, in `ordinal` order: counts, type, moments, quartiles, bias-adjusted skewness, outliers beyond
    1.5 interquartile ranges, and the ten most frequent values (by count, then value) where the type is of TOP_KINDS.

    approx takes quantiles and distinct counts from sketches. An empty table has zero counts and null moments.
    """
    df = normalise(df.select(*(columns or df.columns)))
    columns, numeric = df.columns, numeric_columns(df)
    base = _moments(df, columns)
    # Cut: size, quantiles, distinct and top values all read it. approx has no use for quantiles of it.
    counts = value_counts(df, columns) if approx else cut(value_counts(df, columns))
    probs = [0.25, 0.5, 0.75]
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)], *[F.percentile_approx(F.col(c).cast("double"), probs).alias(f"q{i}") for i, c in enumerate(columns) if c in numeric])
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("unique_count"), (F.col(f"q{i}") if c in numeric else F.lit(None).cast("array<double>")).alias("q")) for i, c in enumerate(columns)]
        spread = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    else:
        distinct = counts.groupBy("column").agg(F.count("*").alias("unique_count"))
        spread = distinct.join(exact_quantiles(counts.filter("number is not null"), probs), "column", "left")
    joined = base.join(F.broadcast(spread), "column", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("long"))  # a row for each column
    rows = joined.withColumn("type", semantic_type())
    kept = rows.collect()  # a row for each column; what follows joins to it without working it out again
    joined = df.sparkSession.createDataFrame(kept, rows.schema)
    fences = {r["column"]: r["q"] for r in kept if r["q"]}
    beyond = [F.count_if((F.col(c).cast("double") < q[0] - 1.5 * (q[2] - q[0])) | (F.col(c).cast("double") > q[2] + 1.5 * (q[2] - q[0]))).alias(f"o{i}") for i, (c, q) in enumerate(fences.items())]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("outlier_count")) for i, c in enumerate(fences)]
    if beyond:
        outliers = df.agg(*beyond).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        joined = joined.join(F.broadcast(outliers), "column", "left")
    else:
        joined = joined.withColumn("outlier_count", F.lit(None).cast("long"))
    top = top_values(counts).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    joined = joined.join(F.broadcast(top), "column", "left")
    listed = F.when(F.col("type").isin(*TOP_KINDS), F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("n"))))
    r4 = lambda c: F.round(c, 4)
    return joined.select(
        "ordinal", "column", "type", "rows", F.col("n").alias("non_null_count"), (F.col("rows") - F.col("n")).alias("null_count"),
        F.round((F.col("rows") - F.col("n")) / F.greatest(F.col("rows"), F.lit(1)) * 100, 2).alias("null_pct"), "unique_count",
        r4("mean").alias("mean"), r4(F.col("q")[1]).alias("median"), r4("std").alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"),
        r4(F.col("q")[0]).alias("q25"), r4(F.col("q")[2]).alias("q75"), r4("skew").alias("skewness"), F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"), listed.alias("top_values"),
    )


def top_values(counts: DataFrame, n: int = TOP) -> DataFrame:
    """column, rank, value, n: the n most frequent values, ties by value."""
    # Two steps, so that no column's values all meet in one task: first within 64 slices, then among their winners.
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("n").desc(), "value")
    sliced = counts.withColumn("slice", F.expr("pmod(xxhash64(value), 64)"))
    best = sliced.withColumn("r", F.row_number().over(order("column", "slice"))).filter(F.col("r") <= n)
    return best.withColumn("rank", F.row_number().over(order("column"))).filter(F.col("rank") <= n).select("column", "rank", "value", "n")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, r for each pair a <= b of numeric columns over rows that have both; NULL where one is constant. No rows for fewer than two columns."""
    df = normalise(df)
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    x = lambda c, other: F.when(F.col(other).isNotNull(), F.col(c).cast("double"))
    aggs = [F.when((F.stddev_pop(x(a, b)) > 0) & (F.stddev_pop(x(b, a)) > 0), F.covar_pop(x(a, b), x(b, a)) / (F.stddev_pop(x(a, b)) * F.stddev_pop(x(b, a)))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """duplicates: rows beyond the first of each kind; missing values are equal."""
    df = normalise(df)
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n__"))
    return groups.agg(F.coalesce(F.sum(F.col("n__") - 1), F.lit(0)).cast("long").alias("duplicates"))


def memory_mb(df: DataFrame) -> DataFrame:
    """memory_mb: an estimate, the values' own bytes: widths of fixed types, bytes of text."""
    def width(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long")
        return F.lit({T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}.get(type(f.dataType), 8)).cast("long")

    total = sum((width(f) for f in df.schema.fields), F.lit(0).cast("long"))
    return df.agg(F.round(F.coalesce(F.sum(total), F.lit(0)) / (1024 * 1024), 2).alias("memory_mb"))


def quality_columns(df: DataFrame) -> DataFrame:
    """column, completeness, uniqueness, validity, each 0 to 100, rounded to 2 places.

    Uniqueness is of non-null values, 0 if there are none; validity is the share of values that parse as the
    column's type, 100 if there are none.
    """
    df = normalise(df)
    counts = value_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("unique_count"))
    base = _moments(df, df.columns).join(F.broadcast(counts), "column", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    typed = base.withColumn("type", semantic_type())
    kinds = {r["column"]: r["type"] for r in typed.select("column", "type").collect()}  # a row for each column

    def valid(c: str) -> Column:
        family = _family(df.schema[c].dataType)
        if family != "string":
            return F.col(c).isNotNull()
        if kinds[c] in ("datetime", "datetime_string"):
            return to_timestamp(c).isNotNull()
        return F.length(F.trim(c)) > 0

    row = df.agg(*[F.count_if(valid(c)).alias(f"v{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("valid")) for i, c in enumerate(df.columns)]
    valids = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    share = lambda a, b, none: F.round(F.when(b > 0, a / F.nullif(b, F.lit(0)) * 100).otherwise(none), 2)
    return typed.join(F.broadcast(valids), "column").select(
        "ordinal", "column", "type",
        share(F.col("n"), F.col("rows"), 0.0).alias("completeness"),
        share(F.col("unique_count"), F.col("n"), 0.0).alias("uniqueness"),
        share(F.col("valid"), F.col("n"), 100.0).alias("validity"),
    )


def quality(df: DataFrame) -> DataFrame:
    """overall_score, completeness, uniqueness, validity: means over the columns; overall is 0.5, 0.2 and 0.3 of them; 0 without columns."""
    means = quality_columns(df).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("completeness", "uniqueness", "validity")])
    overall = F.col("completeness") * 0.5 + F.col("validity") * 0.3 + F.col("uniqueness") * 0.2
    return means.select(F.round(overall, 2).alias("overall_score"), *[F.round(c, 2).alias(c) for c in ("completeness", "uniqueness", "validity")])


def overview(df: DataFrame) -> DataFrame:
    """row_count, column_count, duplicate_rows, memory_mb, quality: the whole table in one row."""
    parts = df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))
    for more in (duplicate_rows(df).withColumnRenamed("duplicates", "duplicate_rows"), memory_mb(df), quality(df).select(F.col("overall_score").alias("quality"))):
        parts = parts.join(F.broadcast(more))  # one row each
    return parts
